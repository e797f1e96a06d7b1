"""Personal data: detection and keyed surrogates.

Detected entities (secrets, e-mail addresses, IBANs, social security numbers,
IPv4 addresses, card numbers, telephone numbers, titled person names and later
or earlier mentions of these persons in the same text) are replaced by
surrogates of the same type and form: letters stay letters of the same script
and case, digits digits, separators and fixed parts as they are; check digits
are valid again where they were; addresses keep their range's kind; names keep
gender, script, case and the title.

Everything but names goes through a keyed permutation of all strings of the
entity's pattern, so equal entities get equal surrogates everywhere
(coreference), different ones different surrogates (distinctness), and none its
own form.  A telephone number has the same surrogate in any grouping, with or
without its country code.

A name is replaced word by word: a family name has one surrogate everywhere, a
given name one for its gender, so a person is the same with any title, with or
without given names.  The gender is the given name's where the lists tell it,
else that of a Cyrillic family name's ending, else the title's; where a neutral
title is all there is, that of the same name under another title, if there is
just one.  Surrogate words are drawn by keyed hash.  A collision check over all
distinct words of the corpus's names gives a further draw to every word whose
surrogate another has already, and to a family name whose surrogate is a family
name of the corpus; so different names stay different and none becomes another
one of the corpus.  Initials are permuted; one whose draws run out is written
out.  A clash that stays after that is an error.  What needs another draw is
rare and goes to the tasks as a bounded table; beyond the bound it is joined to
its documents instead.

The key comes from the setting ``spark.sylvan.pii.key``.  Where it is not set a
random one is drawn for the call and not kept, so nobody can undo or repeat the
surrogates.

Nulls: a null text stays null with 0 entities, an empty one stays empty.  Text
outside entities is untouched, whatever its length.  Repeated rows are replaced
alike.  Columns other than the text are kept, but one named like ``count_col``
is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh, in_batches, materialise

#: The setting that holds the key.
KEY = "spark.sylvan.pii.key"
#: Rows of the table of further draws that may be sent to all tasks.
MOST_SENT = 100_000
#: Draws after which a given name is made up.
DRAWS = 6
#: Draws after which an initial is written out, and rounds of the check that may follow.
WORD, SPARE = 12, 30

# Titles with the gender they tell.
MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Signor|Sir|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Signora|госпожа"
NEUTRAL = "Dr|Prof|Doktor|Docteur|доктор"
# Given names by gender.
GIVEN_MALE = "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Lukas Jonas Felix Hans Jürgen Klaus Pierre Louis Henri Jacques Luis Carlos Javier Diego Pablo Miguel Andrés Marco Luca Ivan".split()
GIVEN_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Laura Julia Sophie Marie Claire Camille Ingrid Heike Sabine Monika Lucía Carmen Elena Isabel Marta Pilar Rosa Giulia Chiara Olga Irina".split()
CYRILLIC_MALE = "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил Павел Виктор Олег Игорь".split()
GIVEN_NEUTRAL = "Alex Robin Kim Sascha Dominique Charlie Sam Chris Toni Kay Jamie Morgan Taylor Jordan Casey Riley".split()
CYRILLIC_NEUTRAL = "Саша Женя Валя Шура Слава Паша".split()
CYRILLIC_FEMALE = "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Юлия Вера Нина Дарья".split()

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+|[A-ZÀ-ÖØ-Þ]\.|[А-ЯЁ][а-яё-]+|[А-ЯЁ]\.)"
_TITLE = f"{MALE}|{FEMALE}|{NEUTRAL}"
_PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])",
    "credential": r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.~!@#$%^&*-]{6,})",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)",
    "person": rf"(?<!\w)(?P<title>{_TITLE})(?P<gap>\.?[  ])(?P<name>{_CAP}(?:[  ]{_CAP}){{0,2}})",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
#: Every entity has a digit, "@", a title, a key word or a fixed start.
_MAY = re.compile(rf"\d|@|(?i:passw|pwd|passphrase|secret|token|api.?key|access.?key)|sk-|xox|gh[pousr]_|(?<!\w)(?:{_TITLE})\.?[  ]")
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE})\.?[  ]")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each entity, left to right, none overlapping."""
    if not _MAY.search(text):
        return
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup in _PATTERNS else next(k for k in _PATTERNS if m.group(k) is not None)
        a, b = m.span()
        if kind == "credential":
            a, b = m.span("value")
            value = text[a:b].rstrip(".")
            if value.isalpha():  # a word, as in "password: required"
                continue
            b = a + len(value)
        elif kind == "person":
            a, b = m.span("name")
        elif kind == "iban" and not _iban_ok(text[a:b].replace(" ", "")):
            continue
        yield kind, a, b


# -- keyed permutations


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest(), "big")


def _feistel(x: int, half: int, key: bytes, tweak: str, back: bool) -> int:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for r in range(7, -1, -1) if back else range(8):
        if back:
            left, right = right ^ (_prf(key, tweak, half, r, left) & mask), left
        else:
            left, right = right, left ^ (_prf(key, tweak, half, r, right) & mask)
    return left << half | right


def _permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    half = max(2, (n - 1).bit_length() + 1 >> 1)
    while True:
        x = _feistel(x, half, key, tweak, back)
        if x < n:
            return x


def next_in_cycle(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. n - 1 that is one cycle, so nothing maps to itself (n > 1)."""
    return _permute((_permute(x, n, key, tweak) + 1) % n, n, key, tweak, back=True)


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_CLASS = {c: a for a in _ALPHABETS for c in a}


def reshape(s: str, key: bytes, tweak: str, accept: Callable[[str], bool] | None = None, case: bool = True) -> str:
    """The keyed surrogate of ``s`` among all strings of its pattern that ``accept`` takes, if it takes ``s``.

    With ``case`` upper and lower case letters are the same letter, and the
    surrogate has its letters' case where ``s`` has it; else case is part of the pattern alike.
    """
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    slots = [(i, _CLASS[c]) for i, c in enumerate(low) if c in _CLASS]
    n = 1
    for _, a in slots:
        n *= len(a)
    if n < 2:
        return s
    pattern = "".join("0aбα"[_ALPHABETS.index(_CLASS[c])] if c in _CLASS else c for c in low)
    if not case:
        pattern += "".join("U" if c != k else "l" for c, k in zip(s, low, strict=True))
    x = 0
    for i, a in slots:
        x = x * len(a) + a.index(low[i])
    out = list(s)
    start = x
    while True:
        x = next_in_cycle(x, n, key, f"{tweak}|{pattern}")
        y = x
        for i, a in reversed(slots):
            y, k = divmod(y, len(a))
            out[i] = a[k].upper() if s[i] != low[i] else a[k]
        made = "".join(out)
        if accept is None or accept(made) or x == start:
            return made


# -- surrogates by kind


def _ip_kind(s: str) -> str | None:
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return None
    if o[0] in (0, 127) or o[0] >= 224:
        return f"special{o[0]}"
    if o[0] == 10 or o[0] == 192 and o[1] == 168 or o[0] == 172 and 16 <= o[1] < 32:
        return f"private{o[0]}"
    return "public"


def _ip(s: str, key: bytes) -> str:
    kind = _ip_kind(s)
    x = 0
    for o in s.split("."):
        x = x << 8 | int(o)
    while True:
        x = next_in_cycle(x, 1 << 32, key, "ip")
        made = ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))
        if _ip_kind(made) == kind:
            return made


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _fill(s: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), s)


def _card(s: str, key: bytes) -> str:
    """The first digit and the check digit's validity stay; grouping stays."""
    d = _digits(s)
    if not _luhn(d):
        return _fill(s, d[0] + reshape(d[1:], key, f"card{d[0]}", lambda x: not _luhn(d[0] + x)))
    body = d[0] + reshape(d[1:-1], key, f"luhn{d[0]}")
    return _fill(s, next(x for c in "0123456789" if _luhn(x := body + c)))


def _phone(s: str, key: bytes) -> str:
    """The country code stays; area and exchange of ten digits begin with 2 to 9 where they did.  Grouping does not count."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", s)
    head = m[0] if m else ""
    rest = s[len(head) :]
    d = _digits(rest)
    starts = (0, 3) if len(d) == 10 else (0,)
    sound = lambda d: tuple(d[i] in "01" for i in starts)
    return head + _fill(rest, reshape(d, key, "phone", lambda x: sound(x) == sound(d)))


def _ssn(s: str, key: bytes) -> str:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _digits(s)
    return _fill(s, reshape(d, key, "ssn", lambda x: ok(x) == ok(d)))


def _iban(s: str, key: bytes) -> str:
    bare = s.replace(" ", "")
    body = reshape(bare[4:], key, f"iban{bare[:2]}")
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{bare[:2]}00")) % 97
    it = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


def _email(s: str, key: bytes) -> str:
    """Local part and each label of the domain have surrogates of their own, so addresses of one domain stay together."""
    local, _, domain = s.rpartition("@")
    *labels, top = domain.split(".")
    return f"{reshape(local, key, 'local')}@{'.'.join([*(reshape(x, key, 'label') for x in labels), top])}"


def _secret(s: str, key: bytes) -> str:
    head = next((m[0] for m in [re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-", s)] if m), "")
    rest = s[len(head) :]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest):  # hexadecimal stays so
        n, x = 16 ** len(rest), int(rest, 16)
        made = f"{next_in_cycle(x, n, key, f'hex{len(rest)}'):0{len(rest)}x}"
        return head + (made if rest.lower() == rest else made.upper())
    return head + reshape(rest, key, f"secret{head}", case=False)


_ONSETS, _VOWELS, _CODAS = "b d f g h k l m n p r s t v w br dr gr kr st tr".split(), "a e i o u".split(), ["", "", "n", "r", "l", "s"]
_ONSETS_CYR, _VOWELS_CYR, _CODAS_CYR = "б в г д з к л м н п р с т х".split(), "а е и о у".split(), ["", "", "н", "р", "л"]


def _made_up(x: int, cyrillic: bool, female: bool) -> str:
    on, vo, co = (_ONSETS_CYR, _VOWELS_CYR, _CODAS_CYR) if cyrillic else (_ONSETS, _VOWELS, _CODAS)
    out = ""
    for _ in range(3 + x % 2):
        for part in (on, vo, co):
            x, k = divmod(x, len(part))
            out += part[k]
    if cyrillic:
        out += "ова" if female else "ов"
    return out.capitalize()


def person_parts(name: str) -> list[str]:
    return re.split(r"[  ]", name)


_NAMES = {(False, "m"): GIVEN_MALE, (False, "f"): GIVEN_FEMALE, (False, ""): GIVEN_NEUTRAL, (True, "m"): CYRILLIC_MALE, (True, "f"): CYRILLIC_FEMALE, (True, ""): CYRILLIC_NEUTRAL}
_GENDER = {w.lower(): g for (_, g), names in _NAMES.items() if g for w in names}


def _cyrillic(word: str) -> bool:
    return bool(re.search("[а-яё]", word, re.I))


def person_gender(name: str, title: str) -> str:
    """m, f or nothing: as a given name tells, the ending of a Cyrillic family name, or else the title."""
    *given, family = person_parts(name)
    told = next((_GENDER[g.lower()] for g in given if g.lower() in _GENDER), "")
    if not told and re.search("(?:ова|ева|ина|ая)$", family, re.I):
        told = "f"
    elif not told and re.search("(?:ов|ев|ин|ий|ый|ой)$", family, re.I):
        told = "m"
    return told or ("m" if title in MALE.split("|") else "f" if title in FEMALE.split("|") else "")


def person_words(name: str, gender: str) -> list[tuple[str, str, str]]:
    """(kind, word, gender) of each word of a name; a family name has a gender where its ending has."""
    *given, family = person_parts(name.lower())
    return [*(("given", g, gender) for g in given), ("family", family, gender if gender == "f" and _cyrillic(family) else "")]


def _initial(word: str, key: bytes, draw: int) -> str:
    alphabet = _ALPHABETS[2 if _cyrillic(word) else 1]
    if draw == 0 and word[0] in alphabet:
        at = next_in_cycle(alphabet.index(word[0]), len(alphabet), key, f"initial{alphabet[0]}")
    else:
        at = _prf(key, "initial", word, draw) % len(alphabet)
    return alphabet[at].upper() + "."


def _given(word: str, gender: str, key: bytes, draw: int) -> str:
    """Before ``DRAWS`` from the list of the script and gender, then made up."""
    if word.endswith(".") and draw < WORD:
        return _initial(word, key, draw)
    cyrillic = _cyrillic(word)
    names = _NAMES[cyrillic, gender]
    h = _prf(key, "given", word, gender, draw)
    if draw >= DRAWS:
        return _made_up(h >> 8, cyrillic, False).removesuffix("ов") + ("а" if cyrillic else "a") * (gender == "f")
    pick = h % len(names)
    return names[(pick + 1) % len(names)] if names[pick].lower() == word else names[pick]


def _family(word: str, gender: str, key: bytes, draw: int) -> str:
    if word.endswith(".") and draw < WORD:
        return _initial(word, key, draw)
    return _made_up(_prf(key, "family", word, draw) >> 8, _cyrillic(word), gender == "f")


_BY_KIND = {"ip": _ip, "card": _card, "phone": _phone, "ssn": _ssn, "iban": _iban, "email": _email, "secret": _secret, "credential": _secret}


@lru_cache(maxsize=50_000)
def surrogate(kind: str, form: str, key: bytes, gender: str = "", draw: int = 0) -> str:
    """Of an entity's form; of a word of a name, in lower case, for the kinds ``given`` and ``family``."""
    if kind in ("given", "family"):
        return (_given if kind == "given" else _family)(form, gender, key, draw)
    return _BY_KIND[kind](form, key)


def _mentions(text: str, persons: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, gender) of untitled mentions, outside ``taken``, of the titled persons: the family name as a word, with known given names ahead of it.

    A family name that the text also has in lower case is a common word and is left alone.
    """
    families, given, genders = set(), set(), {}
    for a, b, gender in persons:
        *firsts, family = person_parts(text[a:b])
        genders.setdefault(text[a:b].lower(), gender)
        if not family.endswith(".") and len(family) > 1:
            families.add(family)
            given.update(firsts)
    words = set(re.findall(r"\w[\w'’-]*", text)) if families else set()
    families = {f for f in families if f.lower() not in words}
    if not families:
        return
    spans = iter(sorted(taken))
    now = next(spans, None)
    start = last = None  # of known given names right before
    for m in _NAME_WORD.finditer(text):
        a, b = m.span()
        while now and now[1] <= a:
            now = next(spans, None)
        if now and now[0] < b:
            start = None
            continue
        if start is None or last + 1 != a or text[last] not in " \u00a0":
            start = a
        last = b
        if m[0] in families:
            name = text[start:b].lower()
            yield start, b, genders.get(name) or person_gender(text[start:b], "")
            start = None
        elif m[0] not in given:
            start = None


_NAME_WORD = re.compile(rf"(?<!\w){_CAP}(?!\w)")


def entities(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, gender) of each entity and mention, left to right; a gender only of persons."""
    found = []
    for kind, a, b in find(text):
        gender = ""
        if kind == "person":
            gender = person_gender(text[a:b], re.search(rf"({_TITLE})\.?[  ]$", text[max(0, a - 20) : a])[1])
        found.append((kind, a, b, gender))
    persons = [(a, b, g) for kind, a, b, g in found if kind == "person"]
    if persons:
        found += [("person", a, b, g) for a, b, g in _mentions(text, persons, [(a, b) for _, a, b, _ in found])]
        found.sort(key=lambda e: e[1])
    yield from found


Table = dict[tuple[str, str, str], str | int]


def _person(name: str, gender: str, key: bytes, table: Table) -> str:
    gender = table.get(("person", name.lower(), gender), gender)
    out = re.split("([ \u00a0])", name)
    for i, (kind, word, g) in enumerate(person_words(name, gender)):
        new, like = surrogate(kind, word, key, g, table.get((kind, word, g), 0)), out[2 * i]
        out[2 * i] = new.upper() if len(like) > 2 and like.isupper() else new
    return "".join(out)


def replace(text: str, key: bytes, table: Table | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of its entities.

    ``table`` has the draw of each word of a name that needs another than the
    first, and the gender of each person whose title and name tell none.
    """
    out, at, kinds = [], 0, []
    for kind, a, b, gender in entities(text):
        form = text[a:b]
        out += [text[at:a], _person(form, gender, key, table or {}) if kind == "person" else surrogate(kind, form, key)]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]) if kinds else text, kinds


ENTITY = "kind string, form string, gender string"


def _rows(found, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [[]] * len(names))], names)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = {(t[a:e].lower(), gender) for t in b.column(0).to_pylist() if t and _TITLED.search(t) for kind, a, e, gender in entities(t) if kind == "person"}
        yield _rows(sorted(seen), ["form", "gender"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = {w for form, gender in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in person_words(form, gender)}
        yield _rows(sorted(seen), ["kind", "form", "gender"])


def _assign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(r["kind"], r["form"], key, r["gender"], r["draw"]).lower() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "form", "gender", "draw", "made"])

    return run


def name_table(docs: DataFrame, key: bytes, text_col: str = "text", rounds: int = WORD + SPARE) -> DataFrame:
    """(kind, form, gender, draw, told): words of names that need another draw than the first, and persons whose gender another title tells.

    Only names are drawn; all other surrogates are permutations and cannot collide.
    """
    persons = materialise(in_batches(docs.select(F.col(text_col).cast("string").alias("text")), _detect, "form string, gender string").distinct(), "persons")
    one = persons.where("gender <> ''").groupBy("form").agg(F.min("gender").alias("told"), F.max("gender").alias("other")).where("told = other").select("form", "told")
    told = persons.where("gender = ''").join(one, "form").select("form", "told")
    whole = persons.join(told, "form", "left").select("form", F.when(F.col("gender") == "", F.coalesce("told", F.lit(""))).otherwise(F.col("gender")).alias("gender"))
    found = materialise(in_batches(whole, _words, ENTITY).distinct(), "words")
    real = found.where("kind = 'family'").select("kind", F.col("form").alias("made")).distinct().withColumn("real", F.lit(True))
    now = found.withColumn("draw", F.lit(0))
    for _ in range(rounds):
        made = materialise(in_batches(now, _assign(key), f"{ENTITY}, draw int, made string"), "draws")
        first = made.groupBy("kind", "made").agg(F.min(F.struct("draw", "form", "gender")).alias("keeper"))
        again = made.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
        clash = F.col("real").isNotNull() | (F.struct("draw", "form", "gender") != F.col("keeper"))
        now = again.select("kind", "form", "gender", (F.col("draw") + F.when(clash, 1).otherwise(0)).cast("int").alias("draw"), clash.alias("clash"))
        now = materialise(now, "draws")
        if not now.where("clash").take(1):
            break
        now = now.drop("clash")
    else:
        raise RuntimeError(f"names still share a surrogate after {rounds} rounds of draws")
    draws = now.where("draw > 0").select("kind", "form", "gender", "draw", F.lit(None).cast("string").alias("told"))
    return draws.unionByName(told.select(F.lit("person").alias("kind"), "form", F.lit("").alias("gender"), F.lit(0).alias("draw"), "told"))


def configured_key(spark: SparkSession) -> bytes:
    """The key that the session's setting holds, or a random one."""
    held = spark.conf.get(KEY, None)
    return held.encode() if held else secrets.token_bytes(32)


def _table(rows) -> Table:
    return {(r["kind"], r["form"], r["gender"]): r["told"] or r["draw"] for r in rows}


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes | None = None, count_col: str | None = None) -> DataFrame:
    """``docs`` with its texts' entities replaced, and their number if a column for it is named."""
    key = key or configured_key(docs.sparkSession)
    if count_col:
        docs = docs.drop(count_col)
    found = materialise(name_table(docs, key, text_col), "names")
    got = found.limit(MOST_SENT + 1).collect()
    kept = list(docs.columns)
    at = kept.index(text_col)
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    schema = T.StructType(fields + ([T.StructField(count_col, T.LongType())] if count_col else []))
    text = F.col(f"`{text_col}`").cast("string")
    joined = len(got) > MOST_SENT
    if joined:

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = set()
                for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for kind, a, e, gender in entities(t) if t else ():
                        if kind == "person":
                            may = {gender} if gender else {"", "m", "f"}
                            rows |= {(h, "person", t[a:e].lower(), gender)} | {(h, *w) for g in may for w in person_words(t[a:e], g)}
                yield _rows(sorted(rows), ["h", "kind", "form", "gender"])

        own_h, own_rows = fresh(docs, "_h", "_rows")
        digest = F.sha2(text, 256)
        own = in_batches(docs.select(digest.alias("h"), text.alias("text")), hits, f"h string, {ENTITY}").distinct().join(found, ["kind", "form", "gender"])
        own = own.groupBy(F.col("h").alias(own_h)).agg(F.collect_list(F.struct("kind", "form", "gender", "draw", "told")).alias(own_rows))
        docs = docs.join(own, digest == F.col(own_h), "left").drop(own_h)
    docs = docs.withColumn(text_col, text)
    sent = docs.sparkSession.sparkContext.broadcast({} if joined else _table(got))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            extra = b.column(len(kept)).to_pylist() if joined else [None] * len(texts)
            done = [replace(t, key, _table(x) if x else sent.value) if t else (t, []) for t, x in zip(texts, extra, strict=True)]
            columns = list(b.columns[: len(kept)])
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([len(k) for _, k in done], pa.int64())] if count_col else [])], schema.fieldNames())

    return in_batches(docs, run, schema)
