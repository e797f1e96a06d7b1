"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (1 to 3, words padded
with a boundary) in rank order, counted over every training document.  A
document's own most frequent n-grams are compared with each profile by the sum
of rank differences, an absent n-gram counting as the profile's length; the
nearest language wins.

Nulls: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing was learned.  Rows with a null language or text are not
learned from.  Equal counts rank by the n-gram's code points, equal distances
by the language's name.  Whole texts count, however long; repeated rows count
again.  Other columns are kept by :func:`identify` and ignored in learning.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import in_batches

#: Length of a profile.
PROFILE = 400
#: Languages that a model can hold: the model is sent to every task, so its size is bounded.
MAX_LANGUAGES = 2000
#: Characters that are handled together.
CHUNK = 250_000

_NONE = 0x1FFFFF  # stands for the missing places of a shorter n-gram
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_key(gram: str) -> int:
    """The number that stands for an n-gram; "_" is the word boundary."""
    codes = [0 if c == "_" else ord(c) for c in gram]
    a, b, c = [_NONE] * (3 - len(codes)) + codes
    return a << 42 | b << 21 | c


def grams(texts: list[str]) -> Iterator[np.ndarray]:
    """The n-gram keys of each text, in any order; of no length if it has no letter."""
    at = 0
    while at < len(texts):
        stop, total = at, 0
        while stop < len(texts) and (stop == at or total + len(texts[stop]) <= CHUNK):
            total += len(texts[stop])
            stop += 1
        low = [t.lower() for t in texts[at:stop]]
        codes = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[~_is_letter()[codes]] = 0
        place = np.flatnonzero((codes != 0) | (np.concatenate(([1], codes[:-1])) != 0))
        codes = codes[place]
        starts = np.cumsum([1] + [len(t) + 1 for t in low])
        b = codes[1:-1]
        mid = np.flatnonzero(b) + 1  # every letter
        cut = np.searchsorted(place[mid], starts)
        one = codes[mid] | (_NONE << 42 | _NONE << 21)
        two = codes[mid - 1] << 21 | codes[mid] | _NONE << 42
        last = np.where(codes[mid + 1] == 0, codes[mid] << 21 | _NONE << 42, -1)
        three = codes[mid - 1] << 42 | codes[mid] << 21 | codes[mid + 1]
        for i in range(len(low)):
            s = slice(cut[i], cut[i + 1])
            end = last[s]
            yield np.concatenate((one[s], two[s], three[s], end[end >= 0]))
        at = stop


def ranked(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent distinct keys, in rank order."""
    distinct, counts = np.unique(keys, return_counts=True)
    return distinct[np.lexsort((distinct, -counts))[:most]]


@dataclass(frozen=True)
class Model:
    """Languages and their profiles, as ranks of all n-grams that any profile has."""

    langs: tuple[str, ...]
    keys: np.ndarray
    ranks: np.ndarray  # (languages, keys); the profile's length where absent
    length: int

    def distances(self, keys: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each language."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.ranks[:, at]
        off = np.abs(there - np.arange(len(keys)))
        return np.where((self.keys[at] == keys) & (there < self.length), off, self.length).sum(1)

    def predict(self, keys: np.ndarray) -> tuple[str, float]:
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = ranked(keys, self.length)
        d = self.distances(top)
        best = int(d.argmin())
        return self.langs[best], float(1 - d[best] / (self.length * len(top)))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", length: int = PROFILE) -> Model:
    """Profiles of every language of ``docs``, from all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def squeeze(lang: str) -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([x for x, _ in held[lang]])
            n = np.concatenate([x for _, x in held[lang]])
            distinct, at = np.unique(k, return_inverse=True)
            return distinct, np.bincount(at, n).astype(np.int64)

        for b in batches:
            by: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[lang].append(text)
            for lang, texts in by.items():
                wait: list[np.ndarray] = []
                for k in grams(texts):
                    wait.append(k)
                    if sum(map(len, wait)) > 1_000_000:
                        held[lang].append(np.unique(np.concatenate(wait), return_counts=True))
                        wait = []
                if wait:
                    held[lang].append(np.unique(np.concatenate(wait), return_counts=True))
                held[lang] = [squeeze(lang)]
        for lang in held:
            k, n = squeeze(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = in_batches(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= length).select("lang", "gram", "r")
    got = top.limit(MAX_LANGUAGES * length + 1).toPandas()
    if len(got) > MAX_LANGUAGES * length:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = tuple(sorted(set(got["lang"])))
    keys, at = np.unique(got["gram"].to_numpy(np.int64), return_inverse=True)
    ranks = np.full((len(langs), len(keys)), length, np.int64)
    ranks[np.searchsorted(np.array(langs), got["lang"].to_numpy(str)) if langs else [], at] = got["r"].to_numpy(np.int64) - 1
    return Model(langs, keys, ranks, length)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    docs = docs.drop(*out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(list(docs.schema.fields)).add(out[0], "string").add(out[1], "double")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            said = [sent.value.predict(k) for k in grams(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], schema.names)

    return in_batches(docs, run, schema)


def id_remainder(col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % of


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose id's remainder modulo 3 is not 1."""
    held = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    model = learn(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


#: A text whose nearest profile is farther than this is in no learned language.  Prose of one learned language scores 0.42 and
#: more, however short or spotted with other things; letter salad, encoded data and prose of another language 0.35 at most.
MIN_SCORE = 0.35


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a language: those without a letter, or unlike every profile, go."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [sent.value.predict(k) for k in grams([t or "" for t in b.column(at).to_pylist()])]
            yield b.filter(pa.array([lang != "und" and score >= min_score for lang, score in said], pa.bool_()))

    return in_batches(docs, run, docs.schema)
