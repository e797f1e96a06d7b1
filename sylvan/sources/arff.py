"""Reader for ARFF files: the header in one small job, the rows as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_ATTR = re.compile(rf"^\s*@attribute\s+({_QUOTED}|\S+)\s+(.+?)\s*$", re.I)
#: Lines of the header, which all others are not.
_HEADER = r"(?i)^\s*@(relation|attribute|data)(\s|$)"
#: Lines that a header may have.
MOST = 20_000


def _plain(s: str) -> str:
    s = s.strip()
    return re.sub(r"\\(.)", r"\1", s[1:-1]) if s[:1] in ("'", '"') else s


def header(lines: list[str]) -> list[tuple[str, str, str | None]]:
    """(name, type, value that a sparse row leaves out) of each attribute; nominal, numeric, date or string."""
    out = []
    for line in lines:
        m = _ATTR.match(line)
        if m:
            t = m[2].strip()
            low = t.lower()
            kind = "nominal" if t.startswith("{") else "numeric" if low.split()[0] in ("numeric", "real", "integer") else "date" if low.startswith("date") else "string"
            first = re.match(rf"\{{\s*({_QUOTED}|[^,}}]*)", t)
            out.append((_plain(m[1]), kind, "0" if kind == "numeric" else _plain(first[1]) if first else None))
    return out


def _value(c: Column) -> Column:
    """A field without its quotes; ? is null."""
    bare = F.trim(c)
    quoted = bare.rlike("^['\"]")
    inner = F.regexp_replace(F.substr(bare, F.lit(2), F.length(bare) - 2), r"\\(.)", "$1")
    return F.when(quoted, inner).when(bare != "?", bare)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the header: numeric as double, others as string; "?" is null.

    Dense rows, and sparse ones of index and value in braces, which leave out
    zeros and first nominal values.  Values may be in either kind of quotes.
    Comments and blank lines do not count.
    """
    lines = spark.read.text(path)
    clean = lines.where("trim(value) <> '' and not startswith(trim(value), '%')")
    is_header = F.col("value").rlike(_HEADER)
    head = [r[0] for r in clean.where(is_header).limit(MOST + 1).collect()]
    if len(head) > MOST:
        raise ValueError(f"a header of more than {MOST} lines")
    attrs = header(head)
    if not attrs:
        raise ValueError("no attributes")
    data = clean.where(~is_header).select(F.trim("value").alias("value"))
    sparse = F.startswith("value", F.lit("{")) & F.endswith("value", F.lit("}"))
    fields = F.regexp_extract_all("value", F.lit(rf"\G\s*({_QUOTED}|[^,]*?)\s*(?:,|$)"), F.lit(1))
    pair = rf"(\d+)\s+({_QUOTED}|[^,}}]*)"
    places, values = (F.regexp_extract_all("value", F.lit(pair), F.lit(k)) for k in (1, 2))
    rows = data.select(F.when(~sparse, fields).alias("f"), F.when(sparse, F.map_from_entries(F.arrays_zip(F.transform(places, lambda x: x.cast("int")).alias("k"), values.alias("v")))).alias("s"), sparse.alias("sparse"))
    out = []
    for i, (name, kind, absent) in enumerate(attrs):
        held = F.try_element_at("s", F.lit(i))
        v = F.when(F.col("sparse"), F.when(F.map_contains_key("s", F.lit(i)), _value(held)).otherwise(F.lit(absent))).otherwise(_value(F.get("f", F.lit(i))))
        out.append((v.try_cast("double") if kind == "numeric" else v).alias(name))
    return rows.select(*out)
