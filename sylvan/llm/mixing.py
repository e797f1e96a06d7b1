"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words: its weight's share of the budget,
but no more than ``cap`` times its own words, the excess going to the others by
weight until none is above.  Every document of a source gets the whole part of
``target / source_size`` copies outright.  For what then is left of the target
documents are ranked by their random odds divided by their inclusion odds and
taken in that order, to the nearest document: a Pareto sample of fixed size.  The
random odds are ``u / (1 - u)`` with u from a keyed hash of the id; the inclusion
odds are proportional to the square root of the document's size over the
source's mean size, between 1 / ``SPREAD`` and ``SPREAD``, so longer documents
are likelier to be in.  (The factor that all documents of a source share would
not change their order and is left out.)

A source may hold any part of the rows: its documents are dealt into buckets of
about ``BUCKET`` along the ranking, at most ``SPREAD`` times that, whose sums
alone are added up per source; only within the bucket where the target falls
does a document's own rank count.

Nulls: a null text has size 0; null sources form one source, which comes last;
a null id is hashed as the empty text.  Empty documents are taken 0 words.
Ties in the ranking go by id (null first), then size; repeated rows are
separate documents.  If all sizes are 0, all targets are 0.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Documents in a bucket of a source's ranking, about.
BUCKET = 1000
#: Most and least inclusion odds against the source's mean document.
SPREAD = 4.0
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n, target): one row a source.

    The water level of weights under caps is the highest of the levels that
    come from capping the sources with the lowest cap for their weight first.
    The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("w", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("target", F.least("most", F.max("level").over(everything) * F.col("w")))
        .select("source", "source_size", "n", "target")
    )


def rank(sized: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``sized`` with its source's ``plan``, whole copies, rest of the target, its ``q`` in the ranking and the bucket of it."""
    plan = (
        plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    odds = F.when(F.col("source_size") > 0, F.least(F.greatest(F.sqrt(F.col("size") / (F.col("source_size") / F.col("n"))), F.lit(1 / SPREAD)), F.lit(SPREAD))).otherwise(F.lit(1.0))
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("u", u)
        .withColumn("q", F.col("u") / (1 - F.col("u")) / odds)
        .withColumn("buckets", F.ceil(F.col("n") / F.lit(float(BUCKET))))
        .withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(F.col("q") / (1 + F.col("q")) * F.col("buckets"))))
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row; taken counts repeats."""
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
    ranked = rank(sized, targets(sized, weights, share, cap), seed)
    along = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("of", "bucket").agg(F.sum("size").alias("in_bucket")).select(F.col("of").alias("of2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("in_bucket").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy("of2", "bucket2").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("start") + F.sum("size").over(within)
    return (
        ranked.join(starts, F.col("of").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("bucket2")))
        .withColumn("more", ((F.col("rest") > 0) & (reached - F.col("size") / F.lit(2.0) <= F.col("rest"))).cast("long"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"))
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, count(*)::DOUBLE AS m, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, m, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS lev
      FROM w WINDOW b AS (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, m, least(most, max(lev) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0::DOUBLE END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source, p.source_size, p.target, whole, target - whole * source_size AS rest,
        CASE WHEN source_size > 0 THEN least(greatest(sqrt(d.size::DOUBLE / (source_size / m)), 0.25::DOUBLE), 4.0::DOUBLE) ELSE 1.0::DOUBLE END AS odds,
        (CAST('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, u / (1.0::DOUBLE - u) / odds AS rank FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
