"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, gif, jaccard_join, langid, lm, mixing, pii, quality_crf, warc
from .storage import table

_JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
k AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN k USING (x)),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(doc_id, r) AS (SELECT DISTINCT u, u FROM l UNION SELECT l.v, c.r FROM c JOIN l ON l.u = c.doc_id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.r, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read_back(table(spark, sf_dir, "pages"), least=0)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_entities")


def op4_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_and_read_back(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_read_back(chat.with_probe(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_warc_salvage, op3_pii_surrogates, op4_rank_order_langid, op5_elias_fano_lm, op6_gif_media, op7_pareto_mixing, op8_line_crf_quality, op9_latent_decontamination, op10_prefix_target_chat]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _JACCARD_SQL, "op2_warc_salvage": warc.ORACLE, "op7_pareto_mixing": mixing.ORACLE, "op10_prefix_target_chat": chat.ORACLE}
