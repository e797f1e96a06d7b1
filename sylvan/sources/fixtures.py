"""Input tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUMERIC = ["l_quantity", "l_discount", "l_tax"]
NOMINAL = ["l_linestatus", "p_type", "p_brand"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part; class l_returnflag."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")


def lines_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with quantity and status unknown in every fourth line of an order."""
    gap = F.col("l_linenumber") % 4 == 0
    df = table(spark, sf_dir, "lineitem")
    return df.withColumn("l_quantity", F.when(~gap, F.col("l_quantity"))).withColumn("l_linestatus", F.when(~gap, F.col("l_linestatus")))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, label, seq, text): a user's day as itemsets of the event types of each hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type")
    sets = e.groupBy("user_id", "day", "hour").agg(F.array_sort(F.collect_set("event_type")).alias("items"))
    seqs = sets.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("hour", "items"))).alias("s"))
    sid = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("day").cast("string"))
    seq = F.transform("s", lambda x: x["items"])
    return seqs.select(sid.alias("sid"), (F.col("user_id") % 3).cast("string").alias("label"), seq.alias("seq")).withColumn("text", F.array_join(F.transform("seq", lambda x: F.array_join(x, ",")), ">"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, label, w, series): embeddings as series of 64 values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sid"), F.col("label").cast("string").alias("label"), F.lit(1.0).alias("w"), F.col("embedding").cast("array<double>").alias("series"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, label, series): a user's daily mean value in order of the days."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    s = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s"))
    return s.select(F.col("user_id").alias("sid"), (F.col("user_id") % 3).cast("string").alias("label"), F.transform("s", lambda x: x["v"]).alias("series"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality mark as class, null where there is none."""
    d, m = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return d.join(m, "doc_id", "left")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, id, x, y): parts of a type as points, minus the size and the price to be least."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.col("p_partkey").alias("id"), (-F.col("p_size")).cast("double").alias("x"), F.round("p_retailprice", 2).cast("double").alias("y"))
