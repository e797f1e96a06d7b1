"""Unknown values: their mass in a split's counts, and fractional routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_counts(rows: DataFrame) -> DataFrame:
    """``rows(bag, label, w)`` with null bags for unknown: (bag, label, w) with the unknown mass spread.

    Each class's unknown weight goes to the bags in proportion to their size
    (evenly if all are empty).
    """
    known = rows.where("bag is not null").groupBy("bag", "label").agg(F.sum("w").alias("w"))
    bags = known.groupBy("bag").agg(F.sum("w").alias("size"))
    all_ = bags.agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    share = bags.crossJoin(F.broadcast(all_)).select("bag", F.when(F.col("total") > 0, F.col("size") / F.col("total")).otherwise(1 / F.col("n")).alias("share"))
    # One row a bag and one a class: both bounded by the split, not by the rows.
    lost = rows.where("bag is null").groupBy("label").agg(F.sum("w").alias("lost"))
    extra = lost.crossJoin(F.broadcast(share)).select("bag", "label", (F.col("lost") * F.col("share")).alias("w"))
    return known.unionByName(extra).groupBy("bag", "label").agg(F.sum("w").alias("w"))


def route(df: DataFrame, bag: Column, shares: list[float], w: str = "w") -> DataFrame:
    """``df`` with ``bag``: rows of unknown bag go to every bag that has a share, at that part of their weight."""
    unknown = F.array(*[F.struct(F.lit(i).alias("bag"), F.lit(float(s)).alias("part")) for i, s in enumerate(shares) if s > 0])
    known = F.array(F.struct(bag.cast("int").alias("bag"), F.lit(1.0).alias("part")))
    out = df.withColumn("_to", F.explode(F.when(bag.isNull(), unknown).otherwise(known)))
    return out.withColumn("bag", F.col("_to.bag")).withColumn(w, F.col(w) * F.col("_to.part")).where(F.col(w) > 0).drop("_to")
