"""Metrics of classification and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNCLASSIFIED = "미분류"


def _share(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_label(pairs: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 from pairs(item_id, truth, predicted array): a label is given if it is anywhere in the array."""
    truth = pairs.select("item_id", F.col("truth").alias("label"), F.lit(1).alias("t"))
    given = pairs.select("item_id", F.explode(F.array_distinct("predicted")).alias("label"), F.lit(1).alias("g"))
    both = truth.join(given, ["item_id", "label"], "full_outer")
    t, g = F.col("t").isNotNull(), F.col("g").isNotNull()
    n = both.groupBy("label").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(t).alias("in_truth")).where("in_truth > 0").drop("in_truth")
    n = n.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _share(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(pairs: DataFrame) -> DataFrame:
    """One row: accuracy of the first prediction, share of items with a label, mean number of labels."""
    first = F.get("predicted", F.lit(0))
    return pairs.agg(F.avg((F.coalesce(first, F.lit(UNCLASSIFIED)) == F.col("truth")).cast("double")).alias("accuracy"), F.avg((F.coalesce(first, F.lit(UNCLASSIFIED)) != UNCLASSIFIED).cast("double")).alias("coverage"), F.avg(F.size("predicted").cast("double")).alias("mean_tags"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """truth x first prediction, a column per label and one for unclassified."""
    first = F.coalesce(F.get("predicted", F.lit(0)), F.lit(UNCLASSIFIED)).alias("first")
    return pairs.select("truth", first).groupBy("truth").pivot("first", [*labels, UNCLASSIFIED]).agg(F.count(F.lit(1))).na.fill(0)


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """(query, p): share of right ones among the first k of ranked(query, media_id, score, right)."""
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "media_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= k).groupBy("query").agg((F.count_if("right") / k).alias("p"))
