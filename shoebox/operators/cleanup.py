"""The cleanup report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, grouping, rollups


def report(media: DataFrame, groups: DataFrame, blur: float, dark: float, bright: float, min_side: int) -> DataFrame:
    """(section, media_id, detail): blurry and poor items, copies with their group's key, and a row of what deleting all but the best would free."""
    blurry = filters.blurry(media, blur).select(F.lit("blurry").alias("section"), "media_id", F.col("blur_score").cast("string").alias("detail"))
    poor = filters.low_quality(media, dark, bright, min_side).select(F.lit("low quality").alias("section"), "media_id", F.col("bytes").cast("string").alias("detail"))
    copies = grouping.readable(groups, media).select(F.lit("copies").alias("section"), "media_id", F.col("key").alias("detail"))
    freed = rollups.reclaimable(groups, media).select(F.lit("reclaimable").alias("section"), F.lit(None).cast("bigint").alias("media_id"), F.col("bytes").cast("string").alias("detail"))
    return blurry.unionByName(poor).unionByName(copies).unionByName(freed)


def trashed(wanted: DataFrame, groups: DataFrame, failures: DataFrame) -> DataFrame:
    """(media_id, result, error) for each wanted item: `kept` by the guard, `failed` where failures(media_id, error) has it, else `deleted`."""
    told = grouping.keep_one(wanted, groups).join(failures.groupBy("media_id").agg(F.min("error").alias("why")), "media_id", "left")
    result = F.when(F.col("action") == "keep", "kept").when(F.col("why").isNotNull(), "failed").otherwise("deleted")
    return told.select("media_id", result.alias("result"), F.when(result == "failed", F.col("why")).alias("error"))


def trash(wanted: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to delete, kept) after the guard that leaves one of each group."""
    told = grouping.keep_one(wanted, groups)
    return told.where("action = 'delete'").select("media_id"), told.where("action = 'keep'").select("media_id")
