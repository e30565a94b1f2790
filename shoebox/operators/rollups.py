"""Counts, histograms and percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import DONE, FAILED, META, NEW
from .filters import is_video


def counts(media: DataFrame) -> DataFrame:
    """One row: total, indexed (past the first pass), failed, and the progress from 0 to 100: 15 parts metadata, 85 parts analysis."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    raw = media.agg(F.count(F.lit(1)).alias("total"), n(META, DONE, FAILED).alias("indexed"), n(DONE).alias("done"), n(FAILED).alias("failed"), n(NEW).alias("new"))
    share = 100 * (0.15 * F.col("indexed") + 0.85 * (F.col("done") + F.col("failed"))) / F.nullif("total", F.lit(0))
    return raw.withColumn("progress", F.coalesce(F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(100)), F.lit(0)).cast("int"))


def state_counts(media: DataFrame) -> DataFrame:
    """Per kind and together (kind is null): total and each state."""
    kind = F.when(is_video(), "video").otherwise("image").alias("kind")
    names = {NEW: "new", META: "meta", DONE: "done", FAILED: "failed"}
    return media.select(kind, "state").rollup("kind").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("state") == k).alias(v) for k, v in names.items()))


def tag_histogram(tags: DataFrame) -> DataFrame:
    return tags.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label")


def tag_counts(tags: DataFrame, media: DataFrame) -> DataFrame:
    """Per label over accessible items: how many, how many videos, and the least of its sources."""
    rows = tags.join(media.where("is_accessible").select("media_id", is_video().alias("video")), "media_id")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("video").alias("videos"), F.min("source").alias("source"))


def buckets(media: DataFrame, least: int) -> DataFrame:
    """Folders of at least so many items."""
    return media.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_video()).alias("videos")).where(F.col("n") >= least)


def months(media: DataFrame) -> DataFrame:
    """Per month, newest first, how many items and how many come before it in the list; undated items are last, as month null.

    The window runs over months, not items: a few hundred rows whatever the size of the library.
    """
    per = media.groupBy(F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(F.col("month").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return per.select("month", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def selected_bytes(media: DataFrame) -> DataFrame:
    return media.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def reclaimable(groups: DataFrame, media: DataFrame) -> DataFrame:
    """Bytes of what isn't the best of its group."""
    return selected_bytes(groups.where(~F.col("is_best")).join(media.select("media_id", "bytes"), "media_id"))


PERCENTS = (1, 5, 10, 25, 50, 90)


def percentiles(df: DataFrame, col: str, percents: tuple[int, ...] = PERCENTS, parts: int = 200) -> DataFrame:
    """One row per percentile, between neighbours in proportion; no row without values."""
    spans = lambda n: [((n - 1) * p // 100, -(-(n - 1) * p // 100)) for p in percents]
    n, found = _values_at(df, col, lambda n: sorted({k for span in spans(n) for k in span}), parts)
    if not n:
        return found.select(F.lit(0).alias("percent"), "value")
    asked = df.sparkSession.createDataFrame([(p, lo, hi, (n - 1) * p / 100 - lo) for p, (lo, hi) in zip(percents, spans(n), strict=True)], "percent INT, lo BIGINT, hi BIGINT, share DOUBLE")
    low, high = (found.select(F.col("place").alias(k), F.col("value").cast("double").alias(f"v_{k}")) for k in ("lo", "hi"))
    return asked.join(low, "lo").join(high, "hi").select("percent", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("share")).alias("value"))


def percentiles_at(df: DataFrame, col: str, percents: tuple[int, ...] = PERCENTS, parts: int = 200) -> DataFrame:
    """One row per percentile: the value at the place (n - 1) * p / 100, cut to a whole number; no row without values."""
    n, found = _values_at(df, col, lambda n: sorted({(n - 1) * p // 100 for p in percents}), parts)
    asked = df.sparkSession.createDataFrame([(p, (n - 1) * p // 100) for p in percents], "percent INT, place BIGINT")
    return asked.join(found, "place").select("percent", "value")


def _values_at(df: DataFrame, col: str, places: Callable[[int], list[int]], parts: int) -> tuple[int, DataFrame]:
    """(n, (place, value) of the n values in order at some places).

    Values fall into parts between approximate quantiles, which are constants once found; the parts'
    counts tell in which a place lies, and only the distinct values of those parts are ordered, each
    part for itself.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"))
    found = rows.agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 10_000).alias("b")).first().b
    if not found:
        return 0, rows.limit(0).select(F.lit(0).cast("bigint").alias("place"), "value")
    bounds = F.array(*map(F.lit, sorted(set(found))))
    dealt = rows.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("value"))))
    counts = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, wanted = sum(n for _, n in counts), []
    for place in places(total):
        inside = place
        for part, n in counts:
            if inside < n:
                wanted.append((place, part, inside))
                break
            inside -= n
    asked = df.sparkSession.createDataFrame(wanted, "place BIGINT, part INT, inside BIGINT")
    per = dealt.where(F.col("part").isin(sorted({p for _, p, _ in wanted}))).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    run = per.withColumn("last", F.sum("n").over(W.partitionBy("part").orderBy("value")))
    return total, run.join(asked, "part").where((F.col("inside") < F.col("last")) & (F.col("inside") >= F.col("last") - F.col("n"))).select("place", "value")


def mean_vectors(df: DataFrame, key: str, col: str = "embedding") -> DataFrame:
    """(key, vector): the mean of each key's vectors, over its length. Aggregated by place before it moves, so a key of any size fits."""
    means = df.select(key, F.posexplode(col).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select(key, S.unit(F.transform("v", lambda p: p["x"])).alias("vector"))


def kind_notes(media: DataFrame, key: str) -> DataFrame:
    """(key, note): how many photos and videos in words."""
    per = media.groupBy(key).agg(F.count_if(~is_video()).alias("photos"), F.count_if(is_video()).alias("videos"))
    return per.select(key, S.count_note(F.col("photos"), F.col("videos")).alias("note"))
