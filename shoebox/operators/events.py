"""Events (sessions of items), days, memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import is_video, on_this_day, taken_between
from .runs import with_runs


def sessions(media: DataFrame, gap_hours: float, split_km: float = 0.0, by: tuple[str, ...] = (), camera_only: bool = True) -> DataFrame:
    """media with event_no: a new one where the time since the item before exceeds the gap, or the way does.

    The way counts where both items have a place and split_km is above 0. camera_only leaves out
    items whose time isn't the camera's. by: columns that keep libraries apart; without them all
    items are one ordered list.
    """
    rows = media.where("taken_at IS NOT NULL")
    if camera_only:
        rows = rows.where(F.col("taken_at_source") == "exif")

    def starts(prior: Column) -> Column:
        new = F.col("taken_at") - prior["taken_at"] > int(gap_hours * 3600)
        if split_km > 0:
            way = S.haversine_km(prior["gps_lat"], prior["gps_lon"], F.col("gps_lat"), F.col("gps_lon"))
            new = new | F.coalesce(way > split_km, F.lit(False))
        return new

    return with_runs(rows, starts, "event_no", by, carry=("gps_lat", "gps_lon"))


def rollup(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per event of sessions(): times, mean place of the items that have one, count. Which items are in it is told by members()."""
    both = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    return items.groupBy(*by, "event_no").agg(
        F.min("taken_at").alias("started_at"),
        F.max("taken_at").alias("ended_at"),
        F.avg(F.when(both, F.col("gps_lat"))).alias("lat"),
        F.avg(F.when(both, F.col("gps_lon"))).alias("lon"),
        F.count(F.lit(1)).alias("n"),
    )


def members(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event_no, taken_at, media_id): the items of each event of sessions(), a row each, as an event can have any number."""
    return items.select(*by, "event_no", "taken_at", "media_id")


def sharpest_covers(items: DataFrame, key: tuple[str, ...], n: int = 3) -> DataFrame:
    """(key, media_id, place): the n sharpest of each group."""
    order = W.partitionBy(*key).orderBy(F.coalesce("blur_score", F.lit(0.0)).desc(), "media_id")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(*key, "media_id", "place")


def diverse_covers(items: DataFrame, key: tuple[str, ...], n: int = 3, max_cosine: float = 0.9) -> DataFrame:
    """(key, cover_ids): sharpest first, passing over what is too like a cover already; then filled up by sharpness.

    One aggregate for each of the n covers: the sharpest of what is left beside those chosen, so a
    group's items are never gathered. Ties go to the earlier item, then the lower id.
    """
    rows = items.select(F.struct(*key).alias("_key"), F.struct((-F.coalesce("blur_score", F.lit(0.0))).alias("order"), "taken_at", "media_id").alias("place"), "embedding")
    best = lambda df: df.groupBy("_key").agg(F.min_by(F.struct(F.col("place.media_id").alias("media_id"), "embedding"), "place").alias("found"))
    chosen = best(rows).select("_key", F.array("found").alias("covers"))
    for _ in range(n - 1):
        left = rows.join(chosen, "_key")
        alike = F.exists("covers", lambda c: (c["media_id"] == F.col("place.media_id")) | F.coalesce(S.dot(c["embedding"], F.col("embedding")) >= max_cosine, F.lit(False)))
        more = best(left.where(~alike)).select("_key", "found")
        chosen = chosen.join(more, "_key", "left").select("_key", F.when(F.col("found").isNull(), F.col("covers")).otherwise(F.concat("covers", F.array("found"))).alias("covers"))
    sharpest = rows.withColumn("r", F.row_number().over(W.partitionBy("_key").orderBy("place"))).where(F.col("r") <= 2 * n)
    sharpest = sharpest.groupBy("_key").agg(F.array_sort(F.collect_list("place")).alias("sharpest"))
    ids = F.col("covers.media_id")
    covers = F.slice(F.concat(ids, F.array_except(F.col("sharpest.media_id"), ids)), 1, n)
    return chosen.join(sharpest, "_key").select("_key.*", covers.alias("cover_ids"))


def top_labels(items: DataFrame, tags: DataFrame, key: tuple[str, ...], n: int = 2) -> DataFrame:
    """(key, label, n, place): the most frequent labels of each group; ties by label."""
    per = items.select(*key, "media_id").join(tags.select("media_id", "label"), "media_id").groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(F.col("n").desc(), "label"))).where(F.col("place") <= n)


def titles(events: DataFrame, items: DataFrame, tags: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """events with title: day · place · the two most frequent analysed labels, or how many photos. Uses place_name where events have it."""
    labels = top_labels(items, tags.where(F.col("source") == "clip"), key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "label", "n"))).alias("l"))
    at = F.timestamp_seconds("started_at")
    day = F.format_string("%d월 %d일", F.month(at), F.day(at))
    place = F.nullif(F.trim("place_name"), F.lit("")) if "place_name" in events.columns else F.lit(None).cast("string")
    words = F.array_join(F.transform("l", lambda x: F.concat(x["label"], F.lit(" "), x["n"].cast("string"), F.lit("장"))), ", ")
    what = F.coalesce(words, F.concat(F.lit("사진 "), F.col("n").cast("string"), F.lit("장")))
    return events.join(labels, list(key), "left").withColumn("title", F.concat_ws(" · ", day, place, what)).drop("l")


def titles_in_two_phases(media: DataFrame, tags: DataFrame, gap_hours: float, split_km: float = 0.0, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events by metadata alone, events with what analysis found): the first can be shown before any item has been analysed, and both have the same events."""
    items, key = sessions(media, gap_hours, split_km, by), (*by, "event_no")
    found = rollup(items, by)
    return titles(found, items, tags.limit(0), key), titles(found, items, tags, key)


def event_counts(event_items: DataFrame, media: DataFrame) -> DataFrame:
    """(event_id, n, videos) of events that still have accessible items."""
    return event_items.join(media.where("is_accessible").select("media_id", is_video().alias("video")), "media_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("video").alias("videos"))


def timeline(events: DataFrame) -> DataFrame:
    """Newest first: span and place as text."""
    text = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm")
    out = events.withColumn("span", F.concat_ws(" – ", text("started_at"), text("ended_at"))).withColumn("gps", F.when(F.col("lat").isNotNull(), F.format_string("%.4f, %.4f", "lat", "lon")))
    return out.orderBy(F.col("started_at").desc())


def days(media: DataFrame, today: str, small: int = 3, gap: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(newest, oldest, n) of days as listed: small neighbouring days of a month stand together.

    Two days do if each has at most `small` items, they are at most `gap` days apart in one month, and
    neither is today or yesterday. Each condition is on neighbours, so it is one pass over distinct
    days. Undated items are a row of their own.
    """
    per = media.groupBy(*by, F.to_date(F.timestamp_seconds("taken_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*by).orderBy(F.col("day").desc_nulls_last())
    prior, n_prior = F.lag("day").over(order), F.lag("n").over(order)
    near = lambda d: d.isin(F.to_date(F.lit(today)), F.date_sub(F.to_date(F.lit(today)), 1))
    joins = (n_prior <= small) & (F.col("n") <= small) & (F.datediff(prior, "day") <= gap) & (F.date_format(prior, "yyyy-MM") == F.date_format("day", "yyyy-MM")) & ~near(prior) & ~near(F.col("day"))
    spans = per.withColumn("span", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    return spans.groupBy(*by, "span").agg(F.max("day").alias("newest"), F.min("day").alias("oldest"), F.sum("n").alias("n"))


def memories(media: DataFrame, today: str, least: int = 3) -> DataFrame:
    """(memory, media_id): the last seven days, and this day of each earlier year, where there are enough items."""
    day = F.to_date(F.lit(today))
    end = F.unix_seconds(F.date_add(day, 1).cast("timestamp")) - 1
    week = media.where((F.col("taken_at") > end - 7 * 86400) & (F.col("taken_at") <= end)).select(F.lit("week").alias("memory"), "media_id")
    past = on_this_day(media, today[5:], int(today[:4])).select(F.date_format(F.timestamp_seconds("taken_at"), "yyyy").alias("memory"), "media_id")
    rows = week.unionByName(past)
    enough = rows.groupBy("memory").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("memory")
    return rows.join(enough, "memory", "left_semi")


__all__ = ["days", "diverse_covers", "event_counts", "members", "memories", "rollup", "sessions", "sharpest_covers", "taken_between", "timeline", "titles", "top_labels"]
