"""Predicates, projections, orders and pages over the media table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import META


def visible(media: DataFrame) -> DataFrame:
    """Accessible and past the first pass. States of failed items count as past it, as they always have."""
    return media.where(F.col("is_accessible") & (F.col("state") >= META))


def is_video() -> Column:
    """By the kind; rows without one by the sign of the id."""
    return F.coalesce(F.col("media_kind") == "video", F.col("media_id") < 0)


def of_kind(media: DataFrame, kind: str = "all") -> DataFrame:
    """kind: all, image or video."""
    return media if kind == "all" else media.where(is_video() if kind == "video" else ~is_video())


def with_ids(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose media_id is in ids(media_id); Spark broadcasts the list when it is small."""
    return media.join(ids.select("media_id").distinct(), "media_id", "left_semi")


def without_ids(media: DataFrame, ids: DataFrame) -> DataFrame:
    return media.join(ids.select("media_id").distinct(), "media_id", "left_anti")


def in_order_of(media: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows of ranked(media_id, pos) with their media, in the caller's order."""
    return media.join(ranked.select("media_id", "pos"), "media_id").orderBy("pos")


def tagged_with_all(tags: DataFrame, labels: list[str]) -> DataFrame:
    """media_id of items that have every one of the labels; without labels none."""
    wanted = sorted(set(labels))
    hits = tags.where(F.col("label").isin(wanted)).groupBy("media_id").agg(F.countDistinct("label").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("media_id")


def tagged(tags: DataFrame, label: str) -> DataFrame:
    return tags.where(F.col("label") == label).select("media_id").distinct()


def taken_between(media: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends count; either can be open; undated items are out."""
    out = media.where("taken_at IS NOT NULL")
    if start is not None:
        out = out.where(F.col("taken_at") >= start)
    return out if end is None else out.where(F.col("taken_at") <= end)


def newest_between(media: DataFrame, start: int, end: int, n: int) -> DataFrame:
    return newest(taken_between(media, start, end)).limit(n)


def on_this_day(media: DataFrame, month_day: str, before_year: int) -> DataFrame:
    """Items of earlier years on MM-dd whose time comes from the camera."""
    at = F.timestamp_seconds("taken_at")
    return media.where((F.col("taken_at_source") == "exif") & (F.date_format(at, "MM-dd") == month_day) & (F.year(at) < before_year))


def in_hours(media: DataFrame, first: int, last: int) -> DataFrame:
    """By the hour of day; 20 to 29 runs over midnight to 5."""
    return media.where(F.hour(F.timestamp_seconds("taken_at")).isin(sorted({h % 24 for h in range(first, last + 1)})))


def blurry(media: DataFrame, threshold: float, n: int = 500) -> DataFrame:
    """The least sharp photos below a threshold; a threshold of 0 or less suggests nothing. n is the report's length."""
    out = media.where(~is_video() & (F.col("blur_score") < threshold)) if threshold > 0 else media.where(F.lit(False))
    return out.orderBy("blur_score", "media_id").limit(n)


def low_quality(media: DataFrame, dark: float, bright: float, min_side: int, n: int = 500) -> DataFrame:
    """Too dark, too bright or too small, largest files first. An unknown side makes no item small."""
    longer = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.greatest("width", "height"))
    bad = (F.col("brightness") < dark) | (F.col("brightness") > bright) | (longer < min_side)
    return media.where(bad).orderBy(F.col("bytes").desc_nulls_last(), "media_id").limit(n)


def located(media: DataFrame) -> DataFrame:
    return media.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL")


def without_labels(tags: DataFrame, hidden: list[str]) -> DataFrame:
    return tags.where(~F.col("label").isin(hidden)) if hidden else tags


def card(media: DataFrame) -> DataFrame:
    """media_id, name, taken (text, or unknown), size (WxH)."""
    at = F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM-dd HH:mm")
    return media.select("media_id", S.basename(F.concat_ws("/", "rel_path", "display_name")).alias("name"), F.coalesce(at, F.lit("unknown")).alias("taken"), F.concat_ws("x", "width", "height").alias("size"))


def detail(media: DataFrame, tags: DataFrame) -> DataFrame:
    """Each item with its tags as a sorted array, empty where there are none."""
    own = tags.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("label", "score", "source"))).alias("tags"))
    return media.join(own, "media_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast(own.schema["tags"].dataType)))


# orders and pages

ORDERS = {"date": "taken_at", "added": "date_added", "size": "bytes"}


def newest(media: DataFrame) -> DataFrame:
    return media.orderBy(F.col("taken_at").desc_nulls_last(), F.col("media_id").desc())


def oldest(media: DataFrame) -> DataFrame:
    return media.orderBy(F.col("taken_at").asc_nulls_last(), F.col("media_id").asc())


def page(media: DataFrame, order: str = "date", limit: int = 300, offset: int = 0) -> DataFrame:
    """One page of a gallery; the id breaks ties, so pages neither repeat nor miss an item."""
    return media.orderBy(F.col(ORDERS[order]).desc_nulls_last(), F.col("media_id").desc()).offset(offset).limit(limit)


def after(media: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next rows by id: a page that needs no offset."""
    return media.where(F.col("media_id") > cursor).orderBy("media_id").limit(limit)


def pending(media: DataFrame, states: list[int], limit: int, cursor: int | None = None) -> DataFrame:
    rows = media.where(F.col("state").isin(states))
    return after(rows, -(1 << 62) if cursor is None else cursor, limit)


# sets of ids


def all_of(*ids: DataFrame) -> DataFrame:
    out = ids[0].select("media_id").distinct()
    for more in ids[1:]:
        out = out.join(more.select("media_id").distinct(), "media_id", "left_semi")
    return out


def any_of(*ids: DataFrame) -> DataFrame:
    out = ids[0].select("media_id")
    for more in ids[1:]:
        out = out.unionByName(more.select("media_id"))
    return out.distinct()


def rest_of(base: DataFrame, taken: DataFrame) -> DataFrame:
    return base.select("media_id").distinct().join(taken, "media_id", "left_anti")


def toggled(selected: Column, ids: Column) -> Column:
    """All of ids leave an array if all are in it, else all join it."""
    return F.when(F.size(F.array_except(ids, selected)) == 0, F.array_except(selected, ids)).otherwise(F.array_union(selected, ids))
