"""Small projections that others ask for: ids, times, labels and the inputs of other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FAILED
from .filters import is_video


def generations(media: DataFrame) -> DataFrame:
    return media.select("media_id", "generation")


def accessible_ids(media: DataFrame) -> DataFrame:
    return media.where("is_accessible").select("media_id")


def duration(media: DataFrame, item: int) -> DataFrame:
    """(duration_ms) of one item; no row for an unknown one."""
    return media.where(F.col("media_id") == item).select("duration_ms")


def frames_of_item(frames: DataFrame, item: int) -> DataFrame:
    """(time_ms, embedding) of one item, in order; its frames are at most Params.max_frames."""
    return frames.where(F.col("media_id") == item).select("time_ms", "embedding").orderBy("time_ms")


def with_frames(frames: DataFrame) -> DataFrame:
    """media_id of the items that have frames."""
    return frames.select("media_id").distinct()


def on_file_time(media: DataFrame) -> DataFrame:
    """Accessible items whose time is still the file's."""
    return media.where(F.col("is_accessible") & (F.col("taken_at_source") == "mtime")).select("media_id")


def labels(tags: DataFrame, source: str | None = None) -> DataFrame:
    """The distinct labels, of one source where given."""
    return (tags if source is None else tags.where(F.col("source") == source)).select("label").distinct()


def favorite_ids(favorites: DataFrame) -> DataFrame:
    return favorites.select("media_id").distinct()


def scenes_of_album(album_items: DataFrame, album: int) -> DataFrame:
    """(media_id, scene_time_ms) of an album's items that are scenes of videos."""
    return album_items.where((F.col("album_id") == album) & F.col("scene_time_ms").isNotNull()).select("media_id", "scene_time_ms")


def choices_of(choices: DataFrame, groups: DataFrame) -> DataFrame:
    """The user's choices about the groups that there are."""
    return choices.join(groups.select(F.col("key").alias("group_key")).distinct(), "group_key", "left_semi")


def kind_counts(media: DataFrame) -> DataFrame:
    """(kind, n) of accessible items."""
    return media.where("is_accessible").groupBy(F.when(is_video(), "video").otherwise("image").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# inputs of other operators


def search_vectors(media: DataFrame) -> DataFrame:
    """(media_id, embedding) of what can be found by its vector: accessible, not failed, analysed."""
    return media.where(F.col("is_accessible") & (F.col("state") != FAILED) & F.col("embedding").isNotNull()).select("media_id", "embedding")


def grouping_items(media: DataFrame) -> DataFrame:
    """What grouping reads of accessible items."""
    return media.where("is_accessible").select("media_id", "media_kind", "display_name", "sha256", "taken_at", "taken_at_source", "blur_score", "embedding")


def event_items(media: DataFrame, tags: DataFrame) -> DataFrame:
    """(media_id, taken_at, gps_lat, gps_lon, blur_score, labels): accessible items with a time, and their analysed labels in order, empty where there are none."""
    own = tags.where("source = 'clip'").groupBy("media_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = media.where(F.col("is_accessible") & F.col("taken_at").isNotNull()).select("media_id", "taken_at", "gps_lat", "gps_lon", "blur_score")
    return rows.join(own, "media_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
