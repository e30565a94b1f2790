"""Album lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import is_video, of_kind

#: Order of the kinds in the list.
KINDS = ("user", "folder", "tag", "event")
MOMENT = "moment"


def albums(media: DataFrame, tags: DataFrame, favorites: DataFrame, user_albums: DataFrame, album_items: DataFrame, event_items: DataFrame, kind: str = "all", min_folder: int = 3, hidden: tuple[str, ...] = (), max_events: int = 60) -> DataFrame:
    """(kind, key, name, n, videos, cover_ids, place) of favourites, user albums, folders, tags and the newest events.

    Counts are of visible items of the asked kind; albums of the user that are empty stay where all
    kinds are asked for. max_events is the length of that part of the list.
    """
    seen = of_kind(media.where("is_accessible"), kind).select("media_id", "bucket", "taken_at", is_video().alias("video"))
    members = [
        favorites.select(F.lit("user").alias("kind"), F.lit("favorites").alias("key"), F.lit("favorites").alias("name"), F.lit(0).alias("rank"), "media_id"),
        album_items.join(user_albums, album_items.album_id == user_albums.id).select(F.lit("user").alias("kind"), F.col("album_id").cast("string").alias("key"), "name", F.lit(1).alias("rank"), "media_id"),
        seen.where("bucket IS NOT NULL").select(F.lit("folder").alias("kind"), F.col("bucket").alias("key"), F.col("bucket").alias("name"), F.lit(0).alias("rank"), "media_id"),
        (tags.where(~F.col("label").isin(*hidden)) if hidden else tags).select(F.lit("tag").alias("kind"), F.col("label").alias("key"), F.col("label").alias("name"), F.lit(0).alias("rank"), "media_id").distinct(),
        event_items.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("key"), F.coalesce("title", F.lit("")).alias("name"), F.lit(0).alias("rank"), "media_id"),
    ]
    rows = members[0]
    for m in members[1:]:
        rows = rows.unionByName(m)
    rows = rows.join(seen.select("media_id", "taken_at", "video"), "media_id")
    key = ["kind", "key"]
    per = rows.groupBy(*key).agg(F.min("name").alias("name"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.count_if("video").alias("videos"), F.max("taken_at").alias("last"))
    per = per.where((F.col("kind") != "folder") | (F.col("n") >= min_folder))
    newest = W.partitionBy(*key).orderBy(F.col("taken_at").desc_nulls_last(), F.col("media_id").desc())
    covers = rows.withColumn("place", F.row_number().over(newest)).where("place <= 3").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "media_id"))).alias("c")).select(*key, F.col("c.media_id").alias("cover_ids"))
    out = per.join(covers, key)
    events = out.where("kind = 'event'").orderBy(F.col("last").desc_nulls_last(), "key").limit(max_events)
    out = out.where("kind <> 'event'").unionByName(events)
    if kind == "all":
        empty = user_albums.select(F.lit("user").alias("kind"), F.col("id").cast("string").alias("key"), "name").join(out.select(*key), key, "left_anti")
        out = out.unionByName(empty.withColumn("rank", F.lit(1)).withColumn("n", F.lit(0).cast("bigint")).withColumn("videos", F.lit(0).cast("bigint")).withColumn("cover_ids", F.array().cast("array<bigint>")), allowMissingColumns=True)
    place = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        place = F.when(F.col("kind") == name, k).otherwise(place)
    return out.select("kind", "key", "name", "n", "videos", "cover_ids", place.alias("place"), "rank")


def in_list_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("place", "rank", F.col("n").desc(), "name", "key")


def with_axis(rows: DataFrame, axes: DataFrame, parents: DataFrame) -> DataFrame:
    """rows(name) with axis: that of the label, else that of its parent, else moment. axes(label, axis), parents(label, parent)."""
    own = axes.select(F.col("label").alias("name"), F.col("axis").alias("own_axis"))
    up = parents.join(axes.select(F.col("label").alias("parent"), F.col("axis").alias("parent_axis")), "parent").select(F.col("label").alias("name"), "parent_axis")
    return rows.join(own, "name", "left").join(up, "name", "left").withColumn("axis", F.coalesce("own_axis", "parent_axis", F.lit(MOMENT))).drop("own_axis", "parent_axis")


def frequent_tags(rows: DataFrame, n: int = 4) -> DataFrame:
    return in_list_order(rows.where("kind = 'tag'")).limit(n)


def album_members(kind: str, key: str, media: DataFrame, tags: DataFrame, favorites: DataFrame, album_items: DataFrame, event_items: DataFrame) -> DataFrame:
    """The visible items of one album."""
    ids = {
        "tag": lambda: tags.where(F.col("label") == key),
        "folder": lambda: media.where(F.col("bucket") == key),
        "event": lambda: event_items.where(F.col("event_id") == int(key)),
        "user": lambda: favorites if key == "favorites" else album_items.where(F.col("album_id") == int(key)),
    }[kind]()
    return media.where("is_accessible").join(ids.select("media_id").distinct(), "media_id", "left_semi")


def saved_search(ranked: DataFrame, close: int, album_id: int, now: int, selected: DataFrame | None = None) -> DataFrame:
    """Album items from the first `close` results of ranked(media_id, pos, scene_time_ms), of the selected ones where given."""
    rows = ranked.where(F.col("pos") < close)
    if selected is not None:
        rows = rows.join(selected.select("media_id").distinct(), "media_id", "left_semi")
    return rows.select(F.lit(album_id).cast("bigint").alias("album_id"), "media_id", F.lit(now).cast("bigint").alias("added_at"), "scene_time_ms")
