"""Hybrid search: a parsed query's filters first, then ranking by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters, geo, vectors
from ..params import Params
from .parser import Query


def allowed(query: Query, media: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Visible media within the query's times, hours, kind and any of its places."""
    rows = filters.of_kind(filters.visible(media), query.media or "all")
    if query.start is not None or query.end is not None:
        rows = filters.taken_between(rows, query.start, query.end)
    if query.hours is not None:
        rows = filters.in_hours(rows, *query.hours)
    if query.places and places is not None:
        near = geo.within(filters.located(rows).select("media_id", "gps_lat", "gps_lon"), places.where(F.col("name").isin(query.places)))
        rows = filters.with_ids(rows, near)
    return rows


def ranked(rows: DataFrame, frames: DataFrame | None, vector: list[float] | None, k: int, params: Params) -> DataFrame:
    """(media_id, pos, score, scenes): newest first without a vector, else photos by their own and videos by their best frame's score."""
    if vector is None:
        first = filters.newest(rows).limit(k).select("media_id", "taken_at", F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<struct<time_ms:bigint,score:double>>").alias("scenes"))
        order = [F.col("taken_at").desc_nulls_last(), F.col("media_id").desc()]
    else:
        # the k best of each kind hold the k best of all
        first = vectors.top_k(rows.where(~filters.is_video()).select("media_id", "embedding"), vector, k).withColumn("scenes", F.lit(None).cast("array<struct<time_ms:bigint,score:double>>"))
        if frames is not None:
            own = frames.join(rows.where(filters.is_video()).select("media_id"), "media_id", "left_semi")
            hits = vectors.scored(own, vector).select("media_id", F.col("time_ms").cast("bigint").alias("time_ms"), "score")
            best = hits.groupBy("media_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "media_id").limit(k)
            scenes = vectors.spaced_scenes(hits.join(best.select("media_id"), "media_id", "left_semi"), params.scenes_per_video, params.scene_gap_ms)
            first = first.unionByName(best.join(scenes, "media_id").select("media_id", "score", "scenes"))
        order = [F.col("score").desc(), F.col("media_id")]
    # at most 2 k rows are numbered
    return first.withColumn("pos", F.row_number().over(W.orderBy(*order)) - 1).where(F.col("pos") < k).select("media_id", "pos", "score", "scenes")


def search(query: Query, media: DataFrame, tags: DataFrame, frames: DataFrame | None, vector: list[float] | None, places: DataFrame | None = None, tag_vector: list[float] | None = None, params: Params | None = None) -> DataFrame:
    """(section, media_id, pos, score, scenes): `close` results, and `other` ones where tags were asked for.

    With tags, close is what has all of them; other ranks the rest by the text with the tags' words
    (tag_vector). Without, close is cut where scores fall off and the rest of the list is other.
    """
    p = params or Params()
    base = allowed(query, media, places)
    if not query.tags:
        rows = ranked(base, frames, vector if query.text else None, p.close_limit, p)
        if vector is None or not query.text:
            return rows.select(F.lit("close").alias("section"), "*")
        # the ranking, of at most close_limit rows, is in one task already
        whole = W.partitionBy(F.lit(0))
        near = rows.withColumn("best", F.max("score").over(whole)).withColumn("near", F.count_if(F.col("best") - F.col("score") <= p.relevance_window).over(whole))
        close = F.least(F.greatest("near", F.lit(1)), F.lit(p.relevance_max))
        return near.select(F.when(F.col("pos") < close, "close").otherwise("other").alias("section"), "media_id", "pos", "score", "scenes")
    own = filters.tagged_with_all(tags, query.tags)
    close = ranked(filters.with_ids(base, own), frames, vector if query.text else None, p.close_limit, p)
    out = close.select(F.lit("close").alias("section"), "*")
    if tag_vector is None:
        return out
    rest = ranked(filters.without_ids(base, own), frames, tag_vector, p.other_limit, p)
    return out.unionByName(rest.select(F.lit("other").alias("section"), "*"))
