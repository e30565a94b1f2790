"""Backups: what the user made, with references in place of ids, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMAT, VERSION = "media-backup", 1
SCHEMA = """format STRING, version INT, created_at BIGINT,
    media ARRAY<STRUCT<ref: BIGINT, name: STRING, bytes: BIGINT, taken: BIGINT, path: STRING>>,
    favorites ARRAY<STRUCT<ref: BIGINT, ts: BIGINT>>,
    albums ARRAY<STRUCT<name: STRING, created: BIGINT, items: ARRAY<STRUCT<ref: BIGINT, added: BIGINT, scene: BIGINT>>>>,
    feedback ARRAY<STRUCT<ref: BIGINT, label: STRING, verdict: INT, ts: BIGINT>>"""


def references(favorites: DataFrame, album_items: DataFrame, feedback: DataFrame, media: DataFrame) -> DataFrame:
    """(ref, media_id, name, bytes, taken, path): items that the user's tables name, numbered by first appearance; those without media are out.

    The numbers are given to what a user marked, which is a person's work and not the library.
    """
    uses = favorites.select(F.lit(0).alias("part"), F.struct(F.lit(0).cast("bigint").alias("a"), F.col("ts").alias("b")).alias("pos"), "media_id")
    uses = uses.unionByName(album_items.select(F.lit(1).alias("part"), F.struct(F.col("album_id").alias("a"), F.col("added_at").alias("b")).alias("pos"), "media_id"))
    uses = uses.unionByName(feedback.select(F.lit(2).alias("part"), F.struct(F.lit(0).cast("bigint").alias("a"), F.col("ts").alias("b")).alias("pos"), "media_id"))
    first = uses.groupBy("media_id").agg(F.min(F.struct("part", "pos", "media_id")).alias("first"))
    rows = first.join(media.select("media_id", F.col("display_name").alias("name"), "bytes", F.col("taken_at").alias("taken"), F.col("rel_path").alias("path")), "media_id")
    return rows.select((F.row_number().over(W.orderBy("first")) - 1).cast("bigint").alias("ref"), "media_id", "name", "bytes", "taken", "path")


def encoded(doc: DataFrame) -> DataFrame:
    """doc(created_at, media, favorites, albums, feedback) as one JSON text per row."""
    return doc.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), *doc.columns)).alias("json"))


def decoded(texts: DataFrame, col: str = "json") -> DataFrame:
    """The documents of JSON texts; fails on another format, and on versions below 1 or above ours."""
    doc = texts.select(F.from_json(col, SCHEMA).alias("d")).select("d.*")
    bad = ~F.col("format").eqNullSafe(F.lit(FORMAT)) | F.col("version").isNull() | (F.col("version") < 1) | (F.col("version") > VERSION)
    return doc.withColumn("version", F.when(bad, F.raise_error(F.lit("not a backup that can be read"))).otherwise(F.col("version")))


def resolved(refs: DataFrame, media: DataFrame) -> DataFrame:
    """(ref, media_id) of accessible media by name, bytes and time; of several candidates only one with the same path will do. No name matches nothing; unknown times are equal."""
    known = media.where("is_accessible").select("media_id", F.col("display_name").alias("m_name"), F.col("bytes").alias("m_bytes"), F.col("taken_at").alias("m_taken"), F.col("rel_path").alias("m_path"))
    pairs = refs.select("ref", "name", "bytes", "taken", "path").join(known, (F.col("name") == F.col("m_name")) & F.col("bytes").eqNullSafe(F.col("m_bytes")) & F.col("taken").eqNullSafe(F.col("m_taken")))
    per = pairs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("media_id").alias("any"), F.count_if(F.col("path").eqNullSafe(F.col("m_path"))).alias("n_path"), F.min(F.when(F.col("path").eqNullSafe(F.col("m_path")), F.col("media_id"))).alias("same"))
    found = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_path") == 1, F.col("same"))
    return per.select("ref", found.alias("media_id")).where("media_id IS NOT NULL")


def restored(doc: DataFrame, links: DataFrame, favorites: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(favorites, feedback, unmatched refs) after a document's rows: favourites that are there stay, verdicts are replaced."""
    fav = doc.select(F.explode("favorites").alias("f")).select("f.*").join(links, "ref").select("media_id", "ts")
    favorites = favorites.unionByName(fav.join(favorites.select("media_id"), "media_id", "left_anti").groupBy("media_id").agg(F.min("ts").alias("ts")))
    told = doc.select(F.explode("feedback").alias("f")).select("f.*").join(links, "ref").select("media_id", "label", "verdict", "ts")
    feedback = feedback.join(told.select("media_id", "label"), ["media_id", "label"], "left_anti").unionByName(told)
    missing = doc.select(F.explode("media").alias("m")).select("m.ref").join(links, "ref", "left_anti")
    return favorites, feedback, missing


def restored_tags(doc: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """tags after a document's verdicts: 1 makes the label the user's own, 0 takes it away."""
    from .state import with_feedback

    told = doc.select(F.explode("feedback").alias("f")).select("f.*").join(links, "ref")
    return with_feedback(tags, told.select("media_id", "label", "verdict", "ts"))


def restored_albums(doc: DataFrame, links: DataFrame, albums: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(albums, items): an album of the same name and time of creation is the same; a new one gets the next id."""
    read = doc.select(F.explode("albums").alias("a")).select("a.name", F.col("a.created").alias("created_at"), "a.items")
    have = read.join(albums, ["name", "created_at"], "left").select("id", "name", "created_at", "items")
    top = albums.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = have.where("id IS NULL").crossJoin(F.broadcast(top))  # one row
    new = new.withColumn("id", F.col("top") + F.row_number().over(W.orderBy("created_at", "name"))).drop("top")
    placed = have.where("id IS NOT NULL").unionByName(new)
    add = placed.select(F.col("id").alias("album_id"), F.explode("items").alias("i")).select("album_id", "i.*").join(links, "ref").select("album_id", "media_id", F.col("added").alias("added_at"), F.col("scene").alias("scene_time_ms"))
    from .state import with_members

    return albums.unionByName(new.select("id", "name", "created_at")), with_members(items, add)
