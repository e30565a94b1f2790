"""New versions of the state tables after a change. Each takes tables and returns the next ones; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DONE, FAILED, META, NEW
from .filters import is_video


def changes(snapshot: DataFrame, known: DataFrame) -> DataFrame:
    """(media_id, change) of a catalogue snapshot(media_id, generation) against what is known: new, changed, gone or same."""
    both = snapshot.select("media_id", F.col("generation").alias("g"), F.lit(True).alias("here")).join(known.select("media_id", F.col("generation").alias("old"), F.lit(True).alias("was")), "media_id", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("here").isNull(), "gone").when(~F.col("g").eqNullSafe(F.col("old")), "changed").otherwise("same")
    return both.select("media_id", change.alias("change"))


def with_discovered(media: DataFrame, found: DataFrame) -> DataFrame:
    """found replaces what is known of an item, but for its state, its analysis, and a date added that it doesn't have; others are new."""
    keep = [c for c in media.columns if c not in found.columns]
    old = media.select("media_id", *(F.col(c).alias(f"old_{c}") for c in media.columns if c != "media_id"), F.lit(True).alias("was"))
    new = found.select("media_id", *(F.col(c).alias(f"new_{c}") for c in found.columns if c != "media_id"), F.lit(True).alias("here"))
    both = old.join(new, "media_id", "full_outer")

    def value(c: str):
        if c == "media_id":
            return F.col(c)
        if c == "state":
            return F.coalesce("old_state", F.lit(NEW)).alias(c)
        if c in keep:
            return F.col(f"old_{c}").alias(c)
        if c == "date_added":
            return F.coalesce("new_date_added", "old_date_added").alias(c)
        return F.when(F.col("here"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)

    return both.select(*map(value, media.columns))


def filled(media: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """Nulls of a column from values(media_id, value); known values stay."""
    return media.join(values.select("media_id", F.col("value").alias("_new")), "media_id", "left").withColumn(col, F.coalesce(col, "_new")).select(*media.columns)


def invalidated(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Items back to the first state, without hash and vector."""
    hit = F.col("_hit").isNotNull()
    rows = media.join(ids.select("media_id").distinct().withColumn("_hit", F.lit(1)), "media_id", "left")
    for c, v in (("state", F.lit(NEW)), ("sha256", F.lit(None)), ("embedding", F.lit(None)), ("fail_count", F.lit(0))):
        rows = rows.withColumn(c, F.when(hit, v.cast(media.schema[c].dataType)).otherwise(F.col(c)))
    return rows.select(*media.columns)


def without(tables: dict[str, DataFrame], ids: DataFrame, survive: tuple[str, ...] = ("user_feedback", "dupe_choice")) -> dict[str, DataFrame]:
    """Every table without the rows of deleted items, but those that survive them."""
    gone = ids.select("media_id").distinct()
    return {k: t if k in survive or "media_id" not in t.columns else t.join(gone, "media_id", "left_anti") for k, t in tables.items()}


def with_access(media: DataFrame, present: DataFrame, policy: str) -> DataFrame:
    """Shows what is present and hides the rest. policy: full, partial or none; with none nothing is to be seen."""
    if policy == "none":
        return media.withColumn("is_accessible", F.lit(False))
    rows = media.join(present.select("media_id").distinct().withColumn("_here", F.lit(1)), "media_id", "left")
    return rows.withColumn("is_accessible", F.col("_here").isNotNull()).select(*media.columns)


def may_delete(policy: str) -> bool:
    """Only a full view of the catalogue tells that an item is gone."""
    return policy == "full"


def with_tags(tags: DataFrame, new: DataFrame, source: str, feedback: DataFrame) -> DataFrame:
    """New tags of a source replace that source's for the items they are of; what the user removed stays away, what the user pinned stays as it is."""
    items = new.select("media_id").distinct()
    pinned = tags.where("source = 'user'").select("media_id", "label")
    removed = feedback.where("verdict = 0").select("media_id", "label")
    add = new.select("media_id", "label", "score", F.lit(source).alias("source")).join(removed, ["media_id", "label"], "left_anti").join(pinned, ["media_id", "label"], "left_anti")
    old = tags.where(F.col("source") == source).join(items, "media_id", "left_anti")
    return tags.where(F.col("source") != source).unionByName(old).unionByName(add)


def after_failures(media: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """failures(media_id, class): encoder failures don't count, undecodable items fail at once, others do at so many attempts."""
    per = failures.groupBy("media_id").agg(F.count_if(F.col("class") == "undecodable").alias("_bad"), F.count_if(~F.col("class").isin("undecodable", "encoder")).alias("_n"))
    rows = media.join(per, "media_id", "left")
    count = F.coalesce("fail_count", F.lit(0)) + F.coalesce("_n", F.lit(0)).cast("int")
    failed = (F.coalesce("_bad", F.lit(0)) > 0) | ((F.coalesce("_n", F.lit(0)) > 0) & (count >= most))
    return rows.withColumn("state", F.when(failed, F.lit(FAILED)).otherwise(F.col("state")).cast("int")).withColumn("fail_count", count).select(*media.columns)


def before_stop(results: DataFrame, most: int = 8, by: tuple[str, ...] = ("worker",)) -> DataFrame:
    """results(by, seq, class) up to where a worker gives up: after `most` encoder failures in a row. class is null for a success; any other result ends a row of failures. by keeps workers apart, each of which orders its own results."""
    order = W.partitionBy(*by).orderBy("seq")
    failed = F.coalesce(F.col("class") == "encoder", F.lit(False))
    runs = results.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(order))
    counted = runs.withColumn("_n", F.sum(F.when(failed, 1).otherwise(0)).over(W.partitionBy(*by, "_run").orderBy("seq")))
    stopped = counted.withColumn("_over", F.max(F.col("_n") >= most).over(order.rowsBetween(W.unboundedPreceding, -1)))
    return stopped.where(~F.coalesce("_over", F.lit(False))).drop("_run", "_n", "_over")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table after rows of the same columns: those of a key that is there replace it, the last written of several is the caller's to choose (latest())."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def with_hashes(media: DataFrame, hashes: DataFrame) -> DataFrame:
    """media with the content hashes of hashes(media_id, sha256); others keep theirs."""
    rows = media.join(hashes.select("media_id", F.col("sha256").alias("_h")), "media_id", "left")
    return rows.withColumn("sha256", F.coalesce("_h", "sha256")).select(*media.columns)


def saved(media: DataFrame, tags: DataFrame, items: DataFrame, new: DataFrame, source: str, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, tags) after analysed items and their tags are written: items replace rows of their id, tags those of the source."""
    return upserted(media, items, ["media_id"]), with_tags(tags, new, source, feedback)


def forgotten(media: DataFrame, stamps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, stamps) without some items at once; the stamp of the groups goes, so that they are made again."""
    return media.join(ids.select("media_id").distinct(), "media_id", "left_anti"), stamps.where("k <> 'groups'")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last row of each key: an upsert of everything at once."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def with_feedback(tags: DataFrame, feedback: DataFrame) -> DataFrame:
    """tags after the user's verdicts: 1 pins a label as the user's, 0 takes it away. The last verdict of an item and label counts."""
    last = latest(feedback, ["media_id", "label"], "ts")
    pinned = last.where("verdict = 1").select("media_id", "label", F.lit(None).cast("float").alias("score"), F.lit("user").alias("source"))
    return tags.join(last.select("media_id", "label"), ["media_id", "label"], "left_anti").unionByName(pinned)


def with_members(items: DataFrame, add: DataFrame) -> DataFrame:
    """Album items after additions: one that is there keeps its time, and takes on a scene."""
    both = items.withColumn("_o", F.lit(0)).unionByName(add.withColumn("_o", F.lit(1)))
    return both.groupBy("album_id", "media_id").agg(F.min_by("added_at", F.struct("_o", "added_at")).alias("added_at"), F.max_by("scene_time_ms", F.when(F.col("scene_time_ms").isNotNull(), F.col("_o"))).alias("scene_time_ms"))


def with_choice(choices: DataFrame, change: DataFrame) -> DataFrame:
    """choices after change(group_key, keep_id, dismissed); what a change leaves null stays."""
    both = choices.select("group_key", F.col("keep_id").alias("k0"), F.col("dismissed").alias("d0")).join(change.select("group_key", F.col("keep_id").alias("k1"), F.col("dismissed").alias("d1")), "group_key", "full_outer")
    return both.select("group_key", F.coalesce("k1", "k0").alias("keep_id"), F.coalesce("d1", "d0", F.lit(False)).alias("dismissed"))


def after_model_change(media: DataFrame, model_id: str, drop_tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(media, tags, one row with how many were invalidated): analysed items of another model lose their vector and wait again; their analysed tags go."""
    stale = (F.col("state") == DONE) & ~F.col("model_id").eqNullSafe(F.lit(model_id))
    hit = media.where(stale).select("media_id")
    out = media.withColumn("_s", stale).withColumn("embedding", F.when(~F.col("_s"), F.col("embedding"))).withColumn("state", F.when(F.col("_s"), F.lit(META)).otherwise(F.col("state"))).drop("_s")
    tags = None if drop_tags is None else drop_tags.where("source <> 'clip'").unionByName(drop_tags.where("source = 'clip'").join(hit, "media_id", "left_anti"))
    return out, tags, hit.agg(F.count(F.lit(1)).alias("invalidated"))


def requeued(media: DataFrame, videos_only: bool = False) -> DataFrame:
    """Analysed items wait for analysis again."""
    hit = F.col("state") == DONE
    hit = hit & is_video() if videos_only else hit
    return media.withColumn("embedding", F.when(~hit, F.col("embedding"))).withColumn("state", F.when(hit, F.lit(META)).otherwise(F.col("state")))


def with_capture_times(media: DataFrame, times: DataFrame) -> DataFrame:
    """Items on file time take times(media_id, taken_at) read from the content, as camera time."""
    rows = media.join(times.select("media_id", F.col("taken_at").alias("_t")), "media_id", "left")
    hit = (F.col("taken_at_source") == "mtime") & F.col("_t").isNotNull()
    return rows.withColumn("taken_at", F.when(hit, F.col("_t")).otherwise(F.col("taken_at"))).withColumn("taken_at_source", F.when(hit, "exif").otherwise(F.col("taken_at_source"))).select(*media.columns)


def stale(stamps: DataFrame, current: dict[str, str]) -> list[str]:
    """Which artefacts are to be built again: those whose stamp(k, v) differs or is missing. One row per artefact kind."""
    have = {r.k: r.v for r in stamps.where(F.col("k").isin(*current)).collect()}
    return sorted(k for k, v in current.items() if have.get(k) != v)
