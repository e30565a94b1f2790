"""Groups of copies and bursts, and the guard that keeps one of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import is_video
from .runs import joined_back, with_runs


def hash_candidates(media: DataFrame) -> DataFrame:
    """Items that share bytes, width and height with another; only they need a content hash. Unknown values share with none."""
    keys = ["bytes", "width", "height"]
    known = media.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    several = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return known.join(several, keys, "left_semi")


def exact_groups(media: DataFrame, markers: tuple[str, ...] = S.COPY_MARKERS) -> DataFrame:
    """(kind, key, media_id, is_best) of items with one hash; the best has the least origin rank, then the least id.

    The best of each hash is an aggregate that is joined back in parts, so a hash of any number of
    items is not gathered in one task.
    """
    rows = media.where("sha256 IS NOT NULL").select("media_id", "sha256", S.origin_rank(F.col("display_name"), markers).alias("rank"))
    best = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "media_id")).alias("best"), F.min("media_id").alias("least")).where("n > 1")
    out = joined_back(rows, best, "sha256")
    return out.select(F.lit("EXACT").alias("kind"), F.concat(F.lit("EXACT:"), F.col("least").cast("string")).alias("key"), "media_id", (F.col("media_id") == F.col("best.media_id")).alias("is_best"))


def burst_groups(media: DataFrame, exact: DataFrame, similarity: float, gap_sec: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(kind, key, media_id, is_best) of photos in quick succession that look like the first of their run.

    Photos with a camera's time are cut where the gap to the one before exceeds gap_sec; each stretch
    is folded in order, one photo at a time: a photo joins the run while its cosine to the run's head is at least
    `similarity`, else it heads a new run. A run with a member in an exact group is dropped whole.
    The best is the sharpest, then the first. by: columns that keep libraries apart, e.g. the owner.
    """
    rows = media.where((F.col("taken_at_source") == "exif") & ~is_video() & F.col("taken_at").isNotNull() & F.col("embedding").isNotNull())
    rows = with_runs(rows, lambda prior: F.col("taken_at") - prior["taken_at"] > gap_sec, "stretch", by)
    keys = [*by, "stretch"]
    ordered = rows.select(*keys, "taken_at", "media_id", F.coalesce("blur_score", F.lit(0.0)).alias("blur"), "embedding").repartition(*keys).sortWithinPartitions(*keys, "taken_at", "media_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row after row: all that is held of a stretch is the head of its run."""
        now, head, run, pos = None, None, 0, 0
        for batch in batches:
            owner = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            runs, places = [], []
            for key, vector in zip(owner, batch["embedding"].to_pylist(), strict=True):
                v = np.asarray(vector, np.float64)
                if key != now:
                    now, head, run, pos = key, v, 0, 0
                elif not (len(head) == len(v) and float(head @ v) >= similarity):
                    head, run = v, run + 1
                runs.append(run)
                places.append(pos)
                pos += 1
            columns = [*(batch[k] for k in keys), batch["media_id"], batch["blur"], pa.array(runs, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "media_id", "blur", "run", "pos"])

    kinds = ", ".join(f"`{k}` {ordered.schema[k].dataType.simpleString()}" for k in keys)
    folded = ordered.mapInArrow(fold, f"{kinds}, media_id bigint, blur double, run int, pos bigint")
    folded = folded.join(exact.select("media_id", F.lit(True).alias("taken")), "media_id", "left")
    run = W.partitionBy(*by, "stretch", "run")
    kept = folded.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("dropped", F.max(F.coalesce("taken", F.lit(False))).over(run)).withColumn("least", F.min("media_id").over(run))
    kept = kept.withColumn("place", F.row_number().over(run.orderBy(F.col("blur").desc(), "pos"))).where("n > 1 AND NOT dropped")
    return kept.select(F.lit("BURST").alias("kind"), F.concat(F.lit("BURST:"), F.col("least").cast("string")).alias("key"), "media_id", (F.col("place") == 1).alias("is_best"))


def all_groups(media: DataFrame, similarity: float, gap_sec: int, markers: tuple[str, ...] = S.COPY_MARKERS, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact groups, then bursts."""
    exact = exact_groups(media, markers)
    return exact.unionByName(burst_groups(media, exact, similarity, gap_sec, by))


def numbered(groups: DataFrame, parts: int = 1024) -> DataFrame:
    """groups with group_id from 1 without gaps, exact ones first.

    Keys are dealt by their hash and numbered inside each part; the parts' counts, at most `parts` for
    each kind, are summed before them.
    """
    keys = groups.select("kind", "key").distinct().withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    order = W.orderBy(F.col("kind") != "EXACT", "kind", "part")
    base = keys.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(order) - F.col("n"))
    inside = F.row_number().over(W.partitionBy("kind", "part").orderBy("key"))
    ids = keys.withColumn("inside", inside).join(base, ["kind", "part"]).select("kind", "key", (F.col("base") + F.col("inside")).alias("group_id"))
    return groups.join(ids, ["kind", "key"])


def with_choices(groups: DataFrame, choices: DataFrame) -> DataFrame:
    """The user's pick becomes the best if it is a member; groups get `dismissed`. choices(group_key, keep_id, dismissed)."""
    own = groups.join(choices.withColumnRenamed("group_key", "key"), "key", "left")
    member = groups.join(choices.select(F.col("group_key").alias("key"), F.col("keep_id").alias("media_id")), ["key", "media_id"], "left_semi").select("key", F.lit(True).alias("valid"))
    picked = own.join(member.distinct(), "key", "left")
    best = F.when(F.col("valid"), F.col("media_id") == F.col("keep_id")).otherwise(F.col("is_best"))
    return picked.select("kind", "key", "media_id", best.alias("is_best"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"))


def all_but_kept(groups: DataFrame) -> DataFrame:
    return groups.where(~F.col("is_best")).select("media_id")


def keep_one(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """(media_id, action) for each wanted item: `delete`, or `keep` for the one that is spared where a whole group is wanted: its best, else its least id."""
    want = wanted.select("media_id").distinct()
    marked = groups.join(want.withColumn("wanted", F.lit(True)), "media_id", "left")
    whole = marked.groupBy("key").agg(F.bool_and(F.coalesce("wanted", F.lit(False))).alias("whole"), F.min(F.when(F.col("is_best"), F.col("media_id"))).alias("best"), F.min("media_id").alias("least"))
    spared = whole.where("whole").select(F.coalesce("best", "least").alias("media_id"), F.lit("keep").alias("spared")).distinct()
    return want.join(spared, "media_id", "left").select("media_id", F.coalesce("spared", F.lit("delete")).alias("action"))


def readable(groups: DataFrame, media: DataFrame) -> DataFrame:
    """Groups as shown: members that are still visible, at least two, and a best: the first of them if the marked one is gone."""
    seen = groups.join(media.select("media_id"), "media_id", "left_semi")
    per = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("is_best"), F.col("media_id"))).alias("best"), F.min("media_id").alias("least")).where("n > 1")
    return joined_back(seen.drop("is_best"), per, "key").withColumn("is_best", F.col("media_id") == F.coalesce("best", "least")).drop("n", "best", "least")


def suggestions(groups: DataFrame, choices: DataFrame) -> DataFrame:
    """One row: how many items the groups that aren't dismissed could do without."""
    open_ = groups.join(choices.where("dismissed").select(F.col("group_key").alias("key")), "key", "left_anti")
    return open_.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
