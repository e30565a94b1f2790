"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to its distinct digests,
those new to the index are found by a sort-merge anti-join that reads the index bucket by bucket
without shuffling it, and they are appended. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import free_names, remove, scratch, with_row_key, work_path, written

#: Fixed value: the white space that doesn't tell texts apart.
SPACES = r"[\x20\x09-\x0D]+"


def content_hash(docs: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A hash of what a row holds, which doesn't depend on where the row lies."""
    parts = []
    for field in docs.schema.fields:
        if field.name not in leave_out:
            col = F.col(f"`{field.name.replace('`', '``')}`")
            kind = field.dataType.simpleString()
            parts.append(F.to_json(F.struct(col)) if "map<" in kind or "variant" in kind else col)
    return F.xxhash64(*parts)


class DigestIndex:
    """A table of (digest, keep_id, keep_row, batch) at `path`, one row per distinct text ever added."""

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens or creates the index. buckets: as it was created with; the session's shuffle partitions by default, so a batch is shuffled once."""
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def remove(self) -> None:
        """Deletes the index: its entry in the catalogue and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Adds the rows of docs and tells what becomes of each.

        Returns one row per row of docs: doc_id, keep_id, group_size (rows of this batch with that
        text), kept, text_sha256, and the columns in `carry`. Of equal texts of a batch, the row of
        most code points stays, then that of the smallest doc_id (null is largest), then that whose
        columns but `carry` hash lowest, then the first; exactly one, also where rows repeat. A text
        that an earlier batch brought has that batch's keep_id, and no row of it is kept. A null text
        counts as empty; all empty texts are one group. Adding a batch again under its name changes
        nothing and keeps the same rows, however they are ordered and split into partitions by then;
        of rows that are equal in all columns but `carry`, one.
        """
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        seen = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.char_length(text).alias("n_chars"),
            F.unhex(F.sha2(F.regexp_replace(text, SPACES, ""), 256)).alias("digest"),
            content_hash(docs, carry).alias("row_hash"),
            F.monotonically_increasing_id().alias("row_no"),
            *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)),
        )
        seen = written(seen, work_path(self.spark, "digests"))
        best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "row_no"))
        groups = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        groups = groups.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_row"), F.col("best.row_no").alias("first"))
        spent = work_path(self.spark, "groups")
        groups = written(groups, spent)

        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "keep_row", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        known = self.rows().select("digest", F.col("keep_id").alias("index_id"), F.col("keep_row").alias("index_row"), (F.col("batch") == batch).alias("own"))
        # row_no tells equal rows apart within this run alone; the index knows a row by what it holds
        stays = F.when(F.col("own") & (F.col("keep_row") == F.col("index_row")), F.col("first")).alias("stays")
        found = written(groups.join(known.hint("merge"), "digest").select("digest", "group_size", "index_id", stays), work_path(self.spark, "found"))
        remove(self.spark, spent)
        # both sides are scans, so a digest that holds many of the rows is split over tasks
        return seen.join(found, "digest").select(
            "doc_id",
            F.col("index_id").alias("keep_id"),
            "group_size",
            F.coalesce(F.col("row_no") == F.col("stays"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)),
        )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One batch against a new index, which is removed again: see DigestIndex.add. An empty table gives an empty table."""
    spark = docs.sparkSession
    index = DigestIndex(spark, work_path(spark, "digest_index"))
    told = index.add(docs, "first")
    index.remove()
    return told


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; those that go are found by their place, so ids may repeat or be null."""
    spark, keys = docs.sparkSession, free_names(docs, "__row_file", "__row_index")
    keyed, place = with_row_key(docs, keys), work_path(spark, "gone")
    with scratch(spark):
        index = DigestIndex(spark, work_path(spark, "digest_index"))
        told = index.add(keyed, "first", carry=keys)
        index.remove()
        gone = written(told.where(~F.col("kept")).select(*keys), place)
    return keyed.join(gone, list(keys), "left_anti").drop(*keys)
