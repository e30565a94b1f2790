"""What the operators share: the shared work folder, row keys, and Arrow batch limits."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one machine that is driver and executors gets a folder of its own; a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one run of an operator, inside the shared folder, or inside the innermost scratch folder."""
    return f"{_SCRATCH.get() or shared_root(spark) + '/shoebox'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what outlives them has its path from before."""
    path = work_path(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, so a lost executor costs one task and not the whole chain."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM's Hadoop client for a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def with_row_key(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """docs with two more columns, of names it hasn't, that name each physical row: its file and its position there.

    Both stay the same however often the rows are read, so decisions made in one scan find their
    rows in the next, even where ids repeat or are null. Rows that come from no file are written
    to the shared folder first.
    """
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    except Exception as error:  # noqa: BLE001  only files have the hidden column
        if "_metadata" not in str(error):
            raise
    spark = docs.sparkSession
    return with_row_key(written(docs, work_path(spark, "rows")), names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
