"""Numbering of runs in ordered rows, for libraries of any size.

A plain window over one key puts all its rows into one task. Here a key is cut into slices of time:
each slice is ordered for itself, the last row of every slice is handed to the next one, and the
number of runs before a slice is added to those inside it. Only a row per slice is ordered per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of a slice: with keys, which keep slices small, and without, where a slice has the items of all.
SLICE_SEC, SHARED_SLICE_SEC = 7 * 86400, 3600


def with_runs(rows: DataFrame, starts: Callable[[Column], Column], name: str, by: tuple[str, ...] = (), at: str = "taken_at", tie: str = "media_id", carry: tuple[str, ...] = (), slice_sec: int | None = None) -> DataFrame:
    """rows with column `name`, counting from 0 the runs of each key in the order of `at` and `tie`.

    starts(previous) says whether a row starts a new run; previous is a struct of `at` and the columns
    in `carry` of the row before, null for the first, and null counts as no. Null keys are a key of
    their own; rows without `at` are to be left out before.
    """
    slice_sec = slice_sec or (SLICE_SEC if by else SHARED_SLICE_SEC)
    kept = F.struct(at, tie, *carry)
    cut = rows.withColumn("_slice", F.floor(F.col(at) / slice_sec))
    inside = W.partitionBy(*by, "_slice").orderBy(at, tie)
    between = W.partitionBy(*by).orderBy("_slice")
    last = cut.groupBy(*by, "_slice").agg(F.max(kept).alias("_last")).withColumn("_before", F.lag("_last").over(between)).drop("_last")
    met = _joined(cut, last, by)
    new = F.coalesce(starts(F.coalesce(F.lag(kept).over(inside), F.col("_before"))), F.lit(False)).cast("int")
    marked = met.withColumn("_new", new).drop("_before")
    sums = marked.groupBy(*by, "_slice").agg(F.sum("_new").alias("_n")).withColumn("_base", F.sum("_n").over(between) - F.col("_n")).drop("_n")
    out = _joined(marked, sums, by)
    return out.withColumn(name, F.col("_base") + F.sum("_new").over(inside)).drop("_slice", "_new", "_base")


def joined_back(rows: DataFrame, per_key: DataFrame, key: str, spread: int = 16, by: str = "media_id") -> DataFrame:
    """rows with what per_key, an aggregate of them by `key`, has of their key. A key's rows are dealt over `spread` tasks by the hash of `by`, and its one row is repeated for each, so a key that many of the rows have isn't joined in one task."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(spread)))
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))
    return dealt.join(copies, [key, "_part"]).drop("_part")


def _joined(rows: DataFrame, per_slice: DataFrame, by: tuple[str, ...]) -> DataFrame:
    keys = [*by, "_slice"]
    other = per_slice.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in per_slice.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, same).drop(*(f"_k{i}" for i in range(len(keys))))
