"""Near-duplicates by SimHash and the similarity of their sets of word shingles, with links found by pivot distance tables.

Two texts link if the Jaccard similarity of their sets of shingles is at least `similarity`. The first
candidates are texts whose fingerprints, the SimHash of their sets, share a key of the fingerprints'
table of pivot distances (simhash.met); they are compared exactly. A similarity bounds no number of bits,
so what the fingerprints leave in different components is looked for by the sets themselves, and no
link between components is lost: shingles are put in one order for all texts, rare ones first, and two similar sets share a shingle
among the first n - ceil(similarity * n) + 1 of each. Shingles that share a level of frequency are ordered by
their hash, so the order needs no more than a table of levels, SLOTS of four bits whatever the input's
size; where two shingles share a slot the order is another one, and still the same for all texts.

The texts that share a shingle and are still apart are not paired with each other but, in each class of lengths, with that of
them that has the fewest shingles of its own; a pair is left out if the members from the shared one on are
too few in either set. What that leaves apart is paired with texts of other components alone. The pivot table has the
Hamming distances of each set to PIVOTS reference sets that share no member (all shingles whose hash has
one value of six bits), relative to that to the empty set. As the references share nothing, the
differences of all coordinates together are at most the distance of the two sets; pairs beyond the
distance that the similarity allows are discarded, and the rest are compared member by member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import bounded_batches, scratch, with_row_key, work_path, written

WORDS, SIMILARITY = 5, 0.8
PIVOTS = 64
#: Slots of the table of levels; a level is the logarithm of how many texts have a shingle, 15 at most.
SLOTS = 1 << 25
#: Low bits of a hash by which texts are counted; a slot's are among them.
COUNTED_BITS = 40
#: Added to what rounding could make too small.
SLACK = 1e-9


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the runs of `words` words, ascending; of the whole sequence if it is shorter; none of no words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += each[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(kind) if flat.dtype.itemsize == np.dtype(kind).itemsize else flat.astype(kind)))


def _texts(batch: pa.Array) -> Iterator[bytes]:
    return (x or b"" for x in batch.cast(pa.binary()).to_pylist())


def hashes_column(col: Column, words: int) -> Column:
    """The set of a text's shingles."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _lists([shingle_hashes(x, words) for x in _texts(batch)], np.int64)

    return F.arrow_udf(of, "array<long>")(col.cast("string"))


def levels(hashes: DataFrame) -> np.ndarray:
    """SLOTS / 16 words of 16 levels each, of all rows of hashes (h). At most that many rows come to the driver."""
    # fewer bits move through the shuffle; shingles that share them count as one, which can only raise a level
    often = hashes.groupBy(F.expr(f"h & {(1 << COUNTED_BITS) - 1}").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = often.selectExpr(f"shiftrightunsigned(h, 8) & {SLOTS - 1} AS slot", "CAST(least(15, floor(log2(n))) AS BIGINT) AS level")
    slots = slots.groupBy("slot").agg(F.max("level").alias("level"))
    words = slots.selectExpr("shiftrightunsigned(slot, 4) AS word", "shiftleft(level, CAST(4 * (slot & 15) AS INT)) AS part")
    rows = words.groupBy("word").agg(F.bit_or("part").alias("parts")).toArrow()
    out = np.zeros(SLOTS // 16, np.int64)
    out[rows["word"].to_numpy()] = rows["parts"].to_numpy()
    return out.view(np.uint64)


def level_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(8) & np.uint64(16 * len(table) - 1)
    return table[(slot >> np.uint64(4)).astype(np.int64)] >> (slot & np.uint64(15)) * np.uint64(4) & np.uint64(15)


def first_of(hashes: np.ndarray, table: np.ndarray, similarity: float) -> tuple[int, np.ndarray]:
    """How many hashes no other text has, and the first of the others in order, so many that a similar set must share one of them."""
    n = len(hashes)
    if not n:
        return 0, hashes
    level = level_of(table, hashes)
    own = int((level == 0).sum())
    most = n - math.ceil(similarity * n - SLACK) + 1
    return own, hashes[np.argsort(level, kind="stable")[own:most]]


def distances(hashes: np.ndarray) -> np.ndarray:
    """Members in each reference set: (distance to none + the reference's size - distance to the reference) / 2."""
    return np.bincount((hashes & np.uint64(PIVOTS - 1)).astype(np.int64), minlength=PIVOTS).astype(np.int32)


def _described(spark, text: Column, table: np.ndarray, words: int, similarity: float) -> Column:
    from .simhash import majority

    sent = spark.sparkContext.broadcast(table)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_hashes(x, words) for x in _texts(batch)]
            firsts = [first_of(x, sent.value, similarity) for x in sets]
            fields = {
                "digest": pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()),
                "n": pa.array([len(x) for x in sets], pa.int32()),
                "own": pa.array([own for own, _ in firsts], pa.int32()),
                "fp": pa.array([majority(x) for x in sets], pa.int64()),
                "first": _lists([x for _, x in firsts], np.int64),
                "near": _lists([distances(x) for x in sets], np.int32),
            }
            yield pa.StructArray.from_arrays(list(fields.values()), list(fields))

    return F.arrow_udf(of, "struct<digest: binary, n: int, own: int, fp: long, first: array<long>, near: array<int>>")(text.cast("string"))


def _verified(pairs: DataFrame, table: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of at least the similarity."""
    spark = pairs.sparkSession
    side = lambda name: table.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("near").alias(f"near_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    apart = F.aggregate(F.zip_with("near_u", "near_v", lambda a, b: F.abs(a - b)), F.lit(0), lambda x, y: x + y)
    allowed = (F.col("n_u") + F.col("n_v")) * ((1 - similarity) / (1 + similarity)) + SLACK
    left = written(both.where(apart <= allowed).select("u", "v", "n_u", "n_v"), work_path(spark, "left"))
    wanted = left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct()
    keys = written(table.join(wanted, "node").select("node", "file", "row"), work_path(spark, "wanted"))
    sets = docs.select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.col(text_col).alias("text")).join(keys, ["file", "row"])
    sets = written(sets.select("node", hashes_column(F.col("text"), words).alias("set")), work_path(spark, "sets"))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    same = left.join(side("u"), "u").join(side("v"), "v").withColumn("same", F.size(F.array_intersect("set_u", "set_v")))
    return written(same.where(F.col("same") / (F.col("n_u") + F.col("n_v") - F.col("same")) >= similarity).select("u", "v"), work_path(spark, "similar"))


def _split(keys: DataFrame, near: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows of keys whose group `by` is of more than one component of the links, with their component as `root`."""
    spark = keys.sparkSession
    roots = written(components(near), work_path(spark, "roots"))
    apart = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = written(apart, work_path(spark, "apart"))
    split = apart.groupBy(*by).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select(*by)
    return written(apart.join(split, list(by)), work_path(spark, "split"))


def links(table: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(u, v) of nodes whose components are those of all similar pairs; docs has __file and __row."""
    from . import simhash

    spark = table.sparkSession
    kind = F.floor(F.log(F.col("n")) / math.log(1 / similarity) if similarity < 1 else F.col("n")).cast("int")
    keys = table.select("node", "n", "own", kind.alias("kind"), F.posexplode("first").alias("at", "h"))
    # left: the members from this one on, those that a set can share with one whose first shared member it is
    keys = written(keys.select("h", "kind", "node", "n", "own", (F.col("n") - F.col("own") - F.col("at")).alias("left")), work_path(spark, "keys"))

    def may_link(a: str, b: str) -> Column:
        least = similarity / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - SLACK
        return (F.col(f"{a}.left") >= least) & (F.col(f"{b}.left") >= least)

    met = written(simhash.met(table), work_path(spark, "met"))
    near = _verified(met, table, docs, text_col, words, similarity)
    # what the fingerprints leave apart; of all texts, one with few shingles of its own is likely to be like most others
    split = _split(keys, near, ("h", "kind"))
    lead = split.groupBy("h", "kind").agg(F.min(F.struct("own", "node", "n", "left", "root")).alias("x"))
    lead = written(lead.select("h", "kind", "x.*"), work_path(spark, "lead"))
    a, b = lead.alias("a"), split.alias("b")
    star = b.join(a, (F.col("a.h") == F.col("b.h")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.root") != F.col("b.root")) & may_link("a", "b"))
    star = star.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    near = near.unionByName(_verified(written(star, work_path(spark, "star")), table, docs, text_col, words, similarity))
    # what is still apart: texts that share a shingle, in different components
    split = _split(keys, near, ("h",))
    a, b = split.alias("a"), split.alias("b")
    rest = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.root") < F.col("b.root")) & may_link("a", "b"))
    rest = rest.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    return near.unionByName(_verified(written(rest, work_path(spark, "rest")), table, docs, text_col, words, similarity))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id reachable by links), root (a number of the component), and the columns in `carry`.

    A null text has no words. Texts without words are copies of each other and like no others; a text
    of fewer words than a shingle has is one shingle. Null ids are never a component's id unless it
    has no other; repeated ids and rows are rows of their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    named = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *named)
    plain = with_row_key(plain, ("__file", "__row"))
    seen_path, of_path = work_path(spark, "seen"), work_path(spark, "of")
    table = levels(plain.select(F.explode(hashes_column(F.col("text"), words)).alias("h")))
    rows = plain.select("doc_id", "__file", "__row", *(f"carried_{k}" for k in range(len(carry))), _described(spark, F.col("text"), table, words, similarity).alias("s"))
    rows = rows.select(F.monotonically_increasing_id().alias("node"), "doc_id", F.col("__file").alias("file"), F.col("__row").alias("row"), *(f"carried_{k}" for k in range(len(carry))), "s.*")
    seen = written(rows, seen_path)
    with scratch(spark):
        same = written(seen.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id")), work_path(spark, "same"))
        one = written(seen.select("node", "file", "row", "n", "own", "fp", "first", "near").join(same.select("node"), "node"), work_path(spark, "one"))
        roots = components(links(one, plain, "text", words, similarity))
        labelled = same.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        labelled = written(labelled, work_path(spark, "labelled"))
        ids = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), work_path(spark, "ids"))
        of = written(labelled.join(ids, "root").select("digest", "component_id", "root"), of_path)
    return seen.join(of, "digest").select("doc_id", "component_id", "root", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)))
