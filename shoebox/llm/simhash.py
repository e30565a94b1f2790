"""Near-duplicates by SimHash, with links found by pivot distance tables.

The table has each distinct fingerprint's Hamming distances to reference fingerprints: to none set, to
each with one bit set, and to PIVOTS drawn from a hash. Relative to the distance to none set, those to
the one-bit references are coordinates of which two fingerprints within 2 bits differ in at most 2. The
coordinates are cut into five families, of which such a pair shares at least three whole, so the
coordinates of any three families together make a key, ten keys in all, and every pair that links meets
under one of them. Of what meets, the drawn references discard pairs by the largest difference of a
coordinate, and what survives is compared bit by bit.

A key that many fingerprints share is split by the coordinates that it leaves open, in the same way:
five families of them, keys of three. After three such steps at most MAX_OPEN coordinates are open, so
no more than 2 ** MAX_OPEN fingerprints can meet, and no group is ever larger than that or CROWD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import bounded_batches, free_names, scratch, with_row_key, work_path, written
from .similar_texts import SIMILARITY, WORDS, similar_texts

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Of fingerprints that stand for a similarity: bits within which all share a key, and bits beyond which what shares one isn't compared.
MET_BITS, MOST_BITS = 4, 16
#: References beyond those of one bit and none.
PIVOTS = 32
#: Fingerprints of one key from which on it is split by further coordinates.
CROWD = 64
#: A key is of three families of coordinates, so with three more families than bits that differ one is shared whole.
SHARED = 3
#: How often a key can be split.
STEPS = 3
#: Coordinates that the last keys leave open.
MAX_OPEN = 5


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ONE_BIT = tuple(_signed(1 << k) for k in range(64))
DRAWN = tuple(_signed(int.from_bytes(hashlib.sha256(b"pivot %d" % k).digest()[:8], "big")) for k in range(PIVOTS))


def majority(hashes: np.ndarray) -> int:
    """64 bits as a signed number: a bit is set if it is set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes) -> int:
    """64 bits as a signed number: a bit is set if it is set in over half the hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(x or b"") for x in batch.cast(pa.binary()).to_pylist()], pa.int64())


def fingerprint_column(col: str) -> Column:
    return F.arrow_udf(_fingerprints, "long")(F.col(col).cast("string"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_table(prints: DataFrame, *carry: str) -> DataFrame:
    """fp, the columns in `carry`, and `near`: its distances to the one-bit references, relative to that to none set."""
    fp, to = F.col("fp"), lambda r: _distance(F.col("fp"), F.lit(r)).cast("tinyint")
    return prints.select(fp, *carry, F.transform(F.array(*map(to, ONE_BIT)), lambda d: (d - to(0)).cast("tinyint")).alias("near"))


def _keys(key: Column, coordinates: Column, most: int, bits: int = MAX_BITS) -> list[tuple[Column, Column]]:
    """(key, the coordinates that it leaves open) for each three of the families of at most `most` coordinates; each extends `key`."""
    n = bits + SHARED
    cut = [round(most * k / n) for k in range(n + 1)]
    family = [F.slice(coordinates, lo + 1, hi - lo) for lo, hi in pairwise(cut)]
    return [(F.xxhash64(F.lit(no), key, *(family[k] for k in three)), F.concat(*(family[k] for k in range(n) if k not in three))) for no, three in enumerate(combinations(range(n), SHARED))]


def _open_after(most: int) -> int:
    cut = [round(most * k / 5) for k in range(6)]
    return sum(sorted(hi - lo for lo, hi in pairwise(cut))[-2:])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) of distinct fingerprints (column fp): all pairs within 2 bits, u below v."""
    spark = prints.sparkSession
    table = written(distance_table(prints), work_path(spark, "distances"))
    found: list[DataFrame] = []
    most, start = 64, F.lit(0).cast("long")
    # the first keys are many, so what they leave open isn't stored but looked up for keys that are split
    first = [F.struct(F.lit(k).cast("tinyint").alias("no"), key.alias("key")) for k, (key, _) in enumerate(_keys(start, F.col("near"), most))]
    rows = table.select("fp", F.explode(F.array(*first)).alias("k")).select("fp", "k.no", "k.key")
    for step in range(1, STEPS + 1):
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), work_path(spark, "sizes"))
        met = written(rows.join(sizes, "key"), work_path(spark, "met"))
        last = step == STEPS
        found.append(_close_pairs(met if last else met.where(F.col("n") <= crowd)))
        crowded = met.where(F.col("n") > crowd)
        if last or crowded.isEmpty():
            break
        if step == 1:
            left_open = F.array(*(rest for _, rest in _keys(start, F.col("near"), most)))
            crowded = crowded.join(table.select("fp", "near"), "fp").select("fp", "key", left_open[F.col("no")].alias("open"))
        most = _open_after(most)
        more = [F.struct(key.alias("key"), rest.alias("open")) for key, rest in _keys(F.col("key"), F.col("open"), most)]
        rows = written(crowded.select("fp", F.explode(F.array(*more)).alias("k")).select("fp", "k.key", "k.open"), work_path(spark, "split"))
    every = found[0]
    for more_found in found[1:]:
        every = every.unionByName(more_found)
    return every.distinct()


def met(prints: DataFrame, bits: int = MET_BITS, most: int = MOST_BITS) -> DataFrame:
    """(u, v) of nodes whose fingerprints share a key of the distance table, each with one leader of that key, and differ in at most `most` bits; prints has node, fp and own.

    Any two fingerprints within `bits` share a key, most of those a little further apart do too. Each row
    is paired once per key, however many share it, so two that share a key are linked through its leader
    or left to who asked. The leader is the row of the smallest `own`.
    """
    spark = prints.sparkSession
    table = distance_table(prints, "node", "own")
    each = [key for key, _ in _keys(F.lit(0).cast("long"), F.col("near"), 64, bits)]
    rows = table.select("node", "fp", "own", F.explode(F.array(*each)).alias("key"))
    lead = rows.groupBy("key").agg(F.min(F.struct("own", "node", "fp")).alias("x"), F.count(F.lit(1)).alias("many")).where("many > 1")
    lead = written(lead.select("key", F.col("x.node").alias("to"), F.col("x.fp").alias("to_fp")), work_path(spark, "leaders"))
    pairs = rows.select("key", "node", "fp").join(lead, "key").where("node != to")
    largest = F.greatest(*(F.abs(_distance(F.col("fp"), F.lit(r)) - _distance(F.col("to_fp"), F.lit(r))) for r in DRAWN))
    near = pairs.where(largest <= most).where(_distance(F.col("fp"), F.col("to_fp")) <= most)
    return near.select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct()


def _close_pairs(met: DataFrame) -> DataFrame:
    """Pairs of one key within 2 bits; no key has more than CROWD fingerprints, or more than the last coordinates allow."""
    # the distances to the drawn references are wanted only for what meets another
    table = [_distance(F.col("fp"), F.lit(r)).cast("tinyint").alias(f"d{k}") for k, r in enumerate(DRAWN)]
    groups = met.select("key", F.struct("fp", *table).alias("x")).groupBy("key").agg(F.collect_list("x").alias("xs"))
    pairs = groups.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b")).where("a.fp < b.fp")
    largest = F.greatest(*(F.abs(F.col(f"a.d{k}") - F.col(f"b.d{k}")) for k in range(PIVOTS)))
    near = pairs.where(largest <= MAX_BITS).where(_distance(F.col("a.fp"), F.col("b.fp")) <= MAX_BITS)
    return near.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable), root (least fingerprint reachable), and the columns in `carry`.

    A null text has no words; texts without words have fingerprint zero and link like any other.
    Null ids are never a component's id unless it has no other; repeated ids and rows are rows of
    their own. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(text_col).alias("fp"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    seen, place = written(seen, work_path(spark, "prints")), work_path(spark, "of")
    with scratch(spark):
        nodes = written(seen.groupBy("fp").agg(F.min("doc_id").alias("least_id")), work_path(spark, "nodes"))
        roots = components(links(nodes.select("fp"), crowd))
        labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        labelled = written(labelled, work_path(spark, "labelled"))
        ids = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), work_path(spark, "ids"))
        of = written(labelled.join(ids, "root").select("fp", "component_id", "root"), place)
    # both sides are scans, so a fingerprint that holds many of the rows is split over tasks
    return seen.join(of, "fp").select("doc_id", "fp", "component_id", "root", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)))


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of texts of at least the similarity of their sets of shingles, with all its columns: that of the smallest doc_id, the first of them where ids repeat (null is largest).

    Near copies of similarity 0.8 differ in about ten bits of a fingerprint, at which keys of coordinates no longer
    tell documents apart, so here the pivot table is that of the sets themselves (similar_texts).
    """
    spark, keys = docs.sparkSession, free_names(docs, "__row_file", "__row_index")
    keyed, place = with_row_key(docs, keys), work_path(spark, "gone")
    with scratch(spark):
        told = written(similar_texts(keyed, words=words, similarity=similarity, carry=keys), work_path(spark, "told"))
        # of most components only the row with the component's own id can stay
        able = told.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        first = able.groupBy("root").agg(F.min(F.struct(*keys)).alias("first"))
        stay = first.select("first.*")
        gone = written(told.select(*keys).join(written(stay, work_path(spark, "stay")), list(keys), "left_anti"), place)
    return keyed.join(gone, list(keys), "left_anti").drop(*keys)
