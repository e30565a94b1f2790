"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item; an item of fewer words is one window. Of each run of
hashes of k words, winnowing keeps the least in every stretch of w, where k + w - 1 is the window's
length: so a window that stands in a document shares a kept hash with it, its least one. Documents are
winnowed alike. A kept hash that the benchmark may have too is a hit, which is extended to each window
that it is the least of; kept hash and window are joined with the benchmark's.

Nothing of the benchmark goes through the driver but one table of bits, of FILTER_BITS, that tells of
most hashes that the benchmark hasn't kept them: the join alone decides. So only what is probably the
benchmark's is shuffled, and documents are scanned once, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, free_names, scratch, with_row_key, work_path, written

WINDOW = 13
#: Bits of the filter that is sent to the workers, 8 MB; 64 of them are a row on their way there.
FILTER_BITS = 1 << 26
#: Bytes of texts taken at once; a longer text is taken by itself.
SLICE_BYTES = 256 << 10
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

#: A-Z to a-z; what is no letter, no digit and below 0x80 to a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mixed(np.arange(256, dtype=np.uint64), 1)
#: An odd multiplier and its inverse modulo 2 ** 64.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, modulo 2 ** 64; those of short texts are kept."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        powers = np.full(max(n, 2 * SLICE_BYTES) + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        if n > 2 * SLICE_BYTES:
            return powers
        _POWERS[base] = powers
    return _POWERS[base]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts, number of words of each text). Long texts are taken piece by piece, so what is held beside the hashes is small."""
    pieces = [list(_pieces(t)) for t in texts]
    found = [_word_hashes(some) for some in _slices([p for own in pieces for p in own])]
    counts = np.concatenate([n for _, n in found]) if found else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, pieces)])]
    return np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64), np.diff(ends)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut between words into pieces of about SLICE_BYTES at most; a word of more is in one piece."""
    start = 0
    while len(text) - start > SLICE_BYTES:
        size = SLICE_BYTES
        while (cut := text[start : start + size].translate(_WORD_BYTES).rfind(b" ")) < 0 and start + size < len(text):
            size *= 2
        if cut < 0:
            break
        yield text[start : start + cut + 1]
        start += cut + 1
    yield text[start:]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is a polynomial in its letters, by differences of running sums."""
    data = np.frombuffer(b" ".join(texts).translate(_WORD_BYTES), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(_STEP, len(data))[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts]
    hashes = _mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(56)), 2)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, begins))


def _grams(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    out = np.zeros(max(0, len(values) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[j : j + len(out)]
    return _mixed(out, seed)


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    span = 1
    while span < w:
        step = min(span, w - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


def gram_size(length: int) -> int:
    """k for windows of so many words; winnowing looks at length - k + 1 hashes."""
    return (length + 1) // 2


def windows(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept hash of each window, whether it lies within one text) of the words of several texts one after another."""
    k = gram_size(length)
    kept = _least(_grams(values, k, 7), length - k + 1) if len(values) >= length else np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return kept, text[: len(kept)] == text[length - 1 :][: len(kept)]


def _whole(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window that begins at starts, independent of the kept one."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out = out * np.uint64(0xA0761D6478BD642F) + _mixed(values[starts + j], 3)
    return _mixed(out, 5)


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """texts in order, some at a time."""
    start = 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= SLICE_BYTES:
            size += len(texts[stop])
            stop += 1
        yield texts[start:stop]
        start = stop


class Hits:
    """Finds windows of which the filter has the kept hash."""

    def __init__(self, lengths: list[int], words: np.ndarray):
        self.lengths, self.filter = lengths, words

    def find(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(number of words, rows of length, first word, kept hash and hash of the window) of each text."""
        return [x for some in _slices(texts) for x in self._find(some)]

    def _find(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        values, sizes = word_hashes(texts)
        begins = np.cumsum([0, *sizes])
        found: list[np.ndarray] = []
        for length in self.lengths:
            kept, within = windows(values, sizes, length)
            # neighbours mostly share their least hash, which is looked up once
            first = np.flatnonzero(np.diff(kept, prepend=~kept[:1]) != 0)
            slot = (kept[first] >> np.uint64(20)) & np.uint64(64 * len(self.filter) - 1)
            there = (self.filter[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            known = np.repeat(there.astype(bool), np.diff(np.append(first, len(kept))))
            at = np.flatnonzero(known & within)
            found.append(np.stack([np.full(len(at), length), at, kept[at].view(np.int64), _whole(values, at, length).view(np.int64)], 1))
        rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        owner = np.searchsorted(begins, rows[:, 1], "right") - 1
        order = np.argsort(owner, kind="stable")
        rows, owner = rows[order], owner[order]
        rows[:, 1] -= begins[owner]
        return [(int(n), part) for n, part in zip(sizes, np.split(rows, np.searchsorted(owner, np.arange(1, len(texts)))), strict=True)]


# the benchmark's side


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, kept, whole, item) for each window of each item: its words, its kept hash, its own, and the item's id as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                values, sizes = word_hashes([text or b""])
                length = min(WINDOW, len(values))
                if not length:
                    continue
                kept, _ = windows(values, sizes, length)
                whole = _whole(values, np.arange(len(kept)), length)
                n = len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([length] * n, pa.int32()), pa.array(kept.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([item] * n, pa.string())], names=["n", "kept", "whole", "item"])

    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "n int, kept long, whole long, item string").distinct()


def bit_filter(kept: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as words of 64, those of the kept hashes set. At most FILTER_BITS / 64 rows come to the driver."""
    bits = kept.selectExpr(f"shiftrightunsigned(kept, 20) & {FILTER_BITS - 1} AS slot").selectExpr("shiftrightunsigned(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


HITS = "struct<n_words:long,hits:array<struct<n:int,start:int,kept:long,whole:long>>>"


def _finder(spark, lengths: list[int], words: np.ndarray):
    sent = spark.sparkContext.broadcast(Hits(lengths, words))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            found = own.find([x or b"" for x in batch.cast(pa.binary()).to_pylist()])
            rows = np.concatenate([r for _, r in found]) if found else np.empty((0, 4), np.int64)
            offsets = pa.array(np.cumsum([0, *(len(r) for _, r in found)]), pa.int32())
            columns = [pa.array(rows[:, 0], pa.int32()), pa.array(rows[:, 1], pa.int32()), pa.array(rows[:, 2]), pa.array(rows[:, 3])]
            hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["n", "start", "kept", "whole"]))
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), hits], names=["n_words", "hits"])

    return F.arrow_udf(find, HITS)


# verdicts


def _spans(starts: str):
    """Sorted structs of (start, end) merged where they meet or overlap."""
    kind = "array<struct<start:int,end:int>>"
    return F.expr(f"""aggregate({starts}, named_struct('done', cast(array() as {kind}), 'start', -1, 'end', -1), (a, s) ->
        if(a.start < 0, named_struct('done', a.done, 'start', s.start, 'end', s.end),
        if(s.start <= a.end, named_struct('done', a.done, 'start', a.start, 'end', greatest(a.end, s.end)),
           named_struct('done', concat(a.done, array(named_struct('start', a.start, 'end', a.end))), 'start', s.start, 'end', s.end))),
        a -> if(a.start < 0, a.done, concat(a.done, array(named_struct('start', a.start, 'end', a.end)))))""")


def _found(spark, docs: DataFrame, benchmark: DataFrame, text_col: str, keep: list, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(the columns `keep` and n_words, file, row for each row of docs; file, row, spans, items for those that have a window)."""
    bounded_batches(spark)
    place, out = work_path(spark, "told"), work_path(spark, "found")
    with scratch(spark):
        return _joined(spark, docs, benchmark_windows(benchmark, item_col, item_text_col), text_col, keep, place, out)


def _joined(spark, docs: DataFrame, items: DataFrame, text_col: str, keep: list, place: str, out: str) -> tuple[DataFrame, DataFrame]:
    every = written(items, work_path(spark, "windows"))
    lengths = sorted(r.n for r in every.select("n").distinct().collect())  # at most WINDOW
    find = _finder(spark, lengths, bit_filter(every))
    told = written(docs.select(*keep, find(F.col(text_col).cast("string")).alias("told")).select(*(c for c in docs.select(*keep).columns), "told.*"), place)
    told = with_row_key(told, ("file", "row"))
    hits = told.where(F.size("hits") > 0).select("file", "row", F.explode("hits").alias("h")).select("file", "row", "h.*")
    # both sides of each join are scans, so a window that many documents or items have is split over tasks
    unique = written(every.select("n", "kept", "whole").distinct(), work_path(spark, "unique"))
    same = written(hits.join(unique, ["n", "kept", "whole"]), work_path(spark, "same"))
    spans = same.groupBy("file", "row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("all"))
    spans = spans.select("file", "row", _spans("all").alias("spans"))
    of = same.join(every.where("item IS NOT NULL"), ["n", "kept", "whole"]).select("file", "row", "item").distinct()
    items = of.groupBy("file", "row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = spans.join(items, ["file", "row"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return told.drop("hits"), written(found, out)


def _hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans of hit words, sorted ids of the items found, n_hit, contaminated, and the columns in `carry`.

    Null and empty texts, of documents or items, have no words. Repeated items count once; the words
    of an item with a null id are looked for, but it isn't listed. Repeated documents are rows of
    their own; other columns aren't read. An empty benchmark hits nothing. Windows are compared by
    two independent hashes of 64 bits.
    """
    spark = docs.sparkSession
    names = [f"carried_{k}" for k in range(len(carry))]
    keep = [F.col(id_col).alias("doc_id"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True))]
    told, found = _found(spark, docs, benchmark, text_col, keep, item_col, item_text_col)
    out = told.join(found, ["file", "row"], "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("n_hit", _hit("spans")).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "n_words", "spans", "items", "n_hit", "contaminated", *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    spark, keys = docs.sparkSession, free_names(docs, "__row_file", "__row_index")
    keyed, place = with_row_key(docs, keys), work_path(spark, "bad")
    with scratch(spark):
        bad = written(decontaminate(keyed, benchmark, carry=keys).where("contaminated").select(*keys), place)
    return keyed.join(bad, list(keys), "left_anti").drop(*keys)
