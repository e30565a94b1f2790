"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie side by side in one array of symbols. In each round every sequence finds
the lowest rank among its pairs and applies it at all its places at once; sequences without a pair
leave. What remains of each is its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import Chunks, Kept, PairTable, load_merges, slices
from .session import bounded_batches

#: Bytes of pre-tokens merged at once.
MERGED_BYTES = 4_000_000


class RankMerger:
    """Counts tokens as a .json byte-level BPE vocabulary gives them."""

    def __init__(self, path: str):
        vocabulary, merges, self.added = load_merges(path)
        self.first = np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)
        made: dict[bytes, int] = {}
        for rank, (a, b) in enumerate(merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or a + b in made:
                raise ValueError("a merge comes before its parts; all places of a pair can't be merged at once")
            made[a + b] = rank
        self.pairs = PairTable({(vocabulary[a], vocabulary[b]): (r, vocabulary[a + b]) for r, (a, b) in enumerate(merges)})

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < len(pieces):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + MERGED_BYTES, "right")))
            symbols = self.first[np.frombuffer(b"".join(pieces[start:stop]), np.uint8)]
            self._merge(symbols, np.repeat(np.arange(start, stop), lengths[start:stop]), out)
            start = stop
        return out

    def _merge(self, symbols: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        none = self.pairs.none
        ranks, merged = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(owner[:-1] == owner[1:])  # places whose pair with the next symbol isn't known yet
        while len(symbols):
            ranks[at], merged[at] = self.pairs.find(symbols[at], symbols[at + 1])
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(owner)))
            least = np.minimum.reduceat(ranks, heads)
            done = least == none
            out[owner[heads[done]]] = sizes[done]
            chosen = np.flatnonzero((ranks == np.repeat(least, sizes)) & (ranks < none))
            if not len(chosen):
                return
            # places of a pair of equal symbols can overlap: of a run, take every other one from its start
            new_run = np.append(True, np.diff(chosen) != 1)
            run_start = chosen[np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))]
            chosen = chosen[(chosen - run_start) % 2 == 0]
            symbols[chosen] = merged[chosen]
            keep = ~np.repeat(done, sizes) if done.any() else np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            place = (np.cumsum(keep) - 1)[chosen]  # where the merged symbols are now
            symbols, owner, ranks, merged = symbols[keep], owner[keep], ranks[keep], merged[keep]
            ranks[place] = none
            changed = np.zeros(len(symbols) + 1, bool)
            changed[place] = changed[place - 1] = True
            at = np.flatnonzero(changed[: max(0, len(symbols) - 1)])
            at = at[owner[at] == owner[at + 1]]


class TokenCounter:
    """Counts whole texts; keeps the counts of chunks it has met."""

    def __init__(self, path: str):
        self.merger, self.chunks, self.kept = RankMerger(path), Chunks(), Kept()

    def count(self, texts: list[str]) -> list[int]:
        return [n for some in slices(texts) for n in self._count(some)]

    def _count(self, texts: list[str]) -> list[int]:
        self.kept.make_room()
        known, parts, extra = self.kept.of, [], []
        for text in texts:
            pieces = [text]
            for token in self.merger.added:  # its text stands for one token wherever it occurs
                pieces = [x for piece in pieces for x in piece.split(token)]
            extra.append(len(pieces) - 1)
            parts.append([c for piece in pieces if piece for c in self.chunks.of(piece)])
        new = {c for chunks in parts for c in chunks if c not in known}
        own: dict[str, int] = {}
        if new:
            words = {c: self.chunks.split(c) for c in new}
            distinct = {w for ws in words.values() for w in ws}
            of = {w: known[w] for w in distinct if w in known}  # a chunk of its own elsewhere
            distinct = [w for w in distinct if w not in of]
            of.update(zip(distinct, self.merger.counts([w.encode() for w in distinct]).tolist(), strict=True))
            found = {c: of[ws[0]] if len(ws) == 1 else sum(map(of.__getitem__, ws)) for c, ws in words.items()}
            own = self.kept.add(found, 0)
        get = known.__getitem__ if not own else lambda c: own[c] if c in own else known[c]
        return [more + sum(map(get, chunks)) for more, chunks in zip(extra, parts, strict=True)]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One for each vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    A null text counts as empty: no bytes, no tokens. Null and repeated ids pass through, each row
    on its own. Other columns are not read. An empty table gives an empty table. Texts are counted
    whole; long ones cost memory in proportion to their own length only.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_bytes:long,n_tokens:long>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(own.count(texts), pa.int64())], names=["n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("doc_id"), count(F.col(text_col).cast("string")).alias("c"))
    return counted.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
