"""Byte-level BPE encoding by a segment tree, and decoding.

A tree over the byte positions of a pre-token keeps the leftmost minimum of the pair ranks. Its
root names the next merge; the merge sets the merged position, the one that it swallows and the
live neighbour before, and each of these point updates climbs to the root. Pre-tokens of like size
go through their trees side by side, as rows of arrays; a few long ones one by one.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import PATTERN, Chunks, Kept, PairTable, load_ranks, slices
from .session import bounded_batches

#: Tree nodes of pre-tokens that go side by side.
TREE_NODES = 500_000
#: Pre-tokens of like size up to which each goes through its tree alone.
ALONE = 3


class SegmentTreeBpe:
    """Ids of pre-tokens by a rank file: of all neighbours whose joined bytes are a token, the lowest rank, leftmost, merges first."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        self.pairs = PairTable(pairs)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each, as the bytes of 32-bit numbers."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, sys.byteorder)
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, those in by_size.items():
            if len(those) <= ALONE:
                for k in those:
                    out[k] = self._merge_one(pieces[k], size)
                continue
            step = max(1, TREE_NODES // (2 * size))
            for start in range(0, len(those), step):
                part = those[start : start + step]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _merge_one(self, piece: bytes, size: int) -> bytes:
        """As _merge, node by node; arrays of numbers, so a long pre-token costs some dozen bytes a byte."""
        n, none, rank_of = len(piece), np.iinfo(np.int64).max, self.ranks.get
        parts: list[bytes | None] = [bytes((b,)) for b in piece]  # the bytes of the symbol at each live place
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        leaves = np.full(size, none)
        ids = self.first[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])[0]
        leaves[: n - 1] = np.where(ranks < self.pairs.none, ranks * size + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(1))
        tree = array("q", np.concatenate([[none], *reversed(levels)]).tobytes())

        def update(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = min(value, other)
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        while size > 1 and tree[1] < none:
            at = tree[1] % size
            gone = after[at]
            parts[at] = own = parts[at] + parts[gone]
            parts[gone] = None
            after[at] = follow = after[gone]
            value = none
            if follow < n:
                before[follow] = at
                rank = rank_of(own + parts[follow])
                value = none if rank is None else rank * size + at
            update(gone, none)
            update(at, value)
            prior = before[at]
            if prior >= 0:
                rank = rank_of(parts[prior] + own)
                update(prior, none if rank is None else rank * size + prior)
        return array("i", [self.ranks[x] for x in parts if x is not None]).tobytes()

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, none = len(pieces), np.iinfo(np.int64).max
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)
        # places of all pre-tokens in one row: pre-token r has those from r * size on, and tree nodes from 2 * r * size on
        ids = self.first[flat]
        place = np.arange(n * size)
        column = place % size
        end = np.repeat(np.arange(n) * size + lengths, size)
        live = place < end
        after = np.where(place + 1 < end, place + 1, -1)
        before = np.where(column > 0, place - 1, -1)
        tree = np.full((n, 2 * size), none)

        def key(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank < self.pairs.none, rank * size + at % size, none)

        at = np.flatnonzero(live & (after >= 0))
        leaves = np.full(n * size, none)
        leaves[at] = key(self.pairs.find(ids[at], ids[at + 1])[0], at)
        tree[:, size:] = leaves.reshape(n, size)
        width = size
        while width > 1:  # each level from the one below
            half = width // 2
            tree[:, half:width] = tree[:, width : 2 * width].reshape(n, half, 2).min(2)
            width = half
        nodes = tree.reshape(-1)
        roots = tree[:, 1]

        def update(at: np.ndarray, value: np.ndarray | int) -> None:
            row, node = at // size * (2 * size), at % size + size
            nodes[row + node] = value
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                child = row + 2 * node
                nodes[row + node] = np.minimum(nodes[child], nodes[child + 1])

        rows = np.arange(n)
        while size > 1:
            rows = rows[roots[rows] < none]
            if not len(rows):
                break
            rank, at = np.divmod(roots[rows], size)
            at += rows * size
            gone = after[at]
            ids[at] = rank
            live[gone] = False
            follow = after[gone]
            after[at] = follow
            value = np.full(len(rows), none)
            has = np.flatnonzero(follow >= 0)
            if len(has):
                before[follow[has]] = at[has]
                value[has] = key(self.pairs.find(rank[has], ids[follow[has]])[0], at[has])
            update(gone, none)
            update(at, value)
            prior = before[at]
            has = np.flatnonzero(prior >= 0)
            if len(has):
                p = prior[has]
                update(p, key(self.pairs.find(ids[p], rank[has])[0], p))
        kept = ids[live].astype(np.int32).tobytes()
        return [kept[4 * a : 4 * b] for a, b in pairwise(np.cumsum([0, *live.reshape(n, size).sum(1)]).tolist())]


class Codec:
    """Whole texts to ids and back; keeps the ids of chunks it has met."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.bpe, self.chunks, self.kept = SegmentTreeBpe(path), Chunks(pattern), Kept()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for some in slices(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        self.kept.make_room()
        known = self.kept.of
        parts = [self.chunks.of(text) if text else [] for text in texts]
        new = {c for chunks in parts for c in chunks if c not in known}
        own: dict[str, bytes] = {}
        if new:
            words = {c: self.chunks.split(c) for c in new}
            distinct = {w for ws in words.values() for w in ws}
            of = {w: known[w] for w in distinct if w in known}  # a chunk of its own elsewhere
            distinct = [w for w in distinct if w not in of]
            of.update(zip(distinct, self.bpe.encode([w.encode() for w in distinct]), strict=True))
            found = {c: of[ws[0]] if len(ws) == 1 else b"".join(map(of.__getitem__, ws)) for c, ws in words.items()}
            own = self.kept.add(found, 4)
        get = known.__getitem__ if not own else lambda c: own[c] if c in own else known[c]
        return [np.frombuffer(b"".join(map(get, chunks)), np.int32) for chunks in parts]


class Decoder:
    """The bytes that ids stand for."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.tokens = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = PATTERN) -> Codec:
    """One for each vocabulary and worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_column(vocabulary: str, pattern: str = PATTERN):
    """Column function: text to array<int> of ids; null as empty."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            arrays = own.encode([x or "" for x in batch.to_pylist()])
            offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))

    return lambda col: encode(F.col(col).cast("string"))


def _lists(batch: pa.ListArray) -> Iterator[list[int]]:
    """Each list in turn, so that only one is held as Python numbers; a null is empty."""
    if batch.null_count:
        batch = batch.fill_null([])
    values, offsets = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_pylist()
    return (values[a:b].tolist() for a, b in pairwise(offsets))


_DECODERS: dict[str, Decoder] = {}
_DECIMALS: list[bytes] = []


def decoder(vocabulary: str) -> Decoder:
    """One for each vocabulary and worker process."""
    if vocabulary not in _DECODERS:
        _DECODERS[vocabulary] = Decoder(vocabulary)
    return _DECODERS[vocabulary]


def decode_column(vocabulary: str):
    """Column function: array<int> of ids to the bytes they stand for; null as no ids."""

    def decode(batch: pa.Array) -> pa.Array:
        return pa.array(map(decoder(vocabulary).decode, _lists(batch)), pa.binary())

    return lambda col: F.arrow_udf(decode, "binary")(F.col(col))


def ids_digest(ids: list[int]) -> str:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    _DECIMALS.extend(b"%d," % k for k in range(len(_DECIMALS), 1 + max(ids, default=-1)))
    return hashlib.sha256(b"".join(map(_DECIMALS.__getitem__, ids))[:-1]).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and `ids`, an array<int>.

    A null or empty text has no ids. Null and repeated ids pass through, each row on its own. Other
    columns are not read; an empty table gives an empty table. Texts are encoded whole.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), encode_column(vocabulary, pattern)(text_col).alias("ids"))


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of encode_documents with `decoded`, the bytes of the ids; null ids as none. An unknown id fails."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("*", decode_column(vocabulary)("ids").alias("decoded"))


def round_trips(docs: DataFrame, vocabulary: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and tells of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Rows are as those of encode_documents and decode_documents; the ids and bytes stay in the worker
    that made them and only their digests leave it.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, back = codec(vocabulary, pattern), decoder(vocabulary)
        for batch in batches:
            rows = []
            for some in slices([x or "" for x in batch.to_pylist()]):
                for found in encoder.encode(some):
                    ids = found.tolist()
                    rows.append((len(ids), ids_digest(ids), hashlib.sha256(back.decode(ids)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), told(F.col(text_col).cast("string")).alias("t")).select("doc_id", "t.*")
