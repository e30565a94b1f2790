"""Vocabulary files of byte-level BPE and the split of texts into pre-tokens."""

from __future__ import annotations

import base64
import json
import re
from itertools import batched, islice

import numpy as np
import regex

#: Fixed value: the usual pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space that more white space or the end follows: cutting before it would cut a run of white space.
_RUN = re.compile(r" (?:\s|\Z)")
#: Where a space begins what follows it.
_CUT = re.compile(r"(?= \S)")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in .json vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a blank and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def load_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]]:
    """(vocabulary, merges in order, texts of added tokens) of a .json file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = printable_bytes()
    added = [t["content"] for t in data["added_tokens"]]
    raw = lambda token: bytes(letters[c] for c in token)
    pairs = [x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]]
    vocabulary = {raw(t): k for t, k in data["model"]["vocab"].items() if t not in added}
    return vocabulary, [(raw(a), raw(b)) for a, b in pairs], added


#: Bytes that a worker keeps of chunks it has met, letters of the longest such chunk, and bytes of an entry beside its letters.
KEPT_BYTES, KEPT_LETTERS, ENTRY_BYTES = 96 << 20, 64, 150
#: Letters of the texts that are cut into chunks at once.
SLICE = 1 << 20


def slices(texts: list[str], limit: int = SLICE) -> list[list[str]]:
    """texts in order, some at a time: about `limit` letters together, or one longer text."""
    out: list[list[str]] = []
    held = 0
    for text in texts:
        if not out or held + len(text) > limit:
            out.append([])
            held = 0
        out[-1].append(text)
        held += len(text)
    return out


class PairTable:
    """Maps pairs of ids to a number by binary search in one sorted array."""

    def __init__(self, entries: dict[tuple[int, int], tuple[int, int]]):
        self.base = np.int64(1 << 24)  # above any id, also of tokens that are in no pair
        self.none = np.int64(1 << 40)
        keys = np.fromiter((a * self.base + b for a, b in entries), np.int64, len(entries))
        order = np.argsort(keys)
        values = np.array(list(entries.values()), np.int64).reshape(-1, 2)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(values[order, 0], self.none)
        self.merged = np.append(values[order, 1], 0)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; the rank is `none` where there is no such pair."""
        keys = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, keys)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], self.none), self.merged[at]


class Chunks:
    """Cuts texts at spaces into chunks that pre-tokenize alike wherever they stand, so what is known of a chunk is kept.

    A chunk begins with a space that no white space follows. By PATTERN a pre-token ends before each
    such space: what precedes it is no white space, or a run of it that gives its last one away. Other
    patterns may not end there, so they are refused.
    """

    def __init__(self, pattern: str = PATTERN):
        if pattern != PATTERN:
            raise ValueError("texts are cut by the rule of one pattern, which this isn't")
        self.find = regex.compile(pattern).findall

    def split(self, chunk: str) -> list[str]:
        """A chunk's pre-tokens; plain letters after a space or none are one."""
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        return self.find(chunk)

    def of(self, text: str) -> list[str]:
        if _RUN.search(text):
            return [x for x in _CUT.split(text) if x]
        first, *rest = text.split(" ")
        chunks = [" " + x for x in rest]
        return [first, *chunks] if first else chunks


class Kept:
    """What a worker knows of chunks, in at most KEPT_BYTES: long chunks are never kept, and the older half goes when there are too many."""

    def __init__(self):
        self.of, self.held = {}, 0

    def add(self, found: dict, per_letter: int) -> dict:
        """Keeps what was found of chunks, about per_letter bytes for each letter; gives back what it doesn't keep: long chunks, and all once there is no room until make_room()."""
        own = {}
        for some in batched(found.items(), 1000):
            short = {c: x for c, x in some if len(c) <= KEPT_LETTERS}
            if self.held > KEPT_BYTES:
                own.update(some)
                continue
            self.of.update(short)
            self.held += ENTRY_BYTES * len(short) + (4 + per_letter) * sum(map(len, short))
            if len(short) < len(some):
                own.update((c, x) for c, x in some if len(c) > KEPT_LETTERS)
        return own

    def make_room(self) -> None:
        if self.held > KEPT_BYTES:
            self.of = dict(islice(self.of.items(), len(self.of) // 2, None))
            self.held //= 2
