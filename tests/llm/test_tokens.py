from __future__ import annotations

import base64
import hashlib
import random
import time
from itertools import batched

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoebox.llm import bpe, byte_pairs, queries, token_count

from .data import TEXTS, edges, empty

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
MERGES = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter(MERGES)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


def odd_texts():
    random.seed(4)
    out = ["", " ", "  ", "a   b", "x \n y", "x\n\n\n  y  ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "don't we'll 'S", "a" * 999, "é" * 300, "\x1c a\x1fb \x85 x﻿"]
    out += ["".join(random.choice(" \t\nab1!é'st　\xa0\x1c.") for _ in range(random.randint(1, 60))) for _ in range(800)]
    return out + [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}x" for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]


def test_counts_are_the_librarys(counter):
    texts = odd_texts()
    assert counter.count(texts) == [len(e.ids) for e in Tokenizer.from_file(MERGES).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(codec, library):
    texts = odd_texts()
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, counter, library, text):
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert counter.count([text]) == [len(Tokenizer.from_file(MERGES).encode(text, add_special_tokens=False).ids)] if text else True


def test_long_pieces(codec, counter, library):
    text = "ab" * 20_000
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert counter.count([text])[0] == len(Tokenizer.from_file(MERGES).encode(text, add_special_tokens=False).ids)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT_BYTES", 800)
    monkeypatch.setattr(byte_pairs, "batched", lambda items, n: batched(items, 1))
    own, counts = bpe.Codec(RANKS), token_count.TokenCounter(MERGES)
    for text in ("one two three four five six seven", "one two nine ten", "six seven", "x" * 99 + " one", "seven eight"):
        assert own.encode([text, text])[1].tolist() == library.encode_ordinary(text)
        assert counts.count([text, text])[1] == len(Tokenizer.from_file(MERGES).encode(text, add_special_tokens=False).ids)
    assert own.kept.held < 1600 and counts.kept.held < 1600


def test_texts_with_runs_of_blanks_are_cut_and_never_kept_whole(library):
    random.seed(5)
    lines = [" " * random.randint(0, 12) + f"x{k} = f(y{k % 7},  {k})\t# {'z' * random.randint(0, 80)}" for k in range(4000)]
    texts = ["\n".join(random.sample(lines, 400)) + "   " for _ in range(40)]
    own = bpe.Codec(RANKS)
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert max(map(len, own.kept.of)) <= byte_pairs.KEPT_LETTERS and max(map(len, own.chunks.of(texts[0]))) < 200
    counts = token_count.TokenCounter(MERGES)
    assert counts.count(texts) == [len(e.ids) for e in Tokenizer.from_file(MERGES).encode_batch(texts, add_special_tokens=False)]


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.Chunks(r"\S+|\s+")


def test_one_long_piece_costs_seconds(codec, counter, library):
    random.seed(6)
    text = "".join(random.choice("abcdefghijklmnopqrstuvwxyzéäö") for _ in range(100_000))
    began = time.time()
    ids = codec.encode([text])[0].tolist()
    assert time.time() - began < 20
    assert codec.encode(["x" * 4097, text[:3000], text[5:3333]])[1].tolist() == library.encode_ordinary(text[:3000])
    assert b"".join(codec.bpe.encode([text[:700].encode(), text[1:702].encode(), text[2:650].encode(), text[3:720].encode()])[:1]) == codec.bpe._merge_one(text[:700].encode(), 1024)
    assert bpe.Decoder(RANKS).decode(ids) == text.encode() and ids[:200] == library.encode_ordinary(text[:3000])[:200]
    assert counter.count([text[:20_000]]) == [len(Tokenizer.from_file(MERGES).encode(text[:20_000], add_special_tokens=False).ids)]


def test_slices_keep_all_texts_in_order():
    texts = ["a" * n for n in (0, 5, 3, 20, 0, 1, 9, 10)]
    for limit in (1, 8, 10, 100):
        assert [t for some in byte_pairs.slices(texts, limit) for t in some] == texts
        assert all(len(some) == 1 or sum(map(len, some)) <= limit for some in byte_pairs.slices(texts, limit))
    assert byte_pairs.slices([]) == []


def test_ids_and_bytes_as_columns(spark, library):
    docs = edges(spark)
    encoded = bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in encoded) == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    none = spark.createDataFrame([(None,), ([],)], "ids ARRAY<INT>")
    assert [bytes(r.decoded) for r in bpe.decode_documents(none, RANKS).collect()] == [b"", b""]


def test_a_table_of_counts(spark):
    out = token_count.token_counts(edges(spark), MERGES).collect()
    library = Tokenizer.from_file(MERGES)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in out)
    assert token_count.token_counts(empty(spark), MERGES).count() == 0


def test_a_table_of_ids(spark, library):
    out = queries.bpe_digests(edges(spark)).collect()
    want = []
    for i, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    assert queries.bpe_digests(empty(spark)).count() == 0


def test_the_queries_over_documents(spark, small, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    counts = Tokenizer.from_file(MERGES)
    for r in queries.op5_token_counts(spark, small).collect():
        assert r.n_tokens == len(counts.encode(docs[r.doc_id], add_special_tokens=False).ids)
    for r in queries.op8_bpe(spark, small).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary(docs[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
