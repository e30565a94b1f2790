from __future__ import annotations

import random
import re

import numpy as np

from shoebox.llm import decontaminate

from .data import TEXTS, edges, empty


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        windows += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(item)} - {"None"}
        out.append((str(i), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def shown(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows)


def made(seed):
    """Texts of few words, so that windows of all lengths occur, repeat and overlap."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("aabBc") for _ in range(n))
    items = [(k, text(draw.choice((1, 3, 7, 12, 13, 14, 25)))) for k in range(12)] + [(3, text(20)), (None, text(13)), (99, None), (98, "... !"), (97, "")]
    docs = [(k, text(draw.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, text(20) + " X-Y " + (items[k][1] or "").upper() + "; é " + text(9)) for k in range(len(items))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")


def test_every_window_is_found(spark):
    for seed in (1, 2):
        docs, items = made(seed)
        items = [x for x in items if len(words(x[1])) != 1]  # one common word would hit everything
        want = brute(docs, items)
        assert shown(decontaminate.decontaminate(*frames(spark, docs, items))) == want
        assert {c for *_, c in want} == {True, False}


def test_dropping(spark):
    docs, items = made(5)
    d, b = frames(spark, docs, items)
    out = decontaminate.drop_contaminated(d, b)
    assert {str(r.doc_id) for r in out.collect()} == {str(i) for i, *_, bad in brute(docs, items) if not bad} and out.columns == d.columns


def test_a_full_filter_finds_the_same(spark, monkeypatch):
    docs, items = made(5)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)  # every bit is set: the join alone decides
    assert shown(decontaminate.decontaminate(*frames(spark, docs, items))) == brute(docs, items)


def test_the_benchmark_is_joined_not_sent(spark, monkeypatch):
    """The driver sees bits alone, however many items there are."""
    docs, items = made(5)
    seen = []
    plain = decontaminate._finder
    monkeypatch.setattr(decontaminate, "_finder", lambda spark, lengths, words: seen.append((lengths, words.nbytes)) or plain(spark, lengths, words))
    d, b = frames(spark, docs, items + [(1000 + k, f"w{k} " * 3 + f"v{k} " * 20) for k in range(2000)])
    assert shown(decontaminate.decontaminate(d, b)) == brute(docs, items)
    (lengths, size), = seen
    assert max(lengths) == decontaminate.WINDOW and size == decontaminate.FILTER_BITS // 8


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcé-") for _ in range(draw.choice((1, 3, 9, 300)))) for _ in range(n)) for n in (0, 1, 50, 400)] + ["", "x" * 5000, " " * 700]
    raw = [t.encode() for t in texts]
    hashes, sizes = decontaminate.word_hashes(raw)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        got = decontaminate.word_hashes(raw)
        assert got[0].tolist() == hashes.tolist() and got[1].tolist() == sizes.tolist()
    assert decontaminate.word_hashes([])[1].tolist() == []


def test_words_hash_alike_wherever_they_stand():
    texts = ["Ab c-ab  x", "", "...", "ab", "é1 É a\x00b " + "z" * 3000 + " ab"]
    hashes, sizes = decontaminate.word_hashes([t.encode() for t in texts])
    all_words = [w for t in texts for w in words(t)]
    assert sizes.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(all_words, hashes.tolist(), strict=True))) == len(set(all_words)) == len(set(hashes.tolist()))


def test_edges(spark):
    items = [(1, TEXTS[0][1]), (2, TEXTS[0][1]), (3, None)]
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert shown(decontaminate.decontaminate(edges(spark), b)) == brute(TEXTS, items)
    assert decontaminate.decontaminate(empty(spark), b).count() == 0
    none = b.limit(0)
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.decontaminate(edges(spark), none).collect())
    assert decontaminate.drop_contaminated(edges(spark), none).count() == len(TEXTS)
    assert decontaminate.drop_contaminated(edges(spark), b).columns == edges(spark).columns


def test_slices_change_nothing(spark, monkeypatch):
    docs, items = made(9)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 10)
    found = decontaminate.Hits([1, 7, 13], np.full(decontaminate.FILTER_BITS // 64, decontaminate._NONE))
    texts = [(t or "").encode() for _, t in docs]
    some = found.find(texts)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 1 << 20)
    assert [(n, r.tolist()) for n, r in some] == [(n, r.tolist()) for n, r in found.find(texts)]
    assert [n for n, _ in some] == [len(words(t)) for _, t in docs]
    assert all(len(r) == sum(max(0, n - k + 1) for k in (1, 7, 13)) for n, r in some)
