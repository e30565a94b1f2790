from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest

from shoebox.llm import language_id, quality, queries
from shoebox.llm.session import table

from .data import TEXTS, edges, empty

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


# languages


@pytest.fixture(scope="module")
def model(spark, small):
    return language_id.fit(table(spark, small, "documents"), VOCABULARY)


def test_scores_sum_over_all_segmentations(model):
    chance = {p: model.chances[k + 1] for k, p in enumerate(model.vocabulary)}

    def total(word):
        """By every way to cut the word."""
        out = np.zeros(len(model.languages))
        for cuts in range(1 << (len(word) - 1)):
            parts, start = [], 0
            for k in range(1, len(word) + 1):
                if k == len(word) or cuts >> (k - 1) & 1:
                    parts.append(word[start:k])
                    start = k
            share = np.ones(len(model.languages))
            for p in parts:
                share = share * (chance[p] if p in chance else model.chances[0] if len(p) == 1 else 0)
            out += share
        return out

    words = ["▁the", "▁und", "▁ciónes", "▁a", "▁日本", "▁éeuxê", "x"]
    assert np.allclose(model.word_scores(words), np.log([total(w) for w in words]))


def test_training_raises_the_likelihood():
    table_ = language_id.PieceTable(["a", "ab", "b", "▁", "▁ab"])
    counts = {"▁abab": 5, "▁ba": 1}
    flat = np.full((table_.size, 1), 1 / table_.size)
    learned = language_id._learn(table_, counts)[:, None]
    m = lambda c: language_id.Model(["x"], ["a", "ab", "b", "▁", "▁ab"], c).word_scores(list(counts))[:, 0] @ list(counts.values())
    assert m(learned) > m(flat)
    assert abs(learned.sum() - 1) < 1e-9


def test_long_runs_of_unseen_letters_lose_nothing(model):
    runs = ["字" * 60, "한" * 90, "の" * 119, "字" * 60 + "the" * 19]
    for word in ["▁" + r for r in runs]:
        assert np.allclose(model.word_scores([word])[0], log_forward(model, word), rtol=1e-9)
    scorer = language_id.Scorer(model)
    told = {"en": "the house of the people and the water with their", "de": "der Mann und die Frau gehen nicht mit dem Kind", "fr": "les enfants sont dans la maison avec leur"}
    for name, text in told.items():
        for run in runs:
            (lang,), (score,) = scorer.predict([f"{text} {run} " + " ".join([text] * 20)])
            assert lang == name and 0 < score <= 1


def test_training_bears_long_runs_of_rare_letters():
    letters = [chr(0x4E00 + k) for k in range(30_000)]
    table_ = language_id.PieceTable(letters)
    learned = language_id._learn(table_, {"▁" + "".join(letters[:119]): 2, letters[0]: 1})
    assert np.isfinite(learned).all() and abs(learned.sum() - 1) < 1e-9
    assert learned[1] > learned[2] > learned[200]


def log_forward(model, word):
    """The sum over all segmentations, letter by letter in logs."""
    chance = {p: model.chances[k + 1] for k, p in enumerate(model.vocabulary)}
    logs = [np.zeros(len(model.languages))]
    for end in range(1, len(word) + 1):
        ways = [(k, chance.get(word[k:end], model.chances[0] if end - k == 1 else None)) for k in range(max(0, end - model.table.longest), end)]
        logs.append(np.logaddexp.reduce([logs[k] + np.log(c) for k, c in ways if c is not None]))
    return logs[-1]


def test_whole_documents_against_brute_force(spark, small, model):
    texts = [r.text for r in table(spark, small, "documents").orderBy("doc_id").limit(12).collect() if r.text]
    texts += ["字" * 3000, "の" * 120 + " the end", "한" * 100 + "ก" * 100, "qzxj" * 29, "thening" * 500, "a" * 16 + " " + "ab" * 9 + " " + "abc" * 7]
    known = {}
    names, shares = language_id.Scorer(model).predict(texts)
    for text, name, share in zip(texts, names, shares, strict=True):
        score = sum(known[w] if w in known else known.setdefault(w, log_forward(model, w)) for w in language_id.words(text))
        assert name == model.languages[int(np.argmax(score))]
        assert abs(share - 1 / np.exp(score - score.max()).sum()) < 1e-6


def test_small_caches_change_no_score(model, monkeypatch):
    texts = ["the house of them", "der Mann und " + "x" * 100, "the house und der Hund", "les enfants " + "x" * 100] * 3
    want = language_id.Scorer(model).predict(texts)
    monkeypatch.setattr(language_id, "KEPT_CHUNKS", 3)
    own = language_id.Scorer(model)
    got = [own.predict([t]) for t in texts]
    assert ([n for (n,), _ in got], [round(s, 9) for _, (s,) in got]) == (want[0], [round(s, 9) for s in want[1]])
    assert max(map(len, own.kept)) <= language_id.KEPT_LETTERS


def test_words_of_any_length_have_scores(model):
    names, shares = language_id.Scorer(model).predict(["thening" * 3000, *(c * 10_000 for c in "字ひ한กω\U00010480"), "x" * 10_000])
    assert names[0] == "en" and all(0 <= s <= 1 for s in shares) and set(names) <= set(model.languages)


def test_languages_at_the_edges(spark, model):
    out = {(str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in language_id.identify(edges(spark), model).collect()}
    assert len(language_id.identify(edges(spark), model).collect()) == len(TEXTS)
    for i in ("2", "3", "4"):
        assert (i, "und", 0.0) in out
    assert {lang for i, lang, _ in out if i == "1"} == {"en"}
    assert all(0 <= s <= 1 for *_, s in out)
    assert language_id.identify(empty(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    none = language_id.fit(empty(spark), VOCABULARY)
    assert {r.lang_pred for r in language_id.identify(edges(spark), none).collect()} == {"und"}


def test_held_out_languages(spark, small):
    truth = {r.doc_id: r.lang for r in table(spark, small, "documents").collect()}
    out = queries.op1_language_id(spark, small).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


# quality


def test_the_maxima_are_those_of_a_plain_convolution():
    draw = np.random.default_rng(1)
    net = quality.train([b"good words here.", b"###|||###"], [1, 0])
    for n in (0, 1, 5, 511, 512, 513, 1500):
        text = draw.integers(0, 256, n, dtype=np.uint8).tobytes()
        best, where, rows = net.maxima(text, places=True)
        padded = [*text, *[quality.PAD] * quality.WIDTH]
        plain = np.array([sum(net.filters[j, padded[k + j]] for j in range(quality.WIDTH)) for k in range(max(1, n))])
        want = [plain[c : c + quality.CHUNK].max(0) for c in range(0, len(plain), quality.CHUNK)]
        assert np.allclose(best, want, atol=1e-5)
        assert len(rows) == len(want)


def test_scores_are_those_of_plain_arithmetic():
    """The whole network, byte by byte."""
    import math

    net = quality.train([b"good words here, and more.", b"###|||###"], [1, 0])
    for text in (b"", b"a", "good wörds ".encode() * 120, b"|#" * 700):
        padded = [*text, *[quality.PAD] * quality.WIDTH]
        values = [[sum(float(net.filters[j, padded[k + j], f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for k in range(max(1, len(text)))]
        rows = [[math.tanh(max(v[f] for v in values[c : c + quality.CHUNK]) + float(net.bias[f])) for f in range(quality.FILTERS)] for c in range(0, len(values), quality.CHUNK)]
        pooled = [sum(r[f] for r in rows) / len(rows) for f in range(quality.FILTERS)] + [max(r[f] for r in rows) for f in range(quality.FILTERS)]
        inner = [math.tanh(sum(p * net.hidden[k, h] for k, p in enumerate(pooled)) + net.hidden_bias[h]) for h in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-(sum(x * y for x, y in zip(inner, net.out, strict=True)) + net.out_bias[0])))
        assert abs(net.score(text) - want) < 1e-4


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("good words " if k % 2 else "#|# ") * 20) for k in range(400)] + [(1000, "x" * 5000)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(1000, 1)], "doc_id BIGINT, quality INT")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, weights: seen.append(texts))
    quality.fit(docs, labels, sample_bytes=20_000)
    quality.fit(docs, labels)
    assert 10_000 < sum(map(len, seen[0])) < 30_000 and len(seen[1]) == 401 and max(map(len, seen[0])) < 2000


def test_gradients_are_those_of_differences():
    net = quality.train([b"good words here, and more.", b"###|||###"], [1, 0])
    texts, labels, weights = [b"some words. " * 60, b"|#|" * 20], np.array([1, 0]), (1.0, 2.0)

    def loss():
        p = np.array([net.score(t) for t in texts])
        return float(-(np.where(labels == 1, np.log(p) * weights[1], np.log(1 - p) * weights[0])).mean())

    grads = quality._gradients(net, texts, labels, weights)
    for name in ("hidden", "out", "bias"):
        value = getattr(net, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up = loss()
        value[at] = old - 1e-3
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-5


def test_quality_at_the_edges(spark):
    net = quality.train([b"good words here, and more.", b"###|||###"], [1, 0])
    out = quality.scores(edges(spark), net).collect()
    assert len(out) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert quality.scores(empty(spark), net).count() == 0
    assert {r.score for r in quality.scores(edges(spark), None).collect()} == {0.5}
    kept = quality.drop_poor(edges(spark), net)
    assert kept.columns == edges(spark).columns and kept.count() == sum(r.predicted for r in out)


def test_nothing_to_learn_quality_from(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id BIGINT, quality INT")
    assert quality.fit(edges(spark), labels) is None
    assert quality.fit(empty(spark), spark.createDataFrame([(1, 1), (2, 0)], "doc_id BIGINT, quality INT")) is None


def test_held_out_quality(spark, small):
    truth = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    out = queries.op4_quality(spark, small).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
