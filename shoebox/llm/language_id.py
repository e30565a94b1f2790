"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, by a forward pass over its letters; a text's is the
product over its words. Pieces don't cross words, so the sum over all segmentations of a text is
exactly that product, and each distinct word is scored once. The forward values are scaled as they go,
each language's on its own, so words of any length and rarity have a sum.

The piece probabilities come from expectation maximisation over the words of a sample of labelled
texts, whose expected size SAMPLE_BYTES bounds for each language; each language is learned in a task
of its own.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_pairs import slices
from .session import bounded_batches, scratch, work_path, written

#: Expected bytes of labelled text that are learned from, for each language.
SAMPLE_BYTES = 4_000_000
ROUNDS = 3
#: Letters of the longest word that is learned from.
LEARNED_LETTERS = 10_000
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Forward values below this are scaled up, and are looked at every so many letters.
TINY, LOOK = 1e-100, 4
#: Letters of a word whose pieces are held at once.
BLOCK = 2048
#: Chunks whose scores a worker keeps, and the letters of the longest one that is kept.
KEPT_CHUNKS, KEPT_LETTERS = 200_000, 64
#: Letters of distinct words that go through the forward pass together.
PASS_LETTERS = 100_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters in lower case, each after a word mark."""
    return ["▁" + word for word in _WORDS.findall(text.lower())]


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces, without control and byte pieces, in lower case."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    some = (sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)))
    return sorted({p.lower() for p in some if p.strip("▁") or p == "▁"})


class PieceTable:
    """Finds the pieces inside words, for many words at once. Number 0 stands for a letter that is no piece."""

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary))
        self.size = len(vocabulary) + 1
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            own = [(k + 1, p) for k, p in enumerate(vocabulary) if len(p) == n]
            codes = np.array([list(map(ord, p)) for _, p in own], np.uint64).reshape(len(own), n)
            hashes = self._start(codes[:, 0]) if own else np.empty(0, np.uint64)
            for j in range(1, n):
                hashes = self._more(hashes, codes[:, j])
            order = np.argsort(hashes)
            self.by_length.append((np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(np.array([k for k, _ in own], np.int64)[order], 0)))

    @staticmethod
    def _start(code: np.ndarray) -> np.ndarray:
        return (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _more(hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (code + np.uint64(1)) * np.uint64(0x94D049BB133111EB)

    def inside(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """codes: one word per row, all of one length. For each piece length n, the piece at every start (-1: none)."""
        hashes = self._start(codes)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            if n > 1:
                hashes = self._more(hashes[:, :-1], codes[:, n - 1 :])
            keys, numbers = self.by_length[n - 1]
            slot = np.searchsorted(keys, hashes)
            found = keys[slot] == hashes
            yield n, np.where(found, numbers[slot], 0 if n == 1 else -1)


def grouped(distinct: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the words, their letters as rows, their lengths) for words of like length, some at a time; the rows are padded with a letter that is in no piece."""
    lengths = np.array([len(w) for w in distinct], np.int64)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        # short words of one length, longer ones of up to a quarter more
        longest = int(lengths[order[start]] * (1.25 if lengths[order[start]] >= 16 else 1))
        stop = int(np.searchsorted(lengths[order], longest, "right"))
        stop = min(stop, start + max(1, PASS_LETTERS // longest))
        part = order[start:stop]
        n = int(lengths[part].max())
        codes = np.frombuffer("".join(distinct[k].ljust(n, "\0") for k in part).encode("utf-32-le"), np.uint32)
        yield part, codes.reshape(len(part), n).astype(np.uint64), lengths[part]
        start = stop


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[str]
    chances: np.ndarray  # piece x language

    def __post_init__(self):
        self.table = PieceTable(self.vocabulary)

    def word_scores(self, distinct: list[str]) -> np.ndarray:
        """log probability of each word in each language, over all segmentations."""
        out = np.zeros((len(distinct), len(self.languages)))
        if not self.languages:
            return out
        chances = np.vstack([self.chances, np.zeros(len(self.languages))])
        for part, codes, lengths in grouped(distinct):
            for end, value, shift in _forward(self.table, codes, chances):
                done = lengths == end
                if done.any():
                    out[part[done]] = np.log(value[done]) - shift[done]
        return out


def _forward(table: PieceTable, codes: np.ndarray, chances: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of letters, the sum over the segmentations of so many letters of each word in each language: (letters, value, shift), where exp(-shift) * value is the sum.

    The last row of chances is for no piece (-1). Memory doesn't grow with the words' length.
    """
    count, n = codes.shape
    steps = ((begin, max(0, begin - table.longest)) for begin in range(0, n, BLOCK))
    parts = ((low, begin, [p for _, p in table.inside(codes[:, low : begin + BLOCK])]) for begin, low in steps)
    where = ((end, [p[:, end - size - low] for size, p in enumerate(at, 1) if size <= end]) for low, begin, at in parts for end in range(begin + 1, min(n, begin + BLOCK) + 1))
    yield from _sums(where, count, chances, table.longest)


def _backward(table: PieceTable, codes: np.ndarray, chances: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As _forward, for the letters from each place to the end, the last place first."""
    count, n = codes.shape
    at = [p for _, p in table.inside(codes)]
    where = ((start, [p[:, start] for p in at[: n - start]]) for start in range(n - 1, -1, -1))
    yield from _sums(where, count, chances, table.longest)


def _sums(where: Iterable[tuple[int, list[np.ndarray]]], count: int, chances: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """where: at each place, for each size, the piece of that size that leads to the place `size` steps before."""
    past = deque([np.ones((count, chances.shape[1]))], longest)  # past[-size]: the value `size` steps before
    shift = np.zeros((count, chances.shape[1]))
    for step, (place, piece_of) in enumerate(where):
        value = past[-1] * chances[piece_of[0]]
        for size, piece in enumerate(piece_of[1:], 2):
            some = np.flatnonzero(piece >= 0)
            if 2 * len(some) > count:
                value += past[-size] * chances[piece]
            elif len(some):
                value[some] += past[-size][some] * chances[piece[some]]
        past.append(value)
        if step % LOOK == LOOK - 1 and (small := value < TINY).any():
            factor = np.where(small, 1 / value, 1.0)
            past = deque((p * factor for p in past), longest)
            shift = shift + np.log(factor)
        yield place, past[-1], shift


def _expected(table: PieceTable, codes: np.ndarray, weight: np.ndarray, chances: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected number of each piece in weighted words of one length to total (one language)."""
    column = np.append(chances, 0.0)[:, None]
    count, n = codes.shape
    before, after = np.ones((n + 1, count)), np.ones((n + 1, count))
    shift_before, shift_after = np.zeros((n + 1, count)), np.zeros((n + 1, count))
    for place, value, shift in _forward(table, codes, column):
        before[place], shift_before[place] = value[:, 0], shift[:, 0]
    for place, value, shift in _backward(table, codes, column):
        after[place], shift_after[place] = value[:, 0], shift[:, 0]
    scale = weight / before[n]
    for size, piece in table.inside(codes):
        inside = before[: n + 1 - size] * after[size:] * np.exp(shift_before[n] - shift_before[: n + 1 - size] - shift_after[size:])
        share = inside.T * column[piece, 0] * scale[:, None]
        known = piece >= 0
        total += np.bincount(piece[known], share[known], len(total))


def _learn(table: PieceTable, counts: dict[str, int]) -> np.ndarray:
    distinct = [w for w in counts if len(w) <= LEARNED_LETTERS]
    weights = np.array([counts[w] for w in distinct], float)
    chances = np.full(table.size, 1.0 / table.size)
    for _ in range(ROUNDS):
        total = np.full(table.size, SMOOTHING)
        for part, codes, lengths in grouped(distinct):
            for n in np.unique(lengths):
                own = lengths == n
                _expected(table, codes[own, :n], weights[part[own]], chances, total)
        chances = total / total.sum()
    return chances


def fit(labelled: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from rows with a text and a language; of a language with more text, from a share picked by the hash of the id.

    Words of over LEARNED_LETTERS letters aren't learned from. No labelled row gives a model without
    languages, which finds none. The model holds one number for each piece and language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    with scratch(spark):
        return _fitted(rows, vocabulary, sample_bytes)


def _fitted(rows: DataFrame, vocabulary: str, sample_bytes: int) -> Model:
    spark = rows.sparkSession
    sizes = written(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")), work_path(spark, "sizes"))
    shares = sizes.select("lang", F.least(F.lit(1.0), sample_bytes / F.greatest(F.lit(1), "n")).alias("share"))
    picked = rows.join(shares, "lang").where((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word in words(text):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def learn(of: pa.Table) -> pa.Table:
        chances = _learn(PieceTable(pieces(vocabulary)), dict(sorted(zip(of["word"].to_pylist(), of["n"].to_pylist(), strict=True))))
        return pa.table({"lang": of["lang"].slice(0, 1), "chances": pa.array([chances.tolist()], pa.list_(pa.float64()))})

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a language's words are those of sample_bytes of text, so one task can hold them
    learned = counted.groupBy("lang").applyInArrow(learn, "lang string, chances array<double>")
    chances = {r.lang: np.array(r.chances) for r in learned.collect()}  # a row for each language, all learned at once
    known = pieces(vocabulary)
    table_size = len(known) + 1
    for r in sizes.select("lang").toLocalIterator():  # texts without a word teach nothing
        chances.setdefault(r.lang, np.full(table_size, 1.0 / table_size))
    names = sorted(chances)
    return Model(names, known, np.stack([chances[name] for name in names], 1) if names else np.ones((table_size, 0)))


class Scorer:
    """Predicts whole texts; keeps the scores of short chunks between white space that it has met."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """(language, its share of the probability); und and 0 where there is no letter or no model."""
        names, shares = [], []
        for some in slices(texts):
            a, b = self._predict(some)
            names += a
            shares += b
        return names, shares

    def _predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Slots of chunks that are kept come first, then those of this call alone."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        if not self.kept:
            self.scores, self.used = np.zeros((1 << 10, len(self.model.languages))), 0
        kept, own = self.kept, {}
        parts = [t.split() for t in texts]
        for p in parts:
            own.update((c, 0) for c in p if c not in kept)
        if own:
            new = sorted(own, key=len)
            inside = [words(c) for c in new]
            distinct = list({w for ws in inside for w in ws})
            number = {w: k for k, w in enumerate(distinct)}
            of = self.model.word_scores(distinct)
            owner = np.repeat(np.arange(len(new)), [len(ws) for ws in inside])
            flat = np.array([number[w] for ws in inside for w in ws], np.int64)
            need = self.used + len(new)
            if need > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(need, 2 * len(self.scores)) - len(self.scores), of.shape[1]))])
            for j in range(of.shape[1]):
                self.scores[self.used : need, j] = np.bincount(owner, of[flat, j], len(new))
            own = {c: k for k, c in enumerate(new, self.used)}
            for c, k in own.items():
                if len(c) <= KEPT_LETTERS:
                    kept[c] = k
                    self.used = k + 1
        names, shares = [], []
        for text, chunks in zip(texts, parts, strict=True):
            if not self.model.languages or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                shares.append(0.0)
                continue
            score = self.scores[np.fromiter((kept[c] if c in kept else own[c] for c in chunks), np.int64, len(chunks))].sum(0)
            best = int(score.argmax())
            names.append(self.model.languages[best])
            shares.append(float(1.0 / np.exp(score - score[best]).sum()))
        return names, shares


_SCORERS: dict[int, Scorer] = {}


def predict_column(model: Model, col: Column) -> Column:
    """struct<lang_pred, score> of a text column."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(model)
    key = sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _SCORERS:  # one for each model and worker process
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        for batch in batches:
            names, shares = _SCORERS[key].predict([x or "" for x in batch.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(col.cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the language's share of the probability, 0 to 1).

    lang_pred is `und` with score 0 for null and empty texts and those without a letter. Texts are
    read whole; ties go to the language first in order. Repeated rows and null ids pass through;
    other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), predict_column(model, F.col(text_col)).alias("p")).select("doc_id", "p.*")
