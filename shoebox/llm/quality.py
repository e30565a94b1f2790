"""Quality scores by a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole document, chunk by chunk; a chunk reaches WIDTH - 1 bytes
into the next, so no place is skipped. Each filter keeps its maximum in each chunk. The mean and the
maximum of these over the chunks go through one hidden layer to a probability. As only the places of
the maxima carry gradients, a training step costs little more than a forward pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, free_names, scratch, work_path, written

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 16, 16, 512
#: Labelled rows that are learned from, for each label, and bytes of text of them all (expected numbers). A text of over a tenth of the bytes isn't learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64_000_000
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: In each epoch every training text is learned whole, and once more as a passage of so many bytes: short texts are to be learned too.
SHORTEST, LONGEST = 20, 600
#: Chunks that pass through the filters at once.
AT_ONCE = 16
PAD = 256
#: A document is good from this score on.
GOOD = 0.3


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 257 x FILTERS; the last byte value is padding
    bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def maxima(self, text: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(maximum of each filter in each chunk, its place in the chunk, the chunks' bytes). An empty text is one chunk of padding."""
        rows = chunks(text)
        count = max(1, len(text))
        best = np.empty((len(rows), FILTERS), np.float32)
        where = np.empty((len(rows), FILTERS), np.int64) if places else None
        for start in range(0, len(rows), AT_ONCE):
            part = rows[start : start + AT_ONCE]
            total = np.take(self.filters[0], part[:, :CHUNK], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.filters[j], part[:, j : j + CHUNK], axis=0)
            if start + len(part) == len(rows):
                total[-1, count - (len(rows) - 1) * CHUNK :] = -np.inf
            if places:
                where[start : start + len(part)] = total.argmax(1)
            best[start : start + len(part)] = total.max(1)
        return best, where, rows

    def score(self, text: bytes) -> float:
        return float(self._top(self._pooled(self.maxima(text)[0])[None])[0][0])

    def _pooled(self, best: np.ndarray) -> np.ndarray:
        kept = np.tanh(best + self.bias)
        return np.concatenate([kept.mean(0), kept.max(0)])

    def _top(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(pooled @ self.hidden + self.hidden_bias)
        return 1 / (1 + np.exp(-(inner @ self.out + self.out_bias[0]))), inner


def chunks(text: bytes) -> np.ndarray:
    """The bytes as rows of CHUNK + WIDTH - 1, each beginning CHUNK after the one before; the end is padded."""
    n = max(1, -(-len(text) // CHUNK))
    data = np.full(n * CHUNK + WIDTH - 1, PAD, np.int64)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK + WIDTH - 1)[::CHUNK]


def train(texts: list[bytes], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> Network:
    """Fits by Adam on the weighted log loss; the same rows in the same order give the same network."""
    draw = np.random.default_rng(seed)
    net = Network(
        np.concatenate([draw.normal(0, 0.4, (WIDTH, PAD, FILTERS)), np.zeros((WIDTH, 1, FILTERS))], 1).astype(np.float32),
        np.full(FILTERS, -1.5, np.float32),
        draw.normal(0, 0.3, (2 * FILTERS, HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, 0.3, HIDDEN),
        np.zeros(1),
    )
    names = ("filters", "bias", "hidden", "hidden_bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k), np.float64) for k in names}
    second = {k: np.zeros_like(getattr(net, k), np.float64) for k in names}
    step = 0
    for epoch in range(EPOCHS):
        seen = [*texts, *(_passage(t, draw) for t in texts)]
        order = draw.permutation(len(seen))
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(order), BATCH):
            step += 1
            own = order[start : start + BATCH]
            grads = _gradients(net, [seen[k] for k in own], np.array([labels[k % len(texts)] for k in own]), weights)
            for k in names:
                g = grads[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                getattr(net, k)[...] -= change.astype(getattr(net, k).dtype)
    return net


def _passage(text: bytes, draw: np.random.Generator) -> bytes:
    """Words in a row from anywhere in the text."""
    size = int(np.exp(draw.uniform(np.log(SHORTEST), np.log(LONGEST))))
    if len(text) <= size:
        return text
    start = int(draw.integers(0, len(text) - size))
    start = text.rfind(b" ", 0, start) + 1
    end = text.find(b" ", start + size)
    return text[start:] if end < 0 else text[start:end]


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weights: tuple[float, float]) -> dict[str, np.ndarray]:
    seen = [net.maxima(t, places=True) for t in texts]
    kept = [np.tanh(best + net.bias) for best, _, _ in seen]
    pooled = np.stack([np.concatenate([k.mean(0), k.max(0)]) for k in kept])
    chance, inner = net._top(pooled)
    error = (chance - labels) * np.where(labels == 1, weights[1], weights[0]) / len(texts)
    back = np.outer(error, net.out) * (1 - inner**2)
    grads = {"out": inner.T @ error, "out_bias": np.array([error.sum()]), "hidden": pooled.T @ back, "hidden_bias": back.sum(0)}
    to_pool = back @ net.hidden.T
    filters, bias = np.zeros_like(net.filters, np.float64), np.zeros(FILTERS)
    columns = np.arange(FILTERS)
    for (_, where, rows), value, up in zip(seen, kept, to_pool, strict=True):
        share = np.repeat(up[None, :FILTERS] / len(value), len(value), 0)
        share[value.argmax(0), columns] += up[FILTERS:]
        share *= 1 - value**2
        bias += share.sum(0)
        owner = np.arange(len(rows))[:, None]
        for j in range(WIDTH):
            np.add.at(filters[j], (rows[owner, where + j], columns[None]), share)
    filters[:, PAD] = 0
    return grads | {"filters": filters, "bias": bias}


def _share(col: str, share: Column) -> Column:
    """Whether a row is among the share that the hash of its id picks."""
    return F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(1 << 20)) / (1 << 20) < share


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Learns from about `rows` labelled documents of each label and about sample_bytes of text, picked by the hash of the id; None where a label has no document.

    Rows without label, id or text are not learned from, nor are texts of over a tenth of
    sample_bytes; of several labels for an id the least counts.
    """
    spark = docs.sparkSession
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r.y: r.n for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = {y: min(1.0, rows / sizes[y]) for y in (0, 1)}
    picked = given.where(_share("id", F.when(F.col("y") == 1, part[1]).otherwise(part[0])))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").where(F.octet_length("t") <= sample_bytes // 10).join(F.broadcast(picked), "id")
    with scratch(spark):
        found = written(found, work_path(spark, "labelled"))
        total_bytes = found.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        less = min(1.0, sample_bytes / max(1, total_bytes))
        found = found.where(_share("id", F.when(F.col("y") == 1, part[1] * less).otherwise(part[0] * less)))
        got = sorted((r.id, r.t.encode(), r.y) for r in found.collect())
    seen = [sum(y == k for *_, y in got) for k in (0, 1)]
    if not all(seen):
        return None
    total = sizes[0] + sizes[1]
    weights = tuple(sizes[k] / total * len(got) / seen[k] for k in (0, 1))
    return train([t for _, t, _ in got], [y for *_, y in got], weights)


def score_column(net: Network | None, col: Column) -> Column:
    """Score of a text column: likelihood of label 1, between 0 and 1; one half where there is no network. Null is empty."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(net)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in batches:
            yield pa.array([0.5 if own is None else own.score(x or b"") for x in batch.cast(pa.binary()).to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")(col.cast("string"))


def scores(docs: DataFrame, net: Network | None, threshold: float = GOOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted (1 from the threshold on).

    Null and empty texts have the score of no bytes. Texts are read whole, in memory that doesn't
    grow with them but for the text itself. Repeated rows and null ids pass through; other columns
    aren't read.
    """
    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(net, F.col(text_col)).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, net: Network | None, threshold: float = GOOD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    (name,) = free_names(docs, "__score")
    return docs.withColumn(name, score_column(net, F.col("text"))).where(F.col(name) >= threshold).drop(name)
