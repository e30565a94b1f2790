"""Search and classification by unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from .rollups import mean_vectors

UNCLASSIFIED = "미분류"
MAX_PROMPTS = 10_000


def scored(vectors: DataFrame, query: list[float], col: str = "embedding") -> DataFrame:
    """vectors with `score`, the cosine to one query vector. The query is a literal: no join."""
    terms = [F.get(col, F.lit(k)).cast("double") * F.lit(float(x)) for k, x in enumerate(query)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t  # plain arithmetic in order: generated code, unlike a lambda over the array
    return vectors.withColumn("score", total)


def top_k(vectors: DataFrame, query: list[float], k: int, allow: DataFrame | None = None, min_score: float | None = None, id_col: str = "media_id") -> DataFrame:
    """(id, score) of the k nearest, ties by id; of allow(id) only where given; none for k <= 0."""
    rows = vectors if allow is None else vectors.join(allow.select(id_col).distinct(), id_col, "left_semi")
    rows = scored(rows.where("embedding IS NOT NULL"), query).select(id_col, "score")
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.orderBy(F.col("score").desc(), id_col).limit(max(k, 0))


def similar_to(vectors: DataFrame, item: int, k: int, min_score: float, id_col: str = "media_id") -> DataFrame:
    """The k nearest others of an item, then those of at least min_score; none for an item without a vector."""
    row = vectors.where((F.col(id_col) == item) & F.col("embedding").isNotNull()).select("embedding").first()
    if row is None:
        return vectors.select(id_col, F.lit(0.0).alias("score")).limit(0)
    return top_k(vectors.where(F.col(id_col) != item), list(row[0]), k, id_col=id_col).where(F.col("score") >= min_score)


def upserted(index: DataFrame, changes: DataFrame, id_col: str = "media_id") -> DataFrame:
    """index(id, embedding) after changes(id, embedding, seq): the last change of an id wins; a null vector removes it."""
    last = changes.groupBy(id_col).agg(F.max_by("embedding", "seq").alias("embedding"))
    return index.join(last.select(id_col), id_col, "left_anti").select(id_col, "embedding").unionByName(last.where("embedding IS NOT NULL"))


def prompt_matrix(prompts: DataFrame) -> DataFrame:
    """(family, parent, label, vector) from prompts(family, parent, label, embedding), several per label: the mean over its length."""
    keyed = prompts.withColumn("k", F.struct("family", "parent", "label"))
    return mean_vectors(keyed, "k").select("k.*", "vector")


def classify(media: DataFrame, prompts: DataFrame, params: Params, primary_only: tuple[str, ...] = (), thresholds: dict[str, float] | None = None) -> DataFrame:
    """(media_id, pos, label, score, kind) for each item with a vector.

    The likeliest category is always given, as unclassified if it is too unlikely; then further
    likely ones, then the likeliest kind of the first category, then all attributes over their
    thresholds. prompts(family, parent, label, vector): families category, sub, attribute; a
    configuration of at most MAX_PROMPTS rows, sent to the workers as one matrix, so that an item meets
    all prompts where it is and no item is shuffled.
    """
    some = prompts.select("family", F.coalesce("parent", F.lit("")).alias("parent"), "label", "vector").limit(MAX_PROMPTS + 1).collect()
    if len(some) > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} prompts")
    some.sort(key=lambda r: (r.family, r.parent, r.label))
    column = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    family, parent, label = (column([r[k] for r in some], "string") for k in ("family", "parent", "label"))
    least = column([(thresholds or {}).get(r.label, params.attr_min_score) for r in some], "double")
    rows = media.where("embedding IS NOT NULL").select("media_id", _cosines(np.array([r.vector for r in some], np.float64))("embedding").alias("cosines"))
    scored = rows.select("media_id", F.transform("cosines", lambda c, k: F.struct(F.get(family, k).alias("family"), F.get(parent, k).alias("parent"), F.get(label, k).alias("label"), c.alias("cosine"), F.get(least, k).alias("least"))).alias("s"))
    likely = scored.select("media_id", "s", _likeliest(F.filter("s", lambda p: p["family"] == "category"), params.logit_scale).alias("cat"))
    first = F.get("cat", F.lit(0))
    sub = likely.select("media_id", "s", "cat", F.when(first["p"] >= params.min_score, first["label"]).alias("sure"))
    own = F.filter("s", lambda p: (p["family"] == "sub") & (p["parent"] == F.col("sure")))
    sub = sub.withColumn("sub", F.get(_likeliest(own, params.logit_scale), F.lit(0)))
    given = lambda pos, label, score, kind: F.struct(pos.cast("int").alias("pos"), label.alias("label"), score.alias("score"), F.lit(kind).alias("kind"))
    head = F.when(F.size("cat") > 0, given(F.lit(0), F.coalesce("sure", F.lit(UNCLASSIFIED)), first["p"], "category"))
    ranked = F.transform(F.slice("cat", 1, params.max_categories), lambda c, k: F.struct(k.alias("k"), c["label"].alias("label"), c["p"].alias("p")))
    more = F.filter(ranked, lambda c: (c["k"] > 0) & (c["p"] >= params.secondary_min_score) & ~F.coalesce(c["label"].isin(*primary_only), F.lit(False)))
    more = F.transform(more, lambda c: given(c["k"], c["label"], c["p"], "secondary"))
    kind = F.when(F.col("sub")["p"] >= params.sub_min_score, given(F.lit(100), F.col("sub")["label"], F.col("sub")["p"], "sub"))
    traits = F.transform(F.filter("s", lambda p: (p["family"] == "attribute") & (p["cosine"] >= p["least"])), lambda p: given(F.lit(200), p["label"], p["cosine"], "attribute"))
    every = F.filter(F.concat(F.array(head), more, F.array(kind), traits), lambda x: x.isNotNull())
    return sub.select("media_id", F.explode(every).alias("x")).select("media_id", "x.*")


def _cosines(matrix: np.ndarray):
    """Column function: a vector's products with the rows of a matrix, in order; a vector of another length has none."""

    def products(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wide = matrix.shape[1] if len(matrix) else -1
        for batch in batches:
            flat, offsets = batch.values.to_numpy(zero_copy_only=False).astype(np.float64), batch.offsets.to_numpy()
            fits = np.diff(offsets) == wide
            rows = flat[(offsets[:-1][fits, None] + np.arange(max(wide, 0))).ravel()].reshape(-1, max(wide, 0))
            sizes = np.where(fits, len(matrix), 0)
            found = (rows @ matrix.T).ravel() if len(rows) else np.empty(0)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found, pa.float64()))

    return F.arrow_udf(products, "array<double>")


def _likeliest(prompts: Column, scale: float) -> Column:
    """array<struct<order, label, p>> of prompts with a cosine, likeliest first: p is the share by the exponential of scale times cosine."""
    top = F.array_max(F.transform(prompts, lambda p: p["cosine"])) * scale
    weighed = F.transform(prompts, lambda p: F.struct(p["label"].alias("label"), F.exp(p["cosine"] * scale - top).alias("w")))
    total = F.aggregate(weighed, F.lit(0.0), lambda t, p: t + p["w"])
    return F.array_sort(F.transform(weighed, lambda p: F.struct((-p["w"] / total).alias("order"), p["label"].alias("label"), (p["w"] / total).alias("p"))))


def vote(frame_tags: DataFrame, share: float = 0.4, most: int = 5, unclassified: str = UNCLASSIFIED) -> DataFrame:
    """(media_id, place, label, votes, score) from frame_tags(media_id, time_ms, pos, label, score); pos 0 is a frame's first category.

    A label needs the votes of that share of the frames. If no such label was ever a frame's first,
    the most frequent first one is added, or unclassified if there is no other.
    """
    frames = frame_tags.groupBy("media_id").agg(F.countDistinct("time_ms").alias("n"))
    per = frame_tags.groupBy("media_id", "label").agg(F.countDistinct("time_ms").alias("votes"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.count_if(F.col("pos") == 0).alias("firsts"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(share).cast("double") * F.col("n")))
    all_ = per.join(frames, "media_id").withColumn("kept", (F.col("votes") >= need) & (F.col("label") != unclassified))
    of = W.partitionBy("media_id")
    led = F.max(F.col("kept") & (F.col("firsts") > 0)).over(of)
    lead = F.row_number().over(of.orderBy((F.col("firsts") > 0).desc(), (F.col("label") == unclassified), F.col("firsts").desc(), F.col("score").desc(), "label"))
    chosen = all_.withColumn("led", led).withColumn("lead", lead).where(F.col("kept") | (~F.col("led") & (F.col("lead") == 1) & (F.col("firsts") > 0)))
    out = chosen.withColumn("place", F.row_number().over(of.orderBy(F.col("votes").desc(), F.col("score").desc(), "label")))
    return out.where(F.col("place") <= most).select("media_id", "place", "label", "votes", "score")


def personalised(prompts: DataFrame, confirmed: DataFrame, alpha: float, least: int) -> DataFrame:
    """prompts(label, vector) moved towards the mean of confirmed(label, embedding), where a label has enough of them."""
    if alpha <= 0:
        return prompts
    counts = confirmed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("label")
    means = mean_vectors(confirmed.join(counts, "label", "left_semi"), "label").withColumnRenamed("vector", "mean")
    moved = S.unit(F.zip_with("vector", "mean", lambda v, m: v + alpha * m))
    return prompts.join(means, "label", "left").withColumn("vector", F.coalesce(moved, F.col("vector"))).drop("mean")


def confirmed(feedback: DataFrame, media: DataFrame) -> DataFrame:
    return feedback.where("verdict = 1").join(media.where("embedding IS NOT NULL").select("media_id", "embedding"), "media_id").select("label", "media_id", "embedding")


def relevant(ranked: DataFrame, window: float = 0.05, most: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, close): how many results are within a window of the best score, at most so many; no row without results."""
    best = ranked.groupBy(*by).agg(F.max("score").alias("best")) if by else ranked.agg(F.max("score").alias("best")).where("best IS NOT NULL")
    rows = ranked.join(best, list(by)) if by else ranked.join(F.broadcast(best))  # one row
    return rows.groupBy(*(by or ("best",))).agg(F.least(F.greatest(F.count_if(F.col("best") - F.col("score") <= window), F.lit(1)), F.lit(most)).cast("int").alias("close")).select(*by, "close")


def spaced_scenes(hits: DataFrame, n: int = 3, gap_ms: int = 10000) -> DataFrame:
    """(media_id, scenes): per video the best frames that are a gap apart, best first. hits(media_id, time_ms, score): a video's frames are at most Params.max_frames."""
    item = F.struct((-F.col("score")).alias("order"), F.col("time_ms"), F.col("score"))
    lists = hits.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def pick(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda c: F.abs(c["time_ms"] - x["time_ms"]) < gap_ms)
        return F.when((F.size(acc) < n) & ~near, F.concat(acc, F.array(x))).otherwise(acc)

    picked = F.aggregate("items", F.slice("items", 1, 0), pick)
    return lists.select("media_id", F.transform(picked, lambda x: F.struct(x["time_ms"].alias("time_ms"), x["score"].alias("score"))).alias("scenes"))


def frames_of(frames: DataFrame, media: DataFrame) -> DataFrame:
    """Frames of videos that are accessible and haven't failed."""
    from ..schema import FAILED

    return frames.join(media.where(F.col("is_accessible") & (F.col("state") != FAILED)).select("media_id"), "media_id", "left_semi")
