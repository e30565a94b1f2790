"""What comes before an encoder: pixels and texts as model input, and prompt matrices kept by stamp."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def triangle_weights(size: int, wanted: int) -> np.ndarray:
    """wanted x size: shares of the old pixels in each new one, by a triangle that widens when a side shrinks."""
    scale = size / wanted
    reach = max(scale, 1.0)
    centres = (np.arange(wanted) + 0.5) * scale
    places = np.arange(size)
    first = np.maximum(np.floor(centres - reach + 0.5), 0)[:, None]
    last = np.minimum(np.floor(centres + reach + 0.5), size)[:, None]
    shares = np.maximum(1 - np.abs((places - centres[:, None] + 0.5) / reach), 0)
    shares = np.where((places >= first) & (places < last), shares, 0)
    lone = shares.sum(1) == 0
    shares[lone, np.clip(centres[lone].astype(int), 0, size - 1)] = 1
    return shares / shares.sum(1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Height x width x channels in bytes: across first, then along, rounded after each."""
    whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    out = pixels.astype(np.float64)
    if pixels.shape[1] != width:
        out = whole(np.einsum("ws,hsc->hwc", triangle_weights(pixels.shape[1], width), out))
    if pixels.shape[0] != height:
        out = whole(np.einsum("hs,swc->hwc", triangle_weights(pixels.shape[0], height), out))
    return out.astype(np.uint8)


def model_input(pixels: np.ndarray, side: int, mean: list[float], std: list[float]) -> np.ndarray:
    """channels x side x side: the shorter side to `side`, the centre cut out, each channel centred and scaled."""
    h, w = pixels.shape[:2]
    scale = side / min(w, h)
    small = resized(pixels, max(side, round(w * scale)), max(side, round(h * scale)))
    top, left = (small.shape[0] - side) // 2, (small.shape[1] - side) // 2
    cut = small[top : top + side, left : left + side].astype(np.float32) / 255
    return ((cut - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)


def model_inputs(images: DataFrame, side: int, mean: list[float], std: list[float], id_col: str = "media_id") -> DataFrame:
    """(id, values) from images(id, width, height, rgb): three bytes for each pixel, row by row. Bytes of another number give null."""

    @F.arrow_udf("array<float>")
    def prepare(widths: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for w, h, rgb in widths:
            out = []
            for x, y, b in zip(w.to_pylist(), h.to_pylist(), rgb.to_pylist(), strict=True):
                ok = b is not None and x and y and len(b) == 3 * x * y
                out.append(model_input(np.frombuffer(b, np.uint8).reshape(y, x, 3), side, mean, std).ravel() if ok else None)
            yield pa.array(out, pa.list_(pa.float32()))

    return images.select(id_col, prepare("width", "height", "rgb").alias("values"))


def padded_ids(col: Column, vocabulary: str, length: int = 77) -> Column:
    """array<int> of a text's ids for a text encoder: by the vocabulary's own rules, begun and ended, cut or filled with the end to `length`. Null as empty."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        begin, end = own.token_to_id("<|startoftext|>"), own.token_to_id("<|endoftext|>")
        for batch in batches:
            out = []
            for e in own.encode_batch([x or "" for x in batch.to_pylist()], add_special_tokens=False):
                out.append(([begin, *e.ids[: length - 2]] + [end] * length)[:length])
            yield pa.array(out, pa.list_(pa.int32()))

    return encode(col)


def stamp(model: str, prompts: DataFrame) -> str:
    """Of a model and its prompts(family, parent, label, prompt), in any order: prompts are a configuration."""
    rows = prompts.select(F.concat_ws("\t", F.coalesce("family", F.lit("")), F.coalesce("parent", F.lit("")), "label", "prompt").alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n").cast("binary"), 256).alias("h"))
    return f"{model}:{rows.first().h}"


def kept_by_stamp(spark: SparkSession, path: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at path for a stamp; built and written if there is none. A table half written has no _SUCCESS and is built again."""
    import hashlib

    place = f"{path}/{hashlib.sha256(mark.encode()).hexdigest()[:16]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
