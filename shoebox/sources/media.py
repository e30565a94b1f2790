"""Sources and sinks of the media tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema


def scan_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "heic")) -> DataFrame:
    """(path, length, modified) of files below a folder by extension in any case. The content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = "(?i)\\.(" + "|".join(extensions) + ")$"
    return files.where(F.col("path").rlike(wanted)).select("path", "length", F.col("modificationTime").alias("modified"))


def hashed_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def not_queued(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct paths that aren't known yet."""
    return paths.select("path").distinct().join(known.select("path"), "path", "left_anti")


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, free): a name that is taken, or comes again, gets _1, _2 and so on before its extension; beyond the numbers that are in use."""
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"\.[^.]*$", 0)
    used = taken.select(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"_\d+$", "").alias("stem"), F.regexp_extract("name", r"\.[^.]*$", 0).alias("ext"), F.coalesce(F.regexp_extract("name", r"_(\d+)\.[^.]*$", 1).try_cast("int"), F.lit(0)).alias("k"))
    used = used.groupBy("stem", "ext").agg((F.max("k") + 1).alias("from"))
    rows = names.withColumn("stem", stem).withColumn("ext", ext).join(used, ["stem", "ext"], "left")
    k = F.coalesce("from", F.lit(0)) + F.row_number().over(W.partitionBy("stem", "ext").orderBy("name")) - 1
    return rows.withColumn("k", k).select("name", F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), F.col("k").cast("string"), "ext")).alias("free"))


def catalogue(spark: SparkSession, path: str, ddl: str = schema.MEDIA) -> DataFrame:
    """A media table with a given schema; columns that its files lack are null."""
    return spark.read.schema(ddl).parquet(path)


def parse_places(lines: DataFrame, col: str = "value") -> DataFrame:
    """(ordinal, name, aliases, lat, lon, radius_km) from tab-separated lines name, aliases (by |), lat, lon, radius; blank, # and broken lines are passed over. lines(line, value)."""
    f = F.split(F.trim(col), "\t")
    num = lambda k: F.trim(F.get(f, F.lit(k))).try_cast("double")
    rows = lines.where((F.trim(col) != "") & ~F.trim(col).startswith("#") & (F.size(f) >= 5))
    rows = rows.select(F.col("line").cast("int").alias("ordinal"), F.trim(f[0]).alias("name"), F.filter(F.transform(F.split(f[1], r"\|"), F.trim), lambda x: x != "").alias("aliases"), num(2).alias("lat"), num(3).alias("lon"), num(4).alias("radius_km"))
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL AND radius_km IS NOT NULL")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A place table of one small file, in its order."""
    return parse_places(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def population_radius(n: Column) -> Column:
    """Kilometres by inhabitants. Fixed values."""
    return F.when(n >= 1_000_000, 30.0).when(n >= 200_000, 20.0).when(n >= 50_000, 15.0).otherwise(10.0)


def gazetteer(rows: DataFrame) -> DataFrame:
    """(name, lat, lon, population, radius_km) from rows(id, alternates by comma, lat, lon, population).

    A place's name is the one of Hangul, two letters at least, without digits, that most places
    have, then the shortest; of places of one name the largest stays.
    """
    names = rows.select("id", "lat", "lon", "population", F.explode(F.split("alternates", ",")).alias("name")).where(F.col("name").rlike("[가-힣]") & ~F.col("name").rlike("[0-9]") & (F.char_length("name") >= 2))
    often = names.groupBy("name").agg(F.countDistinct("id").alias("freq"))
    best = names.join(often, "name").groupBy("id", "lat", "lon", "population").agg(F.max_by("name", F.struct("freq", -F.char_length("name"), "name")).alias("name"))
    largest = best.groupBy("name").agg(F.max_by(F.struct("lat", "lon", "population"), F.struct("population", "id")).alias("p"))
    return largest.select("name", "p.*", population_radius(F.col("p.population")).alias("radius_km"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="path STRING, category STRING")


def evaluation_set(found: DataFrame, blocked: tuple[str, ...], n: int) -> DataFrame:
    """n titles of each category from found(category, title, licence): free licences before attribution before others, none blocked, each title once."""
    low = F.lower("licence")
    tier = F.when(low.rlike("cc0|public domain|pdm"), 0).when(low.rlike(r"^cc[ -]by(?![ -](sa|nc|nd))"), 1).when(low.rlike("by-sa"), 2).otherwise(3)
    rows = found.where(~F.lower("title").rlike("|".join(blocked))) if blocked else found
    once = rows.withColumn("tier", tier).groupBy("category", "title").agg(F.min("tier").alias("tier"))
    place = F.row_number().over(W.partitionBy("category").orderBy("tier", "title"))
    return once.withColumn("place", place).where(F.col("place") <= n).select("category", "title", "tier", "place")


def vector_blob(col: str) -> Column:
    """array<float> as little-endian float32 bytes."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for b in batches:
            yield pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in b.to_pylist()], pa.binary())

    return pack(F.col(col))


def blob_vector(col: str, dim: int) -> Column:
    """Little-endian float32 bytes as array<float>; null for another number of bytes."""

    @F.arrow_udf("array<float>")
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for b in batches:
            yield pa.array([None if v is None or len(v) != 4 * dim else np.frombuffer(v, "<f4").tolist() for v in b.to_pylist()], pa.list_(pa.float32()))

    return unpack(F.col(col))


def decoded_media(files: DataFrame, decode: Callable[[bytes], dict], ddl: str) -> DataFrame:
    """(path, fields of ddl, error) by a plug-in that reads one file's bytes; a failure is text in `error`, never an exception."""
    from pyspark.sql.types import StructType

    fields = [f.name for f in StructType.fromDDL(ddl).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    read, error = decode(content), None
                except Exception as e:  # noqa: BLE001  one broken file must not stop the scan
                    read, error = {}, f"{type(e).__name__}: {e}"
                out.append({"path": path, **{f: read.get(f) for f in fields}, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(f"path STRING, {ddl}, error STRING")
    arrow = to_arrow_schema(kind)
    return files.select("path", "content").mapInArrow(run, kind)


def encoded_items(items: DataFrame, encode: Callable[[bytes], list[float]], id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """(id, embedding, error) by a plug-in that encodes one item at a time, as a vector may depend on what it is batched with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors, errors = b[id_col], [], []
            for content in b[content_col].to_pylist():
                try:
                    vectors.append(encode(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    vectors.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[id_col, "embedding", "error"])

    return items.select(id_col, content_col).mapInArrow(run, f"{id_col} {items.schema[id_col].dataType.simpleString()}, embedding array<float>, error string")
