"""Places and map clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KM_PER_DEGREE = 111.19


def clusters(points: DataFrame, world_px: float, cell_px: float) -> DataFrame:
    """Per grid cell of the map: mean place, box, count, and whether all are at one place. points(media_id, gps_lat, gps_lon). Which points are in it is told by with_cells()."""
    cell = with_cells(points, world_px, cell_px)
    box = [f("gps_" + c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    out = cell.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg("gps_lat").alias("lat"), F.avg("gps_lon").alias("lon"), *box)
    return out.withColumn("at_one_place", (F.col("lat_max") - F.col("lat_min") < 1e-4) & (F.col("lon_max") - F.col("lon_min") < 1e-4))


def with_cells(points: DataFrame, world_px: float, cell_px: float) -> DataFrame:
    """points with the cell (cx, cy) of the map that each is in."""
    return points.withColumn("cx", F.floor(S.mercator_x(F.col("gps_lon"), world_px) / cell_px)).withColumn("cy", F.floor(S.mercator_y(F.col("gps_lat"), world_px) / cell_px))


def _cells(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return df.withColumn("_cy", F.floor(F.col(lat) / size)).withColumn("_cx", F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / size))


def within(points: DataFrame, places: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """points x places no farther than the place's radius, with km.

    A place is listed in every cell of a grid that its circle may touch, so points meet only places
    of their own cell, by an equal key. Longitudes wrap around; near a pole a circle touches all of them.
    """
    reach = F.col("radius_km") / KM_PER_DEGREE
    rows = places.withColumn("_lo", F.floor((F.col("lat") - reach) / cell_deg)).withColumn("_hi", F.floor((F.col("lat") + reach) / cell_deg))
    rows = rows.withColumn("_cy", F.explode(F.sequence("_lo", "_hi")))
    steepest = F.least(F.abs(F.col("lat")) + reach, F.lit(90.0))
    wide = F.when(steepest > 89, F.lit(180.0)).otherwise(F.least(reach / F.cos(F.radians(steepest)), F.lit(180.0)))
    first, last = F.floor((F.col("lon") + 180 - wide) / cell_deg), F.floor((F.col("lon") + 180 + wide) / cell_deg)
    around = int(360 / cell_deg)
    rows = rows.withColumn("_cx", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.lit(around)))))).drop("_lo", "_hi")
    rows = rows.withColumnRenamed("lat", "place_lat").withColumnRenamed("lon", "place_lon")
    met = _cells(points, "gps_lat", "gps_lon", cell_deg).join(rows, ["_cy", "_cx"])
    km = S.haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.col("place_lat"), F.col("place_lon"))
    return met.withColumn("km", km).where(F.col("km") <= F.col("radius_km")).drop("_cy", "_cx")


def nearest(points: DataFrame, places: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, place_name): the nearest place whose circle a point is in; ties go to the first in order."""
    return within(points, places).groupBy(key).agg(F.min_by("name", F.struct("km", "ordinal")).alias("place_name"))


def find_place(places: DataFrame, words: DataFrame) -> DataFrame:
    """(word, name): the first place in order that has a word as its name or alias."""
    names = places.select("ordinal", "name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("word"))
    return words.join(names, "word").groupBy("word").agg(F.min_by("name", "ordinal").alias("name"))
