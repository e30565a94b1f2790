"""Rule tags: where an item is from, night, place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The tags that rules give.
CAMERA, SCREENSHOT, DOWNLOAD, SAVED, NIGHT, LOCATED = "카메라촬영", "스크린샷", "다운로드", "저장/다운로드", "야간", "위치있음"


@dataclass(frozen=True)
class Provenance:
    """Fits a path that has one of `paths` anywhere, or a package that begins with one of `packages`."""

    tag: str
    paths: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()


def provenance(rules: tuple[Provenance, ...], ratios: tuple[float, ...], tolerance: float, downloads: str = "download") -> Column:
    """The first rule that fits, then a named camera, the shape of a screen, a download folder, else saved."""
    path, package = F.lower(F.coalesce("rel_path", F.lit(""))), F.lower(F.coalesce("owner_pkg", F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        fits = F.lit(False)
        for p in r.paths:
            fits = fits | path.contains(p.lower())
        for p in r.packages:
            fits = fits | package.startswith(p.lower())
        out = out.when(fits, F.lit(r.tag))
    out = out.when(F.trim(F.coalesce("camera_model", F.lit(""))) != "", F.lit(CAMERA))
    out = out.when(S.screen_like(F.col("width"), F.col("height"), ratios, tolerance), F.lit(SCREENSHOT))
    return out.when(path.contains(downloads), F.lit(DOWNLOAD)).otherwise(F.lit(SAVED))


def rule_tags(media: DataFrame, rules: tuple[Provenance, ...], ratios: tuple[float, ...], tolerance: float) -> DataFrame:
    """(media_id, label, score, source): provenance, night by a camera's time from 20 to 5, and having a place."""
    hour = F.hour(F.timestamp_seconds("taken_at"))
    night = F.when((F.col("taken_at_source") == "exif") & ((hour >= 20) | (hour < 6)), F.lit(NIGHT))
    place = F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), F.lit(LOCATED))
    labels = F.array_compact(F.array(provenance(rules, ratios, tolerance), night, place))
    return media.select("media_id", F.explode(labels).alias("label"), F.lit(None).cast("float").alias("score"), F.lit("rule").alias("source"))
