"""Schemas of the media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NEW, META, DONE, FAILED = 0, 1, 2, 3

MEDIA = """media_id BIGINT, media_kind STRING, display_name STRING, bucket STRING, rel_path STRING, owner_pkg STRING, mime STRING,
    bytes BIGINT, width INT, height INT, orientation INT, duration_ms BIGINT, is_accessible BOOLEAN, generation BIGINT, date_modified BIGINT, date_added BIGINT,
    taken_at BIGINT, taken_at_source STRING, gps_lat DOUBLE, gps_lon DOUBLE, camera_model STRING, blur_score DOUBLE, brightness DOUBLE,
    sha256 STRING, embedding ARRAY<FLOAT>, model_id STRING, fail_count INT, state INT"""
TAGS = "media_id BIGINT, label STRING, score FLOAT, source STRING"
FRAMES = "media_id BIGINT, time_ms BIGINT, embedding ARRAY<FLOAT>"
PLACES = "ordinal INT, name STRING, aliases ARRAY<STRING>, lat DOUBLE, lon DOUBLE, radius_km DOUBLE"
FEEDBACK = "media_id BIGINT, label STRING, verdict INT, ts BIGINT"
FAVORITES = "media_id BIGINT, ts BIGINT"
ALBUMS = "id BIGINT, name STRING, created_at BIGINT"
ALBUM_ITEMS = "album_id BIGINT, media_id BIGINT, added_at BIGINT, scene_time_ms BIGINT"
CHOICES = "group_key STRING, keep_id BIGINT, dismissed BOOLEAN"
GROUPS = "group_id INT, kind STRING, media_id BIGINT, is_best BOOLEAN"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema: missing ones are null, others go. The additive migration of an older table."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields))
