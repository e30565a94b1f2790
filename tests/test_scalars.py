from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from shoebox.functions import scalars as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_originals_rank_before_copies(spark):
    pairs = [("cafe_01.jpg", "cafe_01 - 복사본.jpg"), ("trip_01.jpg", "trip_01(1).jpg"), ("IMG_0042.JPG", "IMG_0042 - Copy.JPG"), ("a.png", "a (2).png"), ("a.png", "b.png"), ("a.png", "aa.png")]
    rows = spark.createDataFrame(pairs, "a STRING, b STRING")
    assert rows.where(S.origin_rank(F.col("a")) < S.origin_rank(F.col("b"))).count() == len(pairs)


def test_times(spark):
    got = values(spark, [("2024:03:02 14:00:00",), ("0000:00:00 00:00:00",), ("x",), (None,)], "t STRING", S.taken_time(F.col("t")))
    assert got == [1709388000, None, None, None]
    zoned = values(spark, [("2024:03:02 14:00:00", "+09:00"), ("2024:03:02 14:00:00", None)], "t STRING, o STRING", S.taken_time(F.col("t"), F.col("o")))
    assert zoned == [1709355600, 1709388000]
    raw = [("20240302T140000.000Z",), ("1904-01-01T00:00:00",), ("19700101T000000.000Z",), ("",), (None,), ("20241302T140000.000Z",)]
    assert values(spark, raw, "t STRING", S.container_time(F.col("t"))) == [1709388000, None, None, None, None, None]


def test_locations(spark):
    raw = [("+37.5665+126.9780/",), ("-33.8688+151.2093+012.000/",), ("+00.0000+000.0000/",), ("garbage",), ("+91.0+10.0/",), (None,)]
    got = values(spark, raw, "t STRING", S.iso6709(F.col("t")))
    assert [g and (g.lat, g.lon) for g in got] == [(37.5665, 126.978), (-33.8688, 151.2093), None, None, None, None]
    assert abs(one(spark, S.dms(F.lit(33), F.lit(52), F.lit(7.68), F.lit("S")))[0] + 33.8688) < 1e-9


def test_texts(spark):
    assert values(spark, [(5400,), (138000,), (3723000,)], "t BIGINT", S.clock(F.col("t"))) == ["0:05", "2:18", "1:02:03"]
    assert values(spark, [(500,), (3 << 20,), (3 << 29,)], "t BIGINT", S.human_size(F.col("t"))) == ["0KB", "3MB", "1.5GB"]
    days = [("2026-09-28",), ("2026-09-27",), ("2026-01-05",), ("2025-12-31",), (None,)]
    assert values(spark, days, "d STRING", S.day_label(F.to_date("d"), F.lit("2026-09-28").cast("date"))) == ["오늘", "어제", "1월 5일", "2025년 12월 31일", "날짜 미상"]
    span = S.span_label(F.to_date(F.lit("2026-09-03")), F.to_date(F.lit("2026-09-05")), F.to_date(F.lit("2026-09-28")))
    assert one(spark, span)[0] == "9월 3일 – 5일"
    assert values(spark, [(2, 0), (0, 3), (2, 3)], "p INT, v INT", S.count_note(F.col("p"), F.col("v"))) == ["2장", "영상 3개", "사진 2장 · 영상 3개"]


def test_pictures(spark):
    gray = np.random.default_rng(1).integers(0, 255, (5, 7)).astype(float)
    lap = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    got = values(spark, [(gray.ravel().tolist(),)], "g ARRAY<DOUBLE>", S.laplacian_variance(F.col("g"), 7, 5))[0]
    assert math.isclose(got, lap.var(), rel_tol=1e-9)
    assert one(spark, S.laplacian_variance(F.array(F.lit(1.0)), 2, 2))[0] == 0
    assert values(spark, [([1.0, 2.0],)], "g ARRAY<DOUBLE>", S.mean_brightness(F.col("g"))) == [1.5]
    shapes = values(spark, [(1080, 1920), (800, 600), (0, 5), (None, 3)], "w INT, h INT", S.screen_like(F.col("w"), F.col("h"), (16 / 9,), 0.02))
    assert shapes == [True, False, False, False]


def test_geometry(spark):
    assert abs(one(spark, S.haversine_km(F.lit(37.5665), F.lit(126.978), F.lit(35.1796), F.lit(129.0756)))[0] - 325) < 2
    world = one(spark, S.fit_zoom(F.lit(-85.0), F.lit(85.0), F.lit(-180.0), F.lit(180.0), (300, 300), 0, 256, 2, 17))[0]
    point = one(spark, S.fit_zoom(F.lit(37.0), F.lit(37.0), F.lit(127.0), F.lit(127.0), (300, 300), 0, 256, 2, 17))[0]
    assert (world, point) == (2.0, 17.0)
    assert one(spark, S.mercator_y(F.lit(90.0), 1.0))[0] >= -1e-6


def test_frames(spark):
    got = values(spark, [(60_000,), (3_600_000,), (4000,), (0,), (None,)], "d BIGINT", S.frame_positions(F.col("d")))
    assert len(got[0]) == 13 and (got[0][0], got[0][-1]) == (0, 59_999)
    assert len(got[1]) == 96 and (got[1][0], got[1][-1]) == (0, 3_599_999)
    assert got[2:] == [[2000], [], []]


def test_vectors_and_models(spark):
    unit = values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<FLOAT>", S.unit(F.col("v")))
    assert np.allclose(unit, [[0.6, 0.8], [0, 0]])
    import hashlib

    want = "sha@" + hashlib.sha256(b"a=1f\nb=2\n").hexdigest()[:12]
    rows = [({"b": "2", "a": "1F"}, {"a": "x"}, "old"), ({"b": "2", "a": "1"}, {"a": "1", "b": "2"}, "old")]
    assert values(spark, rows, "f MAP<STRING,STRING>, s MAP<STRING,STRING>, l STRING", S.model_identity(F.col("f"), F.col("s"), F.col("l"))) == [want, "old"]
    json = spark.createDataFrame([('{"files":{"a":"AB"},"sizes":{"a":7}}',), ("{}",)], "j STRING")
    assert [(r[0], r[1]) for r in json.select(S.manifest_files(F.col("j")), S.manifest_sizes(F.col("j"))).collect()] == [({"a": "ab"}, {"a": 7}), ({}, {})]
    assert values(spark, [("AB", "ab"), ("a", None)], "a STRING, b STRING", S.same_hash(F.col("a"), F.col("b"))) == [True, False]


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT haversine_km(0, 0, 0, 1) AS km, vector_dot(array(1D, 2D), array(3D, 4D)) AS d, mercator_x(0, 2) AS x").first()
    assert abs(row.km - 111.19) < 0.01 and row.d == 11 and row.x == 1
