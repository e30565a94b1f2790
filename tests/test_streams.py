from __future__ import annotations

from datetime import datetime, timedelta

from shoebox.streaming import pipelines


def written(spark, path, rows):
    spark.createDataFrame(rows, "user_id INT, ts TIMESTAMP, sha256 STRING").coalesce(1).write.mode("append").parquet(path)


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def source(spark, path):
    return spark.readStream.schema("user_id INT, ts TIMESTAMP, sha256 STRING").option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, path, tmp_path):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(path)


def test_sessions_close_when_the_watermark_has_passed(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for rows in ([(1, at(0), "a"), (1, at(5), "b")], [(1, at(20), "c")], [(2, at(500), "d")], [(2, at(900), "e")]):
        written(spark, folder, rows)
    out = drained(pipelines.event_sessions(source(spark, folder), "10 minutes", "1 minute", "user_id"), f"{tmp_path}/out", tmp_path)
    assert {(r.user_id, r.n) for r in out.collect()} >= {(1, 2), (1, 1), (2, 1)}


def test_contents_once(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for rows in ([(1, at(0), "a"), (2, at(1), "a")], [(3, at(2), "a"), (4, at(3), "b")]):
        written(spark, folder, rows)
    out = drained(pipelines.deduplicated(source(spark, folder), "1 hour"), f"{tmp_path}/out", tmp_path)
    assert sorted(r.sha256 for r in out.collect()) == ["a", "b"]


def test_indexing_goes_on_where_it_ended(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []
    step = lambda df, k: seen.append(df.count())
    for k in range(2):
        written(spark, folder, [(k, at(k), "x")])
        pipelines.index_incrementally(source(spark, folder), step, f"{tmp_path}/check").awaitTermination(120)
    assert sum(seen) == 2
