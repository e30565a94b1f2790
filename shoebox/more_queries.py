"""More registered queries: sources, column functions, small state tables, streams; each with the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema, work
from .functions import scalars as S
from .operators import albums, backup, cleanup, events, filters, grouping, lookups, rules, state, vectors
from .params import Params
from .plans import assembly, parser
from .queries import EXACT, MEDIA, PROMPTS, SESSIONS, TAGS, TITLES, embeddings, media, prompts, query, query_vector, tags
from .sources import encoders
from .sources import media as sources
from .streaming import pipelines


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# files


@query("SELECT n_regionkey::INT AS region, sum(strlen(n_name) + 1)::BIGINT AS length FROM nation GROUP BY 1")
def scanned_folder(spark, d):
    path = work.folder(spark, "scanned")
    table(spark, d, "nation").coalesce(1).select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    found = sources.scan_folder(spark, path, ("TXT",))
    return found.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "length")


@query("SELECT n_regionkey::INT AS region, sum(strlen(n_name) + 1)::BIGINT AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256 FROM nation GROUP BY 1")
def hashed_folder(spark, d):
    path = work.folder(spark, "hashed")
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_name").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    return sources.hashed_folder(spark, path).select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "bytes", "sha256")


@query("""SELECT name, CASE WHEN k = 0 THEN name ELSE replace(name, '.jpg', '_' || k || '.jpg') END AS free FROM (SELECT name, coalesce("from", 0) + row_number() OVER (PARTITION BY name ORDER BY name) - 1 AS k
    FROM (SELECT 'f' || event_id % 50 || '.jpg' AS name FROM events WHERE event_id < 200) LEFT JOIN
    (SELECT 'f' || event_id % 60 || '.jpg' AS name, 1 + max(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END) AS "from" FROM events WHERE event_id BETWEEN 200 AND 280 GROUP BY 1) USING (name))""")
def free_names(spark, d):
    ev = table(spark, d, "events")
    names = ev.where("event_id < 200").selectExpr("'f' || event_id % 50 || '.jpg' AS name")
    taken = ev.where("event_id BETWEEN 200 AND 280").selectExpr("'f' || event_id % 60 || CASE WHEN event_id % 3 = 0 THEN '_' || event_id % 4 ELSE '' END || '.jpg' AS name")
    return sources.free_names(names, taken)


@query("SELECT media_id, bytes, coalesce(camera_model, '-') AS camera_model, true AS unset FROM media", MEDIA)
def older_catalogue(spark, d):
    """A catalogue of few columns read as one of today's: what it lacks is null."""
    path = work.folder(spark, "catalogue")
    media(spark, d).select("media_id", "bytes", "camera_model").write.parquet(path)
    read = sources.catalogue(spark, path)
    same = schema.conform(spark.read.parquet(path), schema.MEDIA)
    # both sides are the whole library; files of few columns look small beside the rows they hold, so Spark would send one to the driver
    both = read.join(same.select("media_id", F.col("mime").alias("other")).hint("merge"), "media_id")
    return both.select("media_id", "bytes", F.coalesce("camera_model", F.lit("-")).alias("camera_model"), (F.col("mime").isNull() & F.col("other").isNull() & F.col("embedding").isNull()).alias("unset"))


CITIES = "cities AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN '서울' WHEN 1 THEN '부산' WHEN 2 THEN '강릉시' WHEN 3 THEN '서울' ELSE '읍' END AS a, CASE WHEN s_suppkey % 7 = 0 THEN '마을' || s_suppkey ELSE '동네' END AS b, s_suppkey * 7919 % 1500000 AS population FROM supplier)"


@query("""SELECT name, arg_max(id, (population, id)) AS lat, max(population) AS population, CASE WHEN max(population) >= 1000000 THEN 30.0::DOUBLE WHEN max(population) >= 200000 THEN 20.0 WHEN max(population) >= 50000 THEN 15.0 ELSE 10.0 END AS radius_km FROM (
    SELECT id, population, arg_max(name, (freq, -length(name), name)) AS name FROM (SELECT id, population, a AS name FROM cities WHERE length(a) > 1 UNION ALL SELECT id, population, b FROM cities WHERE b = '동네')
    JOIN (SELECT name, count(*) AS freq FROM (SELECT a AS name FROM cities UNION ALL SELECT b FROM cities) GROUP BY name) USING (name) GROUP BY id, population) GROUP BY name""", CITIES)
def gazetteer(spark, d):
    """Names with digits and of one letter aren't places' names."""
    rows = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS id",
        "CASE s_suppkey % 5 WHEN 0 THEN '서울' WHEN 1 THEN '부산' WHEN 2 THEN '강릉시' WHEN 3 THEN '서울' ELSE '읍' END || ',' || CASE WHEN s_suppkey % 7 = 0 THEN '마을' || s_suppkey ELSE '동네' END || ',' || s_name AS alternates",
        "s_suppkey AS lat", "0.0 AS lon", "s_suppkey * 7919 % 1500000 AS population",
    )
    return sources.gazetteer(rows).select("name", "lat", "population", "radius_km")


@query("SELECT s_name AS path, 'c' || s_nationkey AS category FROM supplier")
def read_labels(spark, d):
    path = work.folder(spark, "labels")
    table(spark, d, "supplier").selectExpr("s_name AS path", "'c' || s_nationkey AS category").write.csv(path, header=True)
    return sources.read_labels(spark, path)


@query("SELECT vec_id, 4 * len(embedding) AS bytes, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, true AS cut FROM embeddings")
def vector_blobs(spark, d):
    """Vectors as bytes and back; bytes of another length are no vector."""
    packed = embeddings(spark, d).select("vec_id", sources.vector_blob("embedding").alias("blob"))
    both = packed.select("vec_id", "blob", F.expr("substr(blob, 1, 8)").alias("short")).select("vec_id", "blob", sources.blob_vector("blob", 64).alias("v"), sources.blob_vector("short", 64).alias("none"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return both.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(total, 6).alias("total"), F.col("none").isNull().alias("cut"))


@query("""SELECT 'm:' || (SELECT sha256(string_agg(p, chr(10) ORDER BY p)) FROM (SELECT concat_ws(chr(9), 'category', '', 'c' || n_name, 'a ' || n_name) AS p FROM nation)) AS mark, n_name AS label FROM nation""")
def kept_by_stamp(spark, d):
    """What was built once for a stamp is read the second time."""
    n = table(spark, d, "nation")
    named = n.selectExpr("'category' AS family", "CAST(NULL AS STRING) AS parent", "'c' || n_name AS label", "'a ' || n_name AS prompt")
    mark, path = encoders.stamp("m", named), work.folder(spark, "prompts")
    encoders.kept_by_stamp(spark, path, mark, lambda: n.select(F.col("n_name").alias("label")))
    again = encoders.kept_by_stamp(spark, path, mark, lambda: n.limit(0).select(F.lit("").alias("label")))
    return again.select(F.lit(mark).alias("mark"), "label")


# column functions


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS utc, epoch_us(ts) // 1000000 - 32400 AS seoul, CASE WHEN event_id % 3 = 0 THEN -1 ELSE epoch_us(ts) // 1000000 END AS container FROM events""")
def read_times(spark, d):
    """Times of a camera, with and without an offset, and of a container, of which some are too old."""
    ev = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    exif, raw = F.date_format("t", "yyyy:MM:dd HH:mm:ss"), F.date_format("t", "yyyyMMdd'T'HHmmss'.000Z'")
    old = F.when(F.col("event_id") % 3 == 0, F.lit("19040101T000000.000Z")).otherwise(raw)
    return ev.select("event_id", S.taken_time(exif).alias("utc"), S.taken_time(exif, F.lit("+09:00")).alias("seoul"), F.coalesce(S.container_time(old), F.lit(-1)).alias("container"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -999 ELSE event_id % 90 + 0.25 END AS lat, CASE WHEN event_id % 5 = 0 THEN -999 ELSE -(event_id % 180) - 0.5 END AS lon,
    round((event_id % 60 + CAST(event_id % 50 AS DOUBLE) / 60 + CAST(event_id % 40 AS DOUBLE) / 3600) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, 9) + 0.0 AS degrees FROM events""")
def read_positions(spark, d):
    ev = table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, "+00.0000+000.0000/").otherwise(F.format_string("+%d.25-%d.5+12.000/", F.col("event_id") % 90, F.col("event_id") % 180))
    at = S.iso6709(text)
    num = lambda k: (F.col("event_id") % k).cast("double")
    ref = F.when(F.col("event_id") % 2 == 0, "s").otherwise("N")
    return ev.select("event_id", F.coalesce(at["lat"], F.lit(-999.0)).alias("lat"), F.coalesce(at["lon"], F.lit(-999.0)).alias("lon"), F.round(S.dms(num(60), num(50), num(40), ref), 9).alias("degrees"))


@query("""SELECT event_id, CASE WHEN n >= 1073741824 THEN printf('%.1fGB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.0fMB', n / 1048576) ELSE printf('%.0fKB', n / 1024) END AS size FROM (SELECT event_id, CAST(event_id * 1234567 + 1 AS DOUBLE) AS n FROM events)""")
def size_texts(spark, d):
    return table(spark, d, "events").select("event_id", S.human_size(F.col("event_id") * 1234567 + 1).alias("size"))


@query("""SELECT event_id, CASE WHEN day IS NULL THEN '날짜 미상' WHEN day = DATE '2024-01-20' THEN '오늘' WHEN day = DATE '2024-01-19' THEN '어제' WHEN year(day) = 2024 THEN month(day) || '월 ' || day(day) || '일' ELSE year(day) || '년 ' || month(day) || '월 ' || day(day) || '일' END AS day,
    CASE WHEN day IS NULL THEN '날짜 미상' ELSE CASE WHEN year(last) = 2024 THEN '' ELSE year(last) || '년 ' END || month(last) || '월 ' || day(day) || '일 – ' || day(last) || '일' END AS span
    FROM (SELECT event_id, day, day + 2 AS last FROM (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE DATE '2023-12-01' + CAST(event_id % 60 AS INT) END AS day FROM events))""")
def day_texts(spark, d):
    ev = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 29 = 0 THEN NULL ELSE date_add(DATE '2023-12-01', CAST(event_id % 60 AS INT)) END AS day")
    today = F.lit("2024-01-20").cast("date")
    return ev.select("event_id", S.day_label(F.col("day"), today).alias("day"), S.span_label(F.col("day"), F.date_add("day", 2), today).alias("span"))


@query("""SELECT n_nationkey, round(least(greatest(least(log2((1080 - 96) / (256 * across)), log2((1920 - 96) / (256 * along))), 2), 17), 6) AS zoom FROM (SELECT n_nationkey, (n_nationkey + 1) / 3600.0 AS across,
    (ln((1 + sin(radians(33 + n_nationkey / 100.0))) / (1 - sin(radians(33 + n_nationkey / 100.0)))) - ln((1 + sin(radians(33))) / (1 - sin(radians(33))))) / (4 * pi()) + CASE WHEN n_nationkey = 0 THEN 1e-30 ELSE 0 END AS along FROM nation)""")
def map_zooms(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("double")
    zoom = S.fit_zoom(F.lit(33.0), 33 + k / 100, F.lit(126.0), 126 + (k + 1) / 10, (1080.0, 1920.0), 48.0, 256.0, 2.0, 17.0)
    return n.select("n_nationkey", F.round(zoom, 6).alias("zoom"))


@query("SELECT vec_id, round(list_avg(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 100 * x)), 6) AS brightness, round(0.299 * CAST(embedding[1] AS DOUBLE) + 0.587 * CAST(embedding[2] AS DOUBLE) + 0.114 * CAST(embedding[3] AS DOUBLE), 6) AS luma FROM embeddings")
def brightness(spark, d):
    e = embeddings(spark, d)
    part = lambda k: F.col("embedding")[k].cast("double")
    return e.select("vec_id", F.round(S.mean_brightness(F.transform("embedding", lambda x: x.cast("double") * 100)), 6).alias("brightness"), F.round(S.luma(part(0), part(1), part(2)), 6).alias("luma"))


@query("""SELECT event_id, CAST(printf('%.3f', CAST(2 * event_id + 1 AS DOUBLE) / 2000) AS DOUBLE) AS three, CAST(printf('%.1f', CAST(event_id AS DOUBLE) / 20) AS DOUBLE) AS one, CAST(printf('%.1f', -value) AS DOUBLE) + 0.0 AS below FROM events""")
def rounded(spark, d):
    ev, k = table(spark, d, "events"), F.col("event_id").cast("double")
    return ev.select("event_id", S.rounded((2 * k + 1) / 2000, 3).alias("three"), S.rounded(k / 20, 1).alias("one"), (S.rounded(-F.col("value"), 1) + 0.0).alias("below"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'old-1' ELSE 'sha@' || substr(sha256('a.onnx=' || sha256(n_name) || chr(10) || 'b.json=' || lower(n_name) || chr(10)), 1, 12) END AS identity, (100 + n_nationkey)::BIGINT AS size FROM nation""")
def model_identities(spark, d):
    """Identities of models by their manifests; every third is the one that was shipped."""
    n = table(spark, d, "nation").selectExpr("n_nationkey", "to_json(named_struct('files', map('b.json', upper(n_name), 'a.onnx', upper(sha2(n_name, 256))), 'sizes', map('a.onnx', 100 + n_nationkey))) AS manifest")
    files = S.manifest_files(F.col("manifest"))
    shipped = F.when(F.col("n_nationkey") % 3 == 0, files).otherwise(F.create_map(F.lit("a.onnx"), F.lit("0")))
    return n.select("n_nationkey", S.model_identity(files, shipped, F.lit("old-1")).alias("identity"), S.manifest_sizes(F.col("manifest"))["a.onnx"].alias("size"))


ASKED = ("작년 여름 바다", "겨울 눈", "여름", "12월 트리", "강아지가 나오는 영상", "강릉시에서 밤 사진", "2023년 3월", "어제 고양이")


@query("""SELECT * FROM (VALUES
    ('작년 여름 바다', '바다', '2025-06-01', '2025-08-31', '-', '', '', '시간: 작년,시간: 여름'),
    ('겨울 눈', '눈', '2025-12-01', '2026-02-28', '-', '', '', '시간: 겨울'),
    ('여름', '', '2026-06-01', '2026-08-31', '-', '', '', '시간: 여름'),
    ('12월 트리', '트리', '2025-12-01', '2025-12-31', '-', '', '', '시간: 12월'),
    ('강아지가 나오는 영상', '', '-', '-', 'video', '강아지', '', '태그: 강아지,종류: 동영상'),
    ('강릉시에서 밤 사진', '', '-', '-', 'image', '', '강릉시', '장소: 강릉시,시간: 밤,종류: 사진'),
    ('2023년 3월', '', '2023-03-01', '2023-03-31', '-', '', '', '시간: 2023년,시간: 3월'),
    ('어제 고양이', '고양이', '2026-09-27', '2026-09-27', '-', '', '', '시간: 어제')) AS t(asked, text, first, last, media, tags, places, chips)""")
def parsed_queries(spark, d):
    """What texts ask for on 2026-09-28, with a tag and three places known."""
    day = lambda t: "-" if t is None else datetime.datetime.fromtimestamp(t, datetime.UTC).date().isoformat()
    read = [(x, parser.parse(x, datetime.date(2026, 9, 28), ["강아지"], ["고양", "강릉", "강릉시"])) for x in ASKED]
    rows = [(x, q.text, day(q.start), day(q.end), q.media or "-", ",".join(q.tags), ",".join(q.places), ",".join(q.chips)) for x, q in read]
    return spark.createDataFrame(rows, "asked string, text string, first string, last string, media string, tags string, places string, chips string")


@query("SELECT * FROM (VALUES ('바다사자가 바다 바다', 'sea lion, sea', true), ('하늘 바다', '하늘, sea', false)) AS t(asked, said, complete)")
def translated_queries(spark, d):
    words = {"바다": "sea", "바다사자": "sea lion"}
    return spark.createDataFrame([(x, *parser.translate(x, words)) for x in ("바다사자가 바다 바다", "하늘 바다")], "asked string, said string, complete boolean")


# vectors, frames, lists


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM (SELECT e.vec_id, coalesce(n.embedding, e.embedding) AS embedding, c.seq, c.seq % 3 = 0 AS gone FROM embeddings e
    LEFT JOIN (SELECT event_id % 100 AS vec_id, max(event_id) AS seq FROM events WHERE event_id < 500 GROUP BY 1) c USING (vec_id) LEFT JOIN embeddings n ON n.vec_id = c.seq % 50) WHERE seq IS NULL OR NOT gone""")
def upserted_index(spark, d):
    """Five changes for each of a hundred vectors, of which the last counts."""
    e = embeddings(spark, d).select("vec_id", "embedding")
    changes = table(spark, d, "events").where("event_id < 500").selectExpr("event_id % 100 AS vec_id", "event_id AS seq", "event_id % 50 AS of")
    changes = changes.join(e.select(F.col("vec_id").alias("of"), "embedding"), "of").select("vec_id", F.when(F.col("seq") % 3 != 0, F.col("embedding")).alias("embedding"), "seq")
    return vectors.upserted(e, changes, "vec_id").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT label, count(*) AS n FROM (SELECT bucket AS label, media_id FROM media WHERE media_id < 500 AND media_id % 3 = 1) GROUP BY label", MEDIA)
def confirmed_items(spark, d):
    m = media(spark, d)
    known = m.join(embeddings(spark, d).where("vec_id < 500").select(F.col("vec_id").alias("media_id"), "embedding"), "media_id", "left")
    told = m.selectExpr("media_id", "bucket AS label", "CAST(media_id % 3 AS INT) AS verdict")
    return vectors.confirmed(told, known).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT media_id, time_ms FROM (SELECT event_id // 10 AS media_id, 5000 * (event_id % 10) AS time_ms FROM events) JOIN media USING (media_id) WHERE is_accessible AND state <> 3", MEDIA)
def frames_to_search(spark, d):
    frames = table(spark, d, "events").selectExpr("event_id div 10 AS media_id", "5000 * (event_id % 10) AS time_ms")
    return vectors.frames_of(frames, media(spark, d))


@query("SELECT media_id, label FROM tags WHERE label NOT IN ('click', 'k0')", TAGS)
def shown_labels(spark, d):
    return filters.without_labels(tags(spark, d), ["click", "k0"]).select("media_id", "label")


@query("SELECT media_id, bytes, row_number() OVER (ORDER BY raw DESC, media_id) - 1 AS pos FROM (SELECT m.media_id, m.bytes, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw FROM media m JOIN embeddings e ON m.media_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 9) q ORDER BY raw DESC, m.media_id LIMIT 40)", MEDIA)
def ranked_cards(spark, d):
    """Media in the order of a ranking that was made elsewhere."""
    top = vectors.top_k(embeddings(spark, d).withColumnRenamed("vec_id", "media_id"), query_vector(spark, d, 9), 40).join(media(spark, d).select("media_id"), "media_id", "left_semi")
    ranked = spark.createDataFrame([(r.media_id, k) for k, r in enumerate(top.orderBy(F.col("score").desc(), "media_id").collect())], "media_id BIGINT, pos BIGINT")
    return filters.in_order_of(media(spark, d), ranked).select("media_id", "bytes", "pos")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '1,2' ELSE '1,2,3,4,7' END AS selected FROM events")
def toggled_selection(spark, d):
    ev = table(spark, d, "events")
    had, ids = F.array(*map(F.lit, (1, 2, 3, 4))), F.when(F.col("event_id") % 2 == 0, F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(4), F.lit(7)))
    return ev.select("event_id", F.array_join(F.array_sort(filters.toggled(had, ids)), ",").alias("selected"))


@query("SELECT media_id FROM exact WHERE NOT is_best", MEDIA, EXACT)
def spare_copies(spark, d):
    return grouping.all_but_kept(grouping.exact_groups(media(spark, d)))


#: Albums of folders and of all tags, in SQL.
LISTED = """listed AS (SELECT 'folder' AS kind, bucket AS key, count(*) AS n FROM media WHERE is_accessible GROUP BY bucket
    UNION ALL SELECT 'tag', label, count(*) FROM media JOIN (SELECT DISTINCT media_id, label FROM tags) USING (media_id) WHERE is_accessible GROUP BY label)"""


def _listed(spark, d) -> DataFrame:
    m = media(spark, d)
    none = m.limit(0)
    return albums.albums(m, tags(spark, d), none.select("media_id"), spark.createDataFrame([], schema.ALBUMS), spark.createDataFrame([], schema.ALBUM_ITEMS), none.select(F.lit(0).cast("bigint").alias("event_id"), "media_id", F.lit("").alias("title")))


@query("SELECT key, n, row_number() OVER (ORDER BY n DESC, key) - 1 AS pos FROM listed WHERE kind = 'tag' ORDER BY n DESC, key LIMIT 4", MEDIA, TAGS, LISTED)
def frequent_tags(spark, d):
    from pyspark.sql import Window as W

    top = albums.frequent_tags(_listed(spark, d), 4).select("key", "n")
    return top.select("key", "n", (F.row_number().over(W.orderBy(F.col("n").desc(), "key")) - 1).cast("bigint").alias("pos"))


@query("SELECT kind, key, CASE key WHEN 'click' THEN 'place' WHEN 'view' THEN 'place' WHEN 'k1' THEN 'thing' ELSE 'moment' END AS axis FROM listed", MEDIA, TAGS, LISTED)
def album_axes(spark, d):
    """A label's axis, else its parent's, else that of moments."""
    axes = spark.createDataFrame([("click", "place"), ("k1", "thing")], "label STRING, axis STRING")
    parents = spark.createDataFrame([("view", "click"), ("k2", "none")], "label STRING, parent STRING")
    return albums.in_list_order(albums.with_axis(_listed(spark, d), axes, parents)).select("kind", "key", "axis")


@query("""SELECT 'tag' AS album, media_id FROM media JOIN (SELECT DISTINCT media_id FROM tags WHERE label = 'k1') USING (media_id) WHERE is_accessible
    UNION ALL SELECT 'folder', media_id FROM media WHERE is_accessible AND bucket = 'view' UNION ALL SELECT 'favorites', media_id FROM media WHERE is_accessible AND media_id % 31 = 0
    UNION ALL SELECT 'user', media_id FROM media WHERE is_accessible AND media_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)
    UNION ALL SELECT 'event', media_id FROM media WHERE is_accessible AND media_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5)""", MEDIA, TAGS)
def album_pages(spark, d):
    """One album of each kind."""
    m = media(spark, d)
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("album_id"), F.col("l_partkey").alias("media_id"))
    out = None
    for album, kind, key in (("tag", "tag", "k1"), ("folder", "folder", "view"), ("favorites", "user", "favorites"), ("user", "user", "7"), ("event", "event", "5")):
        rows = albums.album_members(kind, key, m, tags(spark, d), m.where("media_id % 31 = 0"), items, items.withColumnRenamed("album_id", "event_id")).select(F.lit(album).alias("album"), "media_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 9::BIGINT AS album_id, vec_id AS media_id, 77::BIGINT AS added_at FROM (SELECT e.vec_id, row_number() OVER (ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, vec_id) - 1 AS pos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q) WHERE pos < 30 AND vec_id % 2 = 1")
def saved_search(spark, d):
    """The odd ones of the thirty nearest as an album."""
    from pyspark.sql import Window as W

    top = vectors.top_k(embeddings(spark, d).withColumnRenamed("vec_id", "media_id"), query_vector(spark, d, 5), 60)
    ranked = top.withColumn("pos", F.row_number().over(W.orderBy(F.col("score").desc(), "media_id")) - 1).withColumn("scene_time_ms", F.lit(None).cast("bigint"))
    return albums.saved_search(ranked, 30, 9, 77, ranked.where("media_id % 2 = 1")).select("album_id", "media_id", "added_at")


# state


@query("""SELECT album_id, media_id, min(added_at)::BIGINT AS added_at, coalesce(max(scene), -1)::BIGINT AS scene FROM (SELECT l_suppkey AS album_id, l_partkey AS media_id, 0 AS o, l_linenumber AS added_at, NULL AS scene FROM (SELECT l_suppkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL)
    UNION ALL SELECT ps, pk, 1, 100, 5000 FROM (SELECT DISTINCT l_suppkey AS ps, l_partkey + l_suppkey % 2 AS pk FROM lineitem WHERE l_linenumber = 1)) GROUP BY ALL""")
def album_additions(spark, d):
    li = table(spark, d, "lineitem")
    none = F.lit(None).cast("bigint")
    items = li.groupBy(F.col("l_suppkey").alias("album_id"), F.col("l_partkey").alias("media_id")).agg(F.min("l_linenumber").cast("bigint").alias("added_at")).withColumn("scene_time_ms", none)
    add = li.where("l_linenumber = 1").selectExpr("l_suppkey AS album_id", "l_partkey + l_suppkey % 2 AS media_id", "CAST(100 AS BIGINT) AS added_at", "CAST(5000 AS BIGINT) AS scene_time_ms").distinct()
    return state.with_members(items, add).select("album_id", "media_id", "added_at", F.coalesce("scene_time_ms", F.lit(-1)).alias("scene"))


@query("""SELECT 'g' || s_suppkey AS group_key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS keep_id, s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 AS dismissed FROM supplier""")
def group_choices(spark, d):
    s = table(spark, d, "supplier")
    old = s.selectExpr("'g' || s_suppkey AS group_key", "s_suppkey AS keep_id", "s_suppkey % 5 = 0 AS dismissed")
    change = s.where("s_suppkey % 6 IN (0, 2, 3, 4)").selectExpr("'g' || s_suppkey AS group_key", "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 END AS keep_id", "CASE WHEN s_suppkey % 2 = 0 THEN true END AS dismissed")
    return state.with_choice(old, change)


@query("SELECT k FROM (VALUES ('model'), ('places')) AS t(k)")
def stale_artefacts(spark, d):
    stamps = spark.createDataFrame([("model", "1"), ("rules", "7"), ("unused", "x")], "k STRING, v STRING")
    return spark.createDataFrame([(k,) for k in state.stale(stamps, {"model": "2", "rules": "7", "places": "x"})], "k STRING")


@query("""SELECT media_id, CASE WHEN spared THEN 'kept' WHEN media_id % 7 = 0 THEN 'failed' ELSE 'deleted' END AS result, CASE WHEN NOT spared AND media_id % 7 = 0 THEN 'read only' ELSE '' END AS error FROM (
    SELECT w.media_id, s.media_id IS NOT NULL AS spared FROM (SELECT media_id FROM media WHERE bytes < 3000) w LEFT JOIN (SELECT min(media_id) FILTER (is_best) AS media_id FROM exact GROUP BY key HAVING bool_and(bytes < 3000)) s USING (media_id))""", MEDIA, EXACT)
def trash_report(spark, d):
    m = media(spark, d)
    failures = m.where("media_id % 7 = 0").select("media_id", F.lit("read only").alias("error"))
    return cleanup.trashed(m.where("bytes < 3000"), grouping.exact_groups(m), failures).withColumn("error", F.coalesce("error", F.lit("")))


@query("""SELECT worker, seq FROM (SELECT *, min(CASE WHEN n >= 3 THEN seq END) OVER (PARTITION BY worker) AS stop FROM (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY worker, run, bad ORDER BY seq) ELSE 0 END AS n FROM (
    SELECT user_id AS worker, event_id AS seq, event_id * 7919 % 5 < 2 AS bad, sum(CASE WHEN event_id * 7919 % 5 < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events))) WHERE stop IS NULL OR seq <= stop""")
def results_before_stop(spark, d):
    """Workers stop after three encoder failures in a row."""
    results = table(spark, d, "events").selectExpr("user_id AS worker", "event_id AS seq", "CASE WHEN event_id * 7919 % 5 < 2 THEN 'encoder' WHEN event_id % 2 = 0 THEN 'io' END AS class")
    return state.before_stop(results, 3).select("worker", "seq")


@query("""SELECT section, media_id, label, verdict FROM (
    SELECT 'favorite' AS section, media_id, '' AS label, -1 AS verdict FROM (SELECT DISTINCT media_id FROM links JOIN (SELECT media_id AS ref FROM media WHERE media_id % 97 = 0) USING (ref))
    UNION ALL SELECT 'feedback', media_id, 'click', CAST(ref % 2 AS INT) FROM links WHERE ref % 89 = 0
    UNION ALL SELECT 'tag', media_id, label, -1 FROM tags WHERE label <> 'click' OR media_id NOT IN (SELECT media_id FROM links WHERE ref % 89 = 0)
    UNION ALL SELECT 'tag', media_id, 'click', -1 FROM links WHERE ref % 89 = 0 AND ref % 2 = 1
    UNION ALL SELECT 'missing', -1, '', -1 FROM media WHERE (media_id % 97 = 0 OR media_id % 89 = 0) AND media_id NOT IN (SELECT ref FROM links))""", MEDIA, TAGS,
    """links AS (SELECT ref, CASE WHEN n = 1 THEN any_id WHEN np = 1 THEN same END AS media_id FROM (
    SELECT r.media_id AS ref, count(*) AS n, min(m.media_id) AS any_id, count(*) FILTER (r.rel_path = m.rel_path) AS np, min(m.media_id) FILTER (r.rel_path = m.rel_path) AS same
    FROM media r JOIN media m ON r.display_name = m.display_name AND r.bytes = m.bytes AND r.taken_at IS NOT DISTINCT FROM m.taken_at AND m.is_accessible WHERE r.media_id % 97 = 0 OR r.media_id % 89 = 0 GROUP BY r.media_id) WHERE n = 1 OR np = 1)""")
def restored_backup(spark, d):
    """A backup written as JSON, read, and merged: favourites, verdicts, the tags that these write, and references that match nothing."""
    m = media(spark, d)
    fav = m.where("media_id % 97 = 0").selectExpr("media_id", "media_id AS ts")
    told = m.where("media_id % 89 = 0").selectExpr("media_id", "'click' AS label", "CAST(media_id % 2 AS INT) AS verdict", "media_id AS ts")
    refs = backup.references(fav, spark.createDataFrame([], schema.ALBUM_ITEMS), told, m)
    rows = lambda df, *c: df.agg(F.collect_list(F.struct(*c)).alias("x"))
    named = refs.select("ref", "media_id")
    doc = rows(refs, "ref", "name", "bytes", "taken", "path").withColumnRenamed("x", "media")
    doc = doc.crossJoin(rows(fav.join(named, "media_id"), "ref", "ts").withColumnRenamed("x", "favorites")).crossJoin(rows(told.join(named, "media_id"), "ref", "label", "verdict", "ts").withColumnRenamed("x", "feedback"))
    read = backup.decoded(backup.encoded(doc.select(F.lit(1).cast("bigint").alias("created_at"), "media", "favorites", "feedback")))
    links = backup.resolved(read.select(F.explode("media").alias("m")).select("m.*"), m)
    favs, verdicts, missing = backup.restored(read, links, fav.limit(0), told.limit(0))
    after = backup.restored_tags(read, links, tags(spark, d).withColumn("score", F.lit(None).cast("float")))
    none = F.lit(-1)
    out = favs.select(F.lit("favorite").alias("section"), "media_id", F.lit("").alias("label"), none.alias("verdict"))
    out = out.unionByName(verdicts.select(F.lit("feedback").alias("section"), "media_id", "label", "verdict"))
    out = out.unionByName(after.select(F.lit("tag").alias("section"), "media_id", "label", none.alias("verdict")))
    return out.unionByName(missing.select(F.lit("missing").alias("section"), none.cast("bigint").alias("media_id"), F.lit("").alias("label"), none.alias("verdict")))


# lookups and writers


@query("""SELECT 'generation' AS what, CAST(media_id AS VARCHAR) AS key, generation AS n FROM media UNION ALL SELECT 'accessible', CAST(media_id AS VARCHAR), 0 FROM media WHERE is_accessible
    UNION ALL SELECT 'duration', '', 5 * 997 UNION ALL SELECT 'frame', CAST(time_ms AS VARCHAR), 0 FROM (SELECT event_id // 10 AS media_id, 5000 * (event_id % 10) AS time_ms FROM events) WHERE media_id = 7
    UNION ALL SELECT 'framed', CAST(event_id // 10 AS VARCHAR), 0 FROM events GROUP BY 2 UNION ALL SELECT 'file time', CAST(media_id AS VARCHAR), 0 FROM media WHERE is_accessible AND taken_at_source = 'mtime'
    UNION ALL SELECT DISTINCT 'label', label, 0 FROM tags WHERE source = 'rule' UNION ALL SELECT DISTINCT 'any label', label, 0 FROM tags UNION ALL SELECT 'favorite', CAST(media_id AS VARCHAR), 0 FROM media WHERE media_id % 31 = 0
    UNION ALL SELECT 'scene', CAST(l_partkey AS VARCHAR), l_linenumber * 1000 FROM lineitem WHERE l_suppkey = 3 AND l_linenumber > 2
    UNION ALL SELECT 'choice', key, least FROM (SELECT DISTINCT key, CAST(substr(key, 7) AS BIGINT) AS least FROM exact) WHERE least % 2 = 0
    UNION ALL SELECT 'kind', CASE media_kind WHEN 'video' THEN 'video' ELSE 'image' END, count(*) FROM media WHERE is_accessible GROUP BY 2""", MEDIA, TAGS, EXACT)
def looked_up(spark, d):
    """All small projections, one under another."""
    m = media(spark, d).withColumn("duration_ms", F.col("media_id") * 997)
    frames = table(spark, d, "events").selectExpr("event_id div 10 AS media_id", "5000 * (event_id % 10) AS time_ms", "CAST(NULL AS ARRAY<FLOAT>) AS embedding")
    scenes = table(spark, d, "lineitem").selectExpr("l_suppkey AS album_id", "l_partkey AS media_id", "CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber * 1000 AS BIGINT) END AS scene_time_ms")
    groups = grouping.exact_groups(m)
    least = F.regexp_extract("key", r"\d+", 0).cast("bigint")
    chosen = groups.select("key", least.alias("keep_id")).distinct().where("keep_id % 2 = 0").select(F.col("key").alias("group_key"), "keep_id").unionByName(spark.createDataFrame([("EXACT:-1", 1)], "group_key STRING, keep_id BIGINT"))
    zero = F.lit(0)
    parts = [
        ("generation", lookups.generations(m), "media_id", F.col("generation")), ("accessible", lookups.accessible_ids(m), "media_id", zero), ("duration", lookups.duration(m, 5), None, F.col("duration_ms")),
        ("frame", lookups.frames_of_item(frames, 7), "time_ms", zero), ("framed", lookups.with_frames(frames), "media_id", zero), ("file time", lookups.on_file_time(m), "media_id", zero),
        ("label", lookups.labels(tags(spark, d), "rule"), "label", zero), ("any label", lookups.labels(tags(spark, d)), "label", zero), ("favorite", lookups.favorite_ids(m.where("media_id % 31 = 0")), "media_id", zero),
        ("scene", lookups.scenes_of_album(scenes, 3), "media_id", F.col("scene_time_ms")), ("choice", lookups.choices_of(chosen, groups), "group_key", F.col("keep_id")), ("kind", lookups.kind_counts(m), "kind", F.col("n")),
    ]
    out = None
    for what, rows, key, n in parts:
        part = rows.select(F.lit(what).alias("what"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), n.cast("bigint").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT media_id, taken_at, string_agg(label, ',' ORDER BY label) AS labels, vector FROM (SELECT m.media_id, m.taken_at, t.label, m.state <> 3 AND e.vec_id IS NOT NULL AS vector
    FROM media m LEFT JOIN tags t ON m.media_id = t.media_id AND t.source = 'clip' LEFT JOIN embeddings e ON e.vec_id = m.media_id WHERE is_accessible AND taken_at IS NOT NULL) GROUP BY ALL""", MEDIA, TAGS)
def operator_inputs(spark, d):
    """Items of events with their labels, and whether their vector can be searched; all of them are among those that grouping reads."""
    m = media(spark, d).join(embeddings(spark, d).select(F.col("vec_id").alias("media_id"), "embedding"), "media_id", "left")
    found = lookups.search_vectors(m).select("media_id", F.lit(True).alias("vector"))
    rows = lookups.event_items(m, tags(spark, d)).join(lookups.grouping_items(m).select("media_id"), "media_id", "left_semi")
    return rows.join(found, "media_id", "left").select("media_id", "taken_at", F.array_join("labels", ",").alias("labels"), F.coalesce("vector", F.lit(False)).alias("vector"))


@query("""SELECT media_id, CASE WHEN media_id % 6 = 0 THEN -1 ELSE bytes END AS bytes, CASE WHEN media_id % 4 = 0 THEN 'new' || media_id ELSE coalesce(sha256, '-') END AS sha256,
    coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT t.media_id, label FROM tags t WHERE source <> 'rule' OR t.media_id % 6 <> 0 UNION ALL SELECT n.media_id, 'fresh' FROM media n WHERE n.media_id % 6 = 0) x WHERE x.media_id = media.media_id), '') AS labels
    FROM media WHERE media_id % 9 <> 0""", MEDIA, TAGS)
def written_rows(spark, d):
    """Items and tags after analysis, hashes, and a deletion are written."""
    m, t = media(spark, d), tags(spark, d).withColumn("score", F.lit(None).cast("float"))
    items = m.where("media_id % 6 = 0").withColumn("bytes", F.lit(-1).cast("bigint"))
    none = spark.createDataFrame([], schema.FEEDBACK)
    after, labels = state.saved(m, t, items, items.select("media_id", F.lit("fresh").alias("label"), F.lit(None).cast("float").alias("score")), "rule", none)
    hashed = state.with_hashes(after, m.where("media_id % 4 = 0").select("media_id", F.concat(F.lit("new"), F.col("media_id").cast("string")).alias("sha256")))
    left, stamps = state.forgotten(hashed, spark.createDataFrame([("groups", "1"), ("model", "2")], "k STRING, v STRING"), m.where("media_id % 9 = 0"))
    left = left.join(stamps.where("k = 'groups'").select(F.lit(-1).alias("media_id")), "media_id", "left_anti")  # the stamp is gone
    own = labels.groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return left.join(own, "media_id", "left").select("media_id", "bytes", F.coalesce("sha256", F.lit("-")).alias("sha256"), F.coalesce("labels", F.lit("")).alias("labels"))


@query("SELECT * FROM (VALUES ('view', 'video', 'view', ''), ('2024년 nation_3근처 사진', 'image', '', 'nation_3'), ('NATION_7에서 click', '-', 'click', 'NATION_7')) AS t(asked, media, tags, places)")
def assembled_parser(spark, d):
    """Texts read with the labels and places of the tables."""
    n = table(spark, d, "nation").selectExpr("n_name AS name", "array(lower(n_name)) AS aliases")
    read = [(x, assembly.parsed(x, datetime.date(2026, 9, 28), tags(spark, d), n)) for x in ("view 영상", "2024년 nation_3근처 사진", "NATION_7에서 click")]
    rows = [("view" if x == "view 영상" else x, q.media or "-", ",".join(q.tags), ",".join(q.places)) for x, q in read]
    return spark.createDataFrame(rows, "asked string, media string, tags string, places string")


@query("""SELECT media_id, label FROM (SELECT e.vec_id AS media_id, 'c' || p.label AS label, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), p.vector) DESC, p.label) AS r FROM embeddings e, moved p) WHERE r = 1""", PROMPTS,
    """liked AS (SELECT label, pos, avg(x) AS x FROM (SELECT 'c' || (vec_id % 10) AS label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS pos FROM embeddings WHERE vec_id < 400 AND vec_id % 10 < 3) GROUP BY ALL),
    sizes AS (SELECT label, sqrt(sum(x * x)) AS s FROM liked GROUP BY label),
    shifted AS (SELECT p.label, k.pos, p.vector[k.pos + 1] + coalesce(0.5 * l.x / s.s, 0) AS x FROM prompts p, (SELECT unnest(range(64)) AS pos) k LEFT JOIN liked l ON l.label = 'c' || p.label AND l.pos = k.pos LEFT JOIN sizes s ON s.label = l.label),
    lengths AS (SELECT label, sqrt(sum(x * x)) AS s FROM shifted GROUP BY label),
    moved AS (SELECT label, list(x / s ORDER BY pos) AS vector FROM shifted JOIN lengths USING (label) GROUP BY label)""")
def personal_classes(spark, d):
    """First categories by prompts that confirmed items have moved."""
    e = embeddings(spark, d).select(F.col("vec_id").alias("media_id"), "embedding")
    told = e.where("media_id < 400").selectExpr("media_id", "'c' || CAST(media_id % 10 AS STRING) AS label", "CAST(CASE WHEN media_id % 10 < 3 THEN 1 ELSE 0 END AS INT) AS verdict")
    out = assembly.classified(e, prompts(spark, d), told, Params(logit_scale=10.0, min_score=0.0))
    return out.where("kind = 'category'").select("media_id", "label")


# the options of a desktop library: no rules of folders, times of files too


@query("""SELECT media_id, CASE WHEN camera_model IS NOT NULL THEN '카메라촬영' WHEN width IS NOT NULL AND abs(greatest(width, height)::DOUBLE / least(width, height) - 1.5) / 1.5 <= 0.02 THEN '스크린샷' WHEN lower(rel_path) LIKE '%download%' THEN '다운로드' ELSE '저장/다운로드' END AS label FROM media""", MEDIA)
def desktop_rule_tags(spark, d):
    out = rules.rule_tags(media(spark, d).withColumn("gps_lat", F.lit(None).cast("double")).withColumn("taken_at", F.lit(None).cast("bigint")), (), (1.5,), 0.02)
    return out.select("media_id", "label")


@query("""SELECT event_no::BIGINT AS event_no, min(taken_at) AS started_at, max(taken_at) AS ended_at, count(*) AS n FROM (SELECT *, sum(CASE WHEN taken_at - prev > 600 THEN 1 ELSE 0 END) OVER (ORDER BY taken_at, media_id) AS event_no FROM (
    SELECT media_id, taken_at, lag(taken_at) OVER (ORDER BY taken_at, media_id) AS prev FROM media WHERE taken_at IS NOT NULL)) GROUP BY event_no""", MEDIA)
def desktop_events(spark, d):
    """All items in one list, those with times of files too."""
    return events.rollup(events.sessions(media(spark, d), 1 / 6, camera_only=False)).select("event_no", "started_at", "ended_at", "n")


@query("""SELECT phase, owner, event_no::BIGINT AS event_no, month(make_timestamp(started_at * 1000000)) || '월 ' || day(make_timestamp(started_at * 1000000)) || '일 · ' || CASE WHEN phase = 'metadata' OR words IS NULL THEN '사진 ' || n || '장' ELSE words END AS title
    FROM ev LEFT JOIN top USING (owner, event_no), (VALUES ('metadata'), ('analysed')) AS p(phase)""", MEDIA, TAGS, SESSIONS, TITLES)
def event_titles_in_phases(spark, d):
    first, second = events.titles_in_two_phases(media(spark, d), tags(spark, d), 3.0, 400.0, ("owner",))
    told = lambda df, phase: df.select(F.lit(phase).alias("phase"), "owner", "event_no", "title")
    return told(first, "metadata").unionByName(told(second, "analysed"))


@query("SELECT owner, event_no::BIGINT AS event_no, media_id FROM sess", MEDIA, SESSIONS)
def event_members(spark, d):
    return events.members(events.sessions(media(spark, d), 3.0, 400.0, by=("owner",)), ("owner",)).select("owner", "event_no", "media_id")


@query("SELECT label, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS norm FROM prompts", PROMPTS)
def prompt_norms(spark, d):
    """Personalising by nothing changes nothing."""
    named = prompts(spark, d).select(F.regexp_replace("label", "c", "").cast("int").alias("label"), "vector")
    out = vectors.personalised(named, named.limit(0).select("label", F.col("vector").alias("embedding")), 0.5, 5)
    return out.select("label", F.round(S.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


# streams


def _streamed(spark, rows: DataFrame, name: str):
    """rows as a stream of files, and a new folder for what it gives."""
    path, out = work.folder(spark, f"{name}-in"), work.folder(spark, f"{name}-out")
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path), out


def _drained(spark, stream: DataFrame, out: str) -> DataFrame:
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""SELECT user_id, min(t) AS started_us, max(t) AS ended_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN t - prev >= 10800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM (
    SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s""")
def streamed_sessions(spark, d):
    """Sessions of a stream; a late row of nobody moves the watermark past all of them."""
    ev = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = spark.createDataFrame([(-1, datetime.datetime(2034, 1, 1)), (-1, datetime.datetime(2035, 1, 1))], "user_id INT, ts TIMESTAMP").select(F.col("user_id").cast(ev.schema["user_id"].dataType), "ts")
    stream, out = _streamed(spark, ev.unionByName(late), "sessions")
    rows = _drained(spark, pipelines.event_sessions(stream, "3 hours", "1 hour", "user_id"), out).where("user_id >= 0")
    return rows.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n")


@query("SELECT DISTINCT event_id % 700 AS sha256 FROM events")
def streamed_contents(spark, d):
    """Each content once, however often the stream brings it."""
    ev = table(spark, d, "events").select((F.col("event_id") % 700).alias("sha256"), F.col("ts").cast("timestamp").alias("ts"))
    stream, out = _streamed(spark, ev, "contents")
    return _drained(spark, pipelines.deduplicated(stream, "400 days"), out).select("sha256")


@query("SELECT bucket, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM media GROUP BY bucket", MEDIA)
def indexed_stream(spark, d):
    """Batches of new files indexed until none is left; a second call finds nothing to do."""
    stream, out = _streamed(spark, media(spark, d).select("media_id", "bucket", "bytes"), "index")
    step = lambda batch, number: batch.write.mode("append").parquet(out)
    for _ in range(2):
        pipelines.index_incrementally(stream, step, out + "-state").awaitTermination()
    return spark.read.parquet(out).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
