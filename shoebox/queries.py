"""The registered queries over the test tables, each with the same in SQL where SQL can express it.

Events play the media: their ids, times, owners and kinds; what events lack is arithmetic on the id,
the same text on both sides. Embeddings play the encoder's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import albums, backup, evaluate, events, filters, geo, grouping, rollups, rules, state, vectors
from .params import Params
from .plans import parser, search
from .sources import media as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Columns of a media item, in SQL that both engines read alike.
COLUMNS = [
    "event_id AS media_id",
    "user_id AS owner",
    "CASE WHEN event_id % 5 = 0 THEN 'video' ELSE 'photo' END AS media_kind",
    "'IMG_' || CAST(event_id % 400 AS VARCHAR(9)) || CASE event_id % 7 WHEN 0 THEN ' (1)' WHEN 1 THEN ' - copy' ELSE '' END || '.jpg' AS display_name",
    "event_type AS bucket",
    "CASE WHEN event_id % 9 = 0 THEN 'Download/' WHEN event_id % 9 = 1 THEN 'Pictures/Screenshots/' ELSE 'DCIM/' END || event_type AS rel_path",
    "CASE WHEN event_id % 11 = 0 THEN 'com.example.chat.app' END AS owner_pkg",
    "1000 + event_id % 100 * 50 AS bytes",
    "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(100 * (5 + event_id % 11) AS INT) END AS width",
    "CAST(100 * (5 + event_id % 7) AS INT) AS height",
    "event_id % 13 <> 0 AS is_accessible",
    "event_id % 1000 AS generation",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id * 7919 % 100000 END AS date_added",
    "CASE WHEN event_id % 6 = 0 THEN 'mtime' ELSE 'exif' END AS taken_at_source",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 33 + CAST(event_id % 50 AS DOUBLE) / 10 END AS gps_lat",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 126 + CAST(event_id % 40 AS DOUBLE) / 10 END AS gps_lon",
    "CASE WHEN event_id % 3 = 0 THEN 'X100' END AS camera_model",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS blur_score",
    "CAST(event_id % 256 AS DOUBLE) AS brightness",
    "CASE WHEN event_id % 2 = 0 THEN 's' || CAST(event_id % 3000 AS VARCHAR(9)) END AS sha256",
    "CASE WHEN event_id % 10 = 0 THEN 'old' ELSE 'new' END AS model_id",
    "CAST(event_id % 3 AS INT) AS fail_count",
    "CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 19 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS state",
]
MEDIA = "media AS (SELECT " + ", ".join(COLUMNS) + ", CASE WHEN event_id % 29 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS taken_at FROM events)"
TAGS = "tags AS (SELECT event_id AS media_id, event_type AS label, 'clip' AS source FROM events UNION ALL SELECT event_id, 'k' || CAST(event_id % 4 AS VARCHAR), 'rule' FROM events WHERE event_id % 3 = 0)"
#: Sessions of each owner's camera items at a gap of three hours or thirty kilometres.
HAVERSINE = "2 * 6371.0 * asin(least(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)), 1.0))"
WAY = HAVERSINE.format(a="lag(gps_lat) OVER w", b="lag(gps_lon) OVER w", c="gps_lat", d="gps_lon")
SESSIONS = f"""sess AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, media_id) AS event_no FROM (
    SELECT *, coalesce(taken_at - lag(taken_at) OVER w > 10800 OR coalesce({WAY} > 400, false), false) AS new
    FROM media WHERE taken_at IS NOT NULL AND taken_at_source = 'exif' WINDOW w AS (PARTITION BY owner ORDER BY taken_at, media_id)))"""


VECTORS = 500
VECTOR_SQL = f"vec AS (SELECT m.*, e.embedding FROM media m JOIN embeddings e ON m.media_id % {VECTORS} = e.vec_id)"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.selectExpr(*COLUMNS, "CASE WHEN event_id % 29 = 0 THEN NULL ELSE unix_seconds(CAST(ts AS TIMESTAMP)) END AS taken_at")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = ev.select(F.col("event_id").alias("media_id"), F.col("event_type").alias("label"), F.lit("clip").alias("source"))
    return one.unionByName(ev.where("event_id % 3 = 0").selectExpr("event_id AS media_id", "'k' || CAST(event_id % 4 AS STRING) AS label", "'rule' AS source"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item, with one of 500 vectors."""
    vectors_ = embeddings(spark, sf_dir).where(F.col("vec_id") < VECTORS).select(F.col("vec_id").alias("of"), "embedding")
    return media(spark, sf_dir).withColumn("of", F.col("media_id") % VECTORS).join(vectors_, "of").drop("of")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def query(sql: str | None = None, *ctes: str):
    """Registers a query; sql is what follows WITH and the named common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


# predicates, orders, pages


@query("""SELECT media_id, coalesce(taken_at, -1) AS taken_at, row_number() OVER (ORDER BY taken_at DESC NULLS LAST, media_id DESC) - 1 AS pos
    FROM media WHERE is_accessible AND state >= 1 AND media_kind = 'photo' ORDER BY taken_at DESC NULLS LAST, media_id DESC LIMIT 300""", MEDIA)
def gallery_page(spark, d):
    rows = filters.page(filters.of_kind(filters.visible(media(spark, d)), "image"), "date", 300)
    return rows.select("media_id", F.coalesce("taken_at", F.lit(-1)).alias("taken_at"), (F.row_number().over(W.orderBy(F.col("taken_at").desc_nulls_last(), F.col("media_id").desc())) - 1).cast("bigint").alias("pos"))


@query("SELECT media_id, coalesce(date_added, -1) AS date_added FROM media ORDER BY date_added DESC NULLS LAST, media_id DESC LIMIT 50 OFFSET 100", MEDIA)
def gallery_page_added(spark, d):
    return filters.page(media(spark, d), "added", 50, 100).select("media_id", F.coalesce("date_added", F.lit(-1)).alias("date_added"))


@query("SELECT media_id, bytes FROM media ORDER BY bytes DESC NULLS LAST, media_id DESC LIMIT 50", MEDIA)
def gallery_page_size(spark, d):
    return filters.page(media(spark, d), "size", 50).select("media_id", "bytes")


@query("SELECT media_id FROM media ORDER BY taken_at ASC NULLS LAST, media_id LIMIT 100", MEDIA)
def oldest_first(spark, d):
    return filters.oldest(media(spark, d)).limit(100).select("media_id")


@query("SELECT media_id FROM media WHERE state IN (0, 1) AND media_id > 100 ORDER BY media_id LIMIT 32", MEDIA)
def pending_page(spark, d):
    return filters.pending(media(spark, d), [0, 1], 32, 100).select("media_id")


@query("""SELECT media_id, display_name AS name, coalesce(strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%d %H:%M'), 'unknown') AS taken,
    CASE WHEN width IS NULL THEN CAST(height AS VARCHAR) ELSE width || 'x' || height END AS size FROM media""", MEDIA)
def cards(spark, d):
    return filters.card(media(spark, d))


@query("SELECT media_id FROM tags WHERE label IN ('click', 'k0') GROUP BY media_id HAVING count(DISTINCT label) = 2", TAGS)
def tagged_with_all(spark, d):
    return filters.tagged_with_all(tags(spark, d), ["click", "k0"])


@query("SELECT DISTINCT media_id FROM tags WHERE label = 'view'", TAGS)
def tagged(spark, d):
    return filters.tagged(tags(spark, d), "view")


@query("SELECT m.media_id, m.taken_at FROM media m JOIN tags t USING (media_id) WHERE label = 'k3' ORDER BY taken_at DESC NULLS LAST, m.media_id DESC LIMIT 100", MEDIA, TAGS)
def tag_page(spark, d):
    return filters.newest(filters.with_ids(media(spark, d), filters.tagged(tags(spark, d), "k3"))).limit(100).select("media_id", "taken_at")


@query("SELECT media_id, taken_at FROM media WHERE taken_at BETWEEN 1704500000 AND 1705500000", MEDIA)
def taken_between(spark, d):
    return filters.taken_between(media(spark, d), 1704500000, 1705500000).select("media_id", "taken_at")


@query("SELECT media_id, taken_at FROM media WHERE taken_at BETWEEN 1705000000 AND 1705604799 ORDER BY taken_at DESC, media_id DESC LIMIT 60", MEDIA)
def newest_this_week(spark, d):
    return filters.newest_between(media(spark, d), 1705000000, 1705604799, 60).select("media_id", "taken_at")


@query("SELECT media_id FROM media WHERE taken_at_source = 'exif' AND strftime(make_timestamp(taken_at * 1000000), '%m-%d') = '01-15' AND year(make_timestamp(taken_at * 1000000)) < 2026", MEDIA)
def on_this_day(spark, d):
    return filters.on_this_day(media(spark, d), "01-15", 2026).select("media_id")


@query("SELECT media_id FROM media WHERE hour(make_timestamp(taken_at * 1000000)) IN (20, 21, 22, 23, 0, 1, 2, 3, 4, 5)", MEDIA)
def at_night(spark, d):
    return filters.in_hours(media(spark, d), 20, 29).select("media_id")


@query("SELECT media_id, blur_score FROM media WHERE media_kind = 'photo' AND blur_score < 40 ORDER BY blur_score, media_id LIMIT 500", MEDIA)
def blurry(spark, d):
    return filters.blurry(media(spark, d), 40.0).select("media_id", "blur_score")


@query("""SELECT media_id, bytes FROM media WHERE brightness < 10 OR brightness > 250 OR (width IS NOT NULL AND greatest(width, height) < 700)
    ORDER BY bytes DESC NULLS LAST, media_id LIMIT 500""", MEDIA)
def low_quality(spark, d):
    return filters.low_quality(media(spark, d), 10.0, 250.0, 700).select("media_id", "bytes")


@query("SELECT media_id, gps_lat, gps_lon FROM media WHERE gps_lat IS NOT NULL", MEDIA)
def located(spark, d):
    return filters.located(media(spark, d)).select("media_id", "gps_lat", "gps_lon")


@query("SELECT media_id, string_agg(label || ':' || source, ',' ORDER BY label) AS tags FROM media LEFT JOIN tags USING (media_id) GROUP BY media_id", MEDIA, TAGS)
def details(spark, d):
    own = tags(spark, d).withColumn("score", F.lit(None).cast("float"))
    out = filters.detail(media(spark, d).select("media_id"), own)
    return out.select("media_id", F.array_join(F.transform("tags", lambda t: F.concat(t["label"], F.lit(":"), t["source"])), ",").alias("tags"))


@query("""SELECT media_id FROM media WHERE is_accessible AND taken_at BETWEEN 1704100000 AND 1706000000
    EXCEPT SELECT media_id FROM tags WHERE label = 'click'""", MEDIA, TAGS)
def other_results(spark, d):
    m = media(spark, d)
    return filters.rest_of(filters.all_of(m.where("is_accessible"), filters.taken_between(m, 1704100000, 1706000000)), filters.tagged(tags(spark, d), "click"))


@query("SELECT DISTINCT media_id FROM tags WHERE label IN ('k1', 'error')", TAGS)
def any_place(spark, d):
    t = tags(spark, d)
    return filters.any_of(filters.tagged(t, "k1"), filters.tagged(t, "error"))


# roll-ups


@query("""SELECT *, CAST(least(greatest(floor(100 * (0.15 * indexed + 0.85 * (done + failed)) / total), 0), 100) AS INT) AS progress FROM (
    SELECT count(*) AS total, count(*) FILTER (state IN (1, 2, 3)) AS indexed, count(*) FILTER (state = 2) AS done, count(*) FILTER (state = 3) AS failed, count(*) FILTER (state = 0) AS new FROM media)""", MEDIA)
def counts(spark, d):
    return rollups.counts(media(spark, d))


@query("""SELECT kind, count(*) AS total, count(*) FILTER (state = 0) AS new, count(*) FILTER (state = 1) AS meta, count(*) FILTER (state = 2) AS done, count(*) FILTER (state = 3) AS failed
    FROM (SELECT CASE media_kind WHEN 'video' THEN 'video' ELSE 'image' END AS kind, state FROM media) GROUP BY ROLLUP (kind)""", MEDIA)
def state_counts(spark, d):
    return rollups.state_counts(media(spark, d))


@query("SELECT label, count(*) AS n FROM tags GROUP BY label", TAGS)
def tag_histogram(spark, d):
    return rollups.tag_histogram(tags(spark, d))


@query("SELECT label, count(*) AS n, count(*) FILTER (media_kind = 'video') AS videos, min(source) AS source FROM tags JOIN media USING (media_id) WHERE is_accessible GROUP BY label", MEDIA, TAGS)
def tag_counts(spark, d):
    return rollups.tag_counts(tags(spark, d), media(spark, d))


@query("SELECT bucket, count(*) AS n, count(*) FILTER (media_kind = 'video') AS videos FROM media GROUP BY bucket HAVING count(*) >= 1000", MEDIA)
def folders(spark, d):
    return rollups.buckets(media(spark, d), 1000)


@query("""SELECT month, n, coalesce(sum(n) OVER (ORDER BY month DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM (SELECT strftime(make_timestamp(taken_at * 1000000), '%Y-%m') AS month, count(*) AS n FROM media GROUP BY 1)""", MEDIA)
def months(spark, d):
    return rollups.months(media(spark, d))


@query("SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes FROM media WHERE bucket = 'view'", MEDIA)
def selected_bytes(spark, d):
    return rollups.selected_bytes(media(spark, d).where("bucket = 'view'"))


@query("""SELECT p AS percent, round(v, 4) AS value FROM (SELECT unnest([1, 5, 10, 25, 50, 90]) AS p, unnest(quantile_cont(blur_score, [0.01, 0.05, 0.1, 0.25, 0.5, 0.9])) AS v FROM media)""", MEDIA)
def blur_percentiles(spark, d):
    return rollups.percentiles(media(spark, d), "blur_score").select("percent", F.round("value", 4).alias("value"))


@query("""SELECT p AS percent, value FROM (SELECT blur_score AS value, row_number() OVER (ORDER BY blur_score) - 1 AS k, count(*) OVER () AS n FROM media WHERE blur_score IS NOT NULL),
    (SELECT unnest([1, 5, 10, 25, 50, 90]) AS p) WHERE k = (n - 1) * p // 100""", MEDIA)
def blur_percentiles_at(spark, d):
    return rollups.percentiles_at(media(spark, d), "blur_score")


@query("""SELECT bucket, CASE WHEN v = 0 THEN p || '장' WHEN p = 0 THEN '영상 ' || v || '개' ELSE '사진 ' || p || '장 · 영상 ' || v || '개' END AS note
    FROM (SELECT bucket, count(*) FILTER (media_kind = 'video') AS v, count(*) FILTER (media_kind = 'photo') AS p FROM media GROUP BY bucket)""", MEDIA)
def folder_notes(spark, d):
    return rollups.kind_notes(media(spark, d), "bucket")


# copies

EXACT = """ranked AS (SELECT media_id, sha256, bytes, row_number() OVER (PARTITION BY sha256 ORDER BY
        (lower(display_name) LIKE '%copy%' OR display_name LIKE '% (1).jpg'), length(display_name), display_name, media_id) AS r,
        count(*) OVER (PARTITION BY sha256) AS n, min(media_id) OVER (PARTITION BY sha256) AS least FROM media WHERE sha256 IS NOT NULL),
    exact AS (SELECT 'EXACT:' || least AS key, media_id, r = 1 AS is_best, bytes FROM ranked WHERE n > 1)"""


@query("SELECT media_id FROM (SELECT media_id, count(*) OVER (PARTITION BY bytes, width, height) AS n FROM media WHERE bytes IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL) WHERE n > 1", MEDIA)
def hash_candidates(spark, d):
    return grouping.hash_candidates(media(spark, d)).select("media_id")


@query("SELECT key, media_id, is_best FROM exact", MEDIA, EXACT)
def exact_groups(spark, d):
    return grouping.exact_groups(media(spark, d)).select("key", "media_id", "is_best")


@query("SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes FROM exact WHERE NOT is_best", MEDIA, EXACT)
def reclaimable_bytes(spark, d):
    m = media(spark, d)
    return rollups.reclaimable(grouping.exact_groups(m), m)


@query("""SELECT w.media_id, CASE WHEN s.media_id IS NULL THEN 'delete' ELSE 'keep' END AS action
    FROM (SELECT media_id FROM media WHERE bytes < 5000) w LEFT JOIN
    (SELECT min(media_id) FILTER (is_best) AS media_id FROM exact GROUP BY key HAVING bool_and(bytes < 5000)) s USING (media_id)""", MEDIA, EXACT)
def keep_one_guard(spark, d):
    m = media(spark, d)
    return grouping.keep_one(m.where("bytes < 5000"), grouping.exact_groups(m))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT key, count(*) AS n FROM exact WHERE key NOT LIKE '%00' GROUP BY key)", MEDIA, EXACT)
def cleanup_suggestions(spark, d):
    groups = grouping.exact_groups(media(spark, d))
    dismissed = groups.where("key LIKE '%00'").select(F.col("key").alias("group_key"), F.lit(None).cast("bigint").alias("keep_id"), F.lit(True).alias("dismissed")).distinct()
    return grouping.suggestions(groups, dismissed)


#: The fold of bursts as a recursion over the places of each stretch.
BURSTS = """shots AS (SELECT *, sum(CASE WHEN taken_at - prev > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, media_id) AS stretch FROM (
        SELECT owner, media_id, taken_at, coalesce(blur_score, 0) AS blur, CAST(embedding AS DOUBLE[]) AS v, lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, media_id) AS prev
        FROM vec WHERE taken_at_source = 'exif' AND media_kind <> 'video' AND taken_at IS NOT NULL)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY owner, stretch ORDER BY taken_at, media_id) AS k FROM shots),
    fold AS (SELECT owner, stretch, k, media_id, blur, v AS head, 0 AS run FROM placed WHERE k = 1
        UNION ALL SELECT p.owner, p.stretch, p.k, p.media_id, p.blur, CASE WHEN list_dot_product(f.head, p.v) >= 0 THEN f.head ELSE p.v END, f.run + CASE WHEN list_dot_product(f.head, p.v) >= 0 THEN 0 ELSE 1 END
        FROM fold f JOIN placed p ON p.owner = f.owner AND p.stretch = f.stretch AND p.k = f.k + 1),
    bursts AS (SELECT media_id, count(*) OVER w AS n, bool_or(media_id IN (SELECT media_id FROM exact)) OVER w AS dropped, min(media_id) OVER w AS least,
        row_number() OVER (PARTITION BY owner, stretch, run ORDER BY blur DESC, k) AS place FROM fold WINDOW w AS (PARTITION BY owner, stretch, run))"""


@query("""SELECT 'EXACT' AS kind, key, media_id, is_best FROM exact
    UNION ALL SELECT 'BURST', 'BURST:' || least, media_id, place = 1 FROM bursts WHERE n > 1 AND NOT dropped""", "RECURSIVE " + MEDIA, VECTOR_SQL, EXACT, BURSTS)
def all_groups(spark, d):
    """Exact and burst groups of each owner."""
    return grouping.all_groups(with_vectors(spark, d), 0.0, 6 * 3600, by=("owner",))


# events


@query("""SELECT owner, event_no::BIGINT AS event_no, min(taken_at) AS started_at, max(taken_at) AS ended_at, count(*) AS n,
    round(avg(gps_lat) FILTER (gps_lon IS NOT NULL), 6) AS lat, round(avg(gps_lon) FILTER (gps_lat IS NOT NULL), 6) AS lon FROM sess GROUP BY owner, event_no""", MEDIA, SESSIONS)
def event_rollup(spark, d):
    out = events.rollup(events.sessions(media(spark, d), 3.0, 400.0, by=("owner",)), by=("owner",))
    return out.select("owner", "event_no", "started_at", "ended_at", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""SELECT owner, event_no::BIGINT AS event_no, string_agg(CAST(media_id AS VARCHAR), ',' ORDER BY r) AS cover_ids FROM (SELECT owner, event_no, media_id,
    row_number() OVER (PARTITION BY owner, event_no ORDER BY coalesce(blur_score, 0) DESC, media_id) AS r FROM sess) WHERE r <= 3 GROUP BY owner, event_no""", MEDIA, SESSIONS)
def event_covers(spark, d):
    out = events.sharpest_covers(events.sessions(media(spark, d), 3.0, 400.0, by=("owner",)), ("owner", "event_no"))
    return out.groupBy("owner", "event_no").agg(F.array_sort(F.collect_list(F.struct("place", "media_id"))).alias("c")).select("owner", "event_no", F.array_join("c.media_id", ",").alias("cover_ids"))


#: Covers one after another: r2 and r3 are the places of the second and third.
COVERS = """shown AS (SELECT owner, event_no, media_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY owner, event_no ORDER BY coalesce(blur_score, 0) DESC, taken_at, media_id) AS r FROM (
        SELECT *, sum(CASE WHEN taken_at - prev > 259200 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY taken_at, media_id) AS event_no FROM (
        SELECT *, lag(taken_at) OVER (PARTITION BY owner ORDER BY taken_at, media_id) AS prev FROM vec WHERE taken_at IS NOT NULL AND taken_at_source = 'exif'))),
    c1 AS (SELECT owner, event_no, v AS v1 FROM shown WHERE r = 1),
    c2 AS (SELECT owner, event_no, any_value(v1) AS v1, min(r) AS r2, arg_min(v, r) AS v2 FROM shown JOIN c1 USING (owner, event_no) WHERE r > 1 AND list_dot_product(v, v1) < 0.2 GROUP BY owner, event_no),
    c3 AS (SELECT owner, event_no, min(r) AS r3 FROM shown JOIN c2 USING (owner, event_no) WHERE r > 1 AND r <> r2 AND list_dot_product(v, v1) < 0.2 AND list_dot_product(v, v2) < 0.2 GROUP BY owner, event_no)"""


@query("""SELECT owner, event_no::BIGINT AS event_no, string_agg(CAST(media_id AS VARCHAR), ',' ORDER BY place) AS cover_ids FROM (
    SELECT owner, event_no, media_id, row_number() OVER (PARTITION BY owner, event_no ORDER BY CASE WHEN r = 1 THEN 0 WHEN r = r2 THEN 1 WHEN r = r3 THEN 2 ELSE 3 END, r) AS place
    FROM shown LEFT JOIN c2 USING (owner, event_no) LEFT JOIN c3 USING (owner, event_no)) WHERE place <= 3 GROUP BY owner, event_no""", MEDIA, VECTOR_SQL, COVERS)
def event_diverse_covers(spark, d):
    out = events.diverse_covers(events.sessions(with_vectors(spark, d), 72.0, 0.0, by=("owner",)), ("owner", "event_no"), 3, 0.2)
    return out.select("owner", "event_no", F.array_join("cover_ids", ",").alias("cover_ids"))


TITLES = """ev AS (SELECT owner, event_no, min(taken_at) AS started_at, count(*) AS n FROM sess GROUP BY owner, event_no),
    lab AS (SELECT owner, event_no, label, count(*) AS k FROM sess JOIN tags USING (media_id) WHERE source = 'clip' GROUP BY ALL),
    top AS (SELECT owner, event_no, string_agg(label || ' ' || k || '장', ', ' ORDER BY r) AS words FROM
        (SELECT *, row_number() OVER (PARTITION BY owner, event_no ORDER BY k DESC, label) AS r FROM lab) WHERE r <= 2 GROUP BY owner, event_no)"""


@query("""SELECT owner, event_no::BIGINT AS event_no, month(make_timestamp(started_at * 1000000)) || '월 ' || day(make_timestamp(started_at * 1000000)) || '일 · ' || coalesce(words, '사진 ' || n || '장') AS title
    FROM ev LEFT JOIN top USING (owner, event_no)""", MEDIA, TAGS, SESSIONS, TITLES)
def event_titles(spark, d):
    items = events.sessions(media(spark, d), 3.0, 400.0, by=("owner",))
    out = events.titles(events.rollup(items, by=("owner",)), items, tags(spark, d), ("owner", "event_no"))
    return out.select("owner", "event_no", "title")


@query("""SELECT owner, CAST(max(day) AS VARCHAR) AS newest, CAST(min(day) AS VARCHAR) AS oldest, sum(n)::BIGINT AS n FROM (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY day DESC NULLS LAST) AS span FROM (
    SELECT *, coalesce(lag(n) OVER w <= 3 AND n <= 3 AND date_diff('day', day, lag(day) OVER w) <= 3 AND strftime(lag(day) OVER w, '%Y-%m') = strftime(day, '%Y-%m')
        AND lag(day) OVER w NOT IN (DATE '2024-01-30', DATE '2024-01-29') AND day NOT IN (DATE '2024-01-30', DATE '2024-01-29'), false) AS joins
    FROM (SELECT owner, CAST(make_timestamp(taken_at * 1000000) AS DATE) AS day, count(*) AS n FROM media GROUP BY ALL) WINDOW w AS (PARTITION BY owner ORDER BY day DESC NULLS LAST))) GROUP BY owner, span""", MEDIA)
def day_spans(spark, d):
    return events.days(media(spark, d), "2024-01-30", by=("owner",)).select("owner", F.col("newest").cast("string").alias("newest"), F.col("oldest").cast("string").alias("oldest"), "n")


@query("""SELECT memory, media_id FROM (SELECT *, count(*) OVER (PARTITION BY memory) AS n FROM (
    SELECT 'week' AS memory, media_id FROM media WHERE taken_at > 1705363199 - 604800 AND taken_at <= 1705363199
    UNION ALL SELECT CAST(year(make_timestamp(taken_at * 1000000)) AS VARCHAR), media_id FROM media WHERE taken_at_source = 'exif'
        AND strftime(make_timestamp(taken_at * 1000000), '%m-%d') = '01-15' AND year(make_timestamp(taken_at * 1000000)) < 2024)) WHERE n >= 3""", MEDIA)
def memories(spark, d):
    return events.memories(media(spark, d), "2024-01-15")


# vectors


@query(f"SELECT vec_id, {COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, vec_id LIMIT 60")
def vector_top_k(spark, d):
    out = vectors.top_k(embeddings(spark, d), query_vector(spark, d, 7), 60, id_col="vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, score FROM (SELECT vec_id, {COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE vec_id <> 11 ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.1")
def similar_items(spark, d):
    return vectors.similar_to(embeddings(spark, d), 11, 20, 0.1, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


PROMPTS = """means AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos),
    norms AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-12) AS s FROM means GROUP BY label),
    prompts AS (SELECT label, list(x / s ORDER BY pos) AS vector FROM means JOIN norms USING (label) GROUP BY label)"""


def prompts(spark, d) -> DataFrame:
    e = embeddings(spark, d)
    raw = e.select(F.lit("category").alias("family"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("c"), "label").alias("label"), "embedding")
    return vectors.prompt_matrix(raw)


@query("SELECT 'c' || label AS label, pos, round(x / s, 6) AS x FROM means JOIN norms USING (label)", PROMPTS)
def prompt_matrix(spark, d):
    return prompts(spark, d).select("label", F.posexplode("vector").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


#: Two kinds of each category, and five attributes: single vectors.
UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
MORE_PROMPTS = f"""subs AS (SELECT 'c' || CAST(vec_id % 10 AS VARCHAR) AS parent, 's' || CAST(vec_id AS VARCHAR) AS label, {UNIT} AS vector FROM embeddings WHERE vec_id BETWEEN 20 AND 39),
    traits AS (SELECT 'a' || CAST(vec_id AS VARCHAR) AS label, {UNIT} AS vector FROM embeddings WHERE vec_id BETWEEN 40 AND 44)"""
CLASSES = """sims AS (SELECT e.vec_id AS media_id, 'c' || p.label AS label, list_dot_product(CAST(e.embedding AS DOUBLE[]), p.vector) AS c FROM embeddings e, prompts p),
    ps AS (SELECT *, exp(10 * c - max(10 * c) OVER (PARTITION BY media_id)) / sum(exp(10 * c)) OVER (PARTITION BY media_id) * exp(max(10 * c) OVER (PARTITION BY media_id)) AS p FROM sims),
    rk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY p DESC, label) AS r FROM ps)"""


@query("""SELECT media_id, (r - 1)::INT AS pos, CASE WHEN r > 1 OR p >= 0.16 THEN label ELSE '미분류' END AS label, round(p, 6) AS score, CASE r WHEN 1 THEN 'category' ELSE 'secondary' END AS kind
    FROM rk WHERE r = 1 OR (r <= 3 AND p >= 0.16 AND label <> 'c3')
    UNION ALL SELECT media_id, 100, label, round(p, 6), 'sub' FROM (SELECT media_id, label, exp(10 * c) / sum(exp(10 * c)) OVER w AS p, row_number() OVER (w ORDER BY c DESC, label) AS r FROM (
        SELECT rk.media_id, s.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), s.vector) AS c FROM rk JOIN subs s ON rk.label = s.parent JOIN embeddings e ON e.vec_id = rk.media_id WHERE rk.r = 1 AND rk.p >= 0.16)
        WINDOW w AS (PARTITION BY media_id)) WHERE r = 1 AND p >= 0.4
    UNION ALL SELECT e.vec_id, 200, t.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), t.vector), 6), 'attribute' FROM embeddings e, traits t
        WHERE list_dot_product(CAST(e.embedding AS DOUBLE[]), t.vector) >= CASE t.label WHEN 'a41' THEN 0.1 ELSE 0.24 END""", PROMPTS, MORE_PROMPTS, CLASSES)
def classification(spark, d):
    e = embeddings(spark, d).select(F.col("vec_id").alias("media_id"), "embedding")
    raw = embeddings(spark, d).where("vec_id BETWEEN 20 AND 44")
    kinds = raw.selectExpr("CASE WHEN vec_id < 40 THEN 'sub' ELSE 'attribute' END AS family", "CASE WHEN vec_id < 40 THEN 'c' || CAST(vec_id % 10 AS STRING) END AS parent", "CASE WHEN vec_id < 40 THEN 's' ELSE 'a' END || CAST(vec_id AS STRING) AS label", "embedding")
    every = prompts(spark, d).unionByName(vectors.prompt_matrix(kinds))
    out = vectors.classify(e, every, Params(logit_scale=10.0), primary_only=("c3",), thresholds={"a41": 0.1})
    return out.select("media_id", "pos", "label", F.round("score", 6).alias("score"), "kind")


FRAME_TAGS = """ft AS (SELECT event_id // 10 AS media_id, 5000 * (event_id % 10) AS time_ms, 0 AS pos, event_type AS label, round(value, 3) AS score FROM events
    UNION ALL SELECT event_id // 10, 5000 * (event_id % 10), 1, 'k' || CAST(event_id % 3 AS VARCHAR), 0.5 FROM events)"""


def frame_tags(spark, d) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    first = ev.selectExpr("event_id div 10 AS media_id", "5000 * (event_id % 10) AS time_ms", "0 AS pos", "event_type AS label", "round(value, 3) AS score")
    return first.unionByName(ev.selectExpr("event_id div 10 AS media_id", "5000 * (event_id % 10) AS time_ms", "1 AS pos", "'k' || CAST(event_id % 3 AS STRING) AS label", "CAST(0.5 AS DOUBLE) AS score"))


@query("""SELECT media_id, place::INT AS place, label, votes, score FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY votes DESC, score DESC, label) AS place FROM (
    SELECT *, bool_or(kept AND firsts > 0) OVER (PARTITION BY media_id) AS led, row_number() OVER (PARTITION BY media_id ORDER BY (firsts > 0) DESC, label = '미분류', firsts DESC, score DESC, label) AS lead FROM (
    SELECT media_id, label, count(DISTINCT time_ms) AS votes, max(score) AS score, count(*) FILTER (pos = 0) AS firsts,
        count(DISTINCT time_ms) >= greatest(1, ceil(CAST(0.4 AS DOUBLE) * any_value(n))) AND label <> '미분류' AS kept
    FROM ft JOIN (SELECT media_id, count(DISTINCT time_ms) AS n FROM ft GROUP BY media_id) USING (media_id) GROUP BY media_id, label))
    WHERE kept OR (NOT led AND lead = 1 AND firsts > 0)) WHERE place <= 5""", FRAME_TAGS)
def frame_vote(spark, d):
    return vectors.vote(frame_tags(spark, d))


@query("SELECT owner, least(greatest(count(*) FILTER (best - blur_score <= 5), 1), 60)::INT AS close FROM (SELECT owner, blur_score, max(blur_score) OVER (PARTITION BY owner) AS best FROM media WHERE blur_score IS NOT NULL) GROUP BY owner", MEDIA)
def relevance_cut(spark, d):
    return vectors.relevant(media(spark, d).where("blur_score IS NOT NULL").select("owner", F.col("blur_score").alias("score")), 5.0, 60, by=("owner",))


#: The best frame of each video, the best that is a gap away from it, and the best that is away from both.
FIRST = "one AS (SELECT media_id, time_ms AS t1, raw FROM hits WHERE r = 1)"
SECOND = "two AS (SELECT media_id, arg_min(time_ms, r) AS t2 FROM hits JOIN one USING (media_id) WHERE abs(time_ms - t1) >= 10000 GROUP BY media_id)"
THIRD = "three AS (SELECT media_id, arg_min(time_ms, r) AS t3 FROM hits JOIN one USING (media_id) JOIN two USING (media_id) WHERE abs(time_ms - t1) >= 10000 AND abs(time_ms - t2) >= 10000 GROUP BY media_id)"
LABEL_HITS = """hits AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY raw DESC, time_ms) AS r FROM (SELECT CAST(f.label AS BIGINT) AS media_id, 5000 * (row_number() OVER (PARTITION BY f.label ORDER BY f.vec_id) - 1) AS time_ms,
    list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw FROM embeddings f, (SELECT embedding FROM embeddings WHERE vec_id = 3) q))"""


@query("SELECT media_id, concat_ws(',', t1, t2, t3) AS scenes FROM one LEFT JOIN two USING (media_id) LEFT JOIN three USING (media_id)", LABEL_HITS, FIRST, SECOND, THIRD)
def video_scenes(spark, d):
    """Spaced scenes of each video."""
    e = embeddings(spark, d).withColumn("time_ms", 5000 * (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)).withColumn("media_id", F.col("label").cast("bigint"))
    out = vectors.spaced_scenes(vectors.scored(e, query_vector(spark, d, 3)).select("media_id", "time_ms", "score"))
    return out.select("media_id", F.array_join(F.transform("scenes", lambda x: x["time_ms"].cast("string")), ",").alias("scenes"))


@query("""SELECT media_id, pos::BIGINT AS pos, CASE WHEN n = 1 THEN dur // 2 ELSE (dur - 1) * pos // (n - 1) END AS at_ms FROM (
    SELECT media_id, dur, n, unnest(range(n)) AS pos FROM (SELECT event_id AS media_id, event_id * 997 % 700000 AS dur, least(greatest(event_id * 997 % 700000 // 5000 + 1, 1), 96) AS n FROM events) WHERE dur > 0)""")
def frame_positions(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS media_id", "event_id * 997 % 700000 AS dur")
    out = ev.select("media_id", F.posexplode(S.frame_positions(F.col("dur"))).alias("pos", "at_ms"))
    return out.select("media_id", F.col("pos").cast("bigint").alias("pos"), "at_ms")


@query(f"""SELECT section, media_id, pos, score FROM (SELECT CASE WHEN best - raw <= 0.05 AND pos < 60 THEN 'close' ELSE 'other' END AS section, media_id, pos::INT AS pos, round(raw, 6) AS score FROM (
    SELECT *, max(raw) OVER () AS best, row_number() OVER (ORDER BY raw DESC, media_id) - 1 AS pos FROM (
    SELECT m.media_id, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw FROM vec m, (SELECT embedding FROM embeddings WHERE vec_id = 5) q
    WHERE is_accessible AND state >= 1 AND media_kind = 'photo' AND taken_at BETWEEN 1704067200 AND 1706745599 ORDER BY raw DESC, media_id LIMIT 120)))""", MEDIA, VECTOR_SQL)
def hybrid_search(spark, d):
    import datetime

    asked = parser.parse("2024년 1월 사진 바다", datetime.date(2026, 9, 28))
    out = search.search(asked, with_vectors(spark, d), tags(spark, d), None, query_vector(spark, d, 5))
    return out.select("section", "media_id", "pos", F.round("score", 6).alias("score"))


# places

PLACE_SQL = "places AS (SELECT n_nationkey AS ordinal, n_name AS name, 33 + CAST(n_nationkey AS DOUBLE) * 7 % 50 / 10 AS lat, 126 + CAST(n_nationkey AS DOUBLE) * 11 % 40 / 10 AS lon, 30 + CAST(n_nationkey AS DOUBLE) AS radius_km FROM nation)"
KM = HAVERSINE.format(a="m.gps_lat", b="m.gps_lon", c="p.lat", d="p.lon")


def places(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.selectExpr("n_nationkey AS ordinal", "n_name AS name", "array(lower(n_name)) AS aliases", "33 + CAST(n_nationkey AS DOUBLE) * 7 % 50 / 10 AS lat", "126 + CAST(n_nationkey AS DOUBLE) * 11 % 40 / 10 AS lon", "30 + CAST(n_nationkey AS DOUBLE) AS radius_km")


@query(f"SELECT m.media_id, p.name, round({KM}, 4) AS km FROM media m, places p WHERE {KM} <= p.radius_km", MEDIA, PLACE_SQL)
def places_within(spark, d):
    return geo.within(filters.located(media(spark, d)).select("media_id", "gps_lat", "gps_lon"), places(spark, d)).select("media_id", "name", F.round("km", 4).alias("km"))


@query(f"SELECT media_id, name AS place_name FROM (SELECT m.media_id, p.name, row_number() OVER (PARTITION BY m.media_id ORDER BY round({KM}, 9), ordinal) AS r FROM media m, places p WHERE {KM} <= p.radius_km) WHERE r = 1", MEDIA, PLACE_SQL)
def nearest_place(spark, d):
    return geo.nearest(filters.located(media(spark, d)).select("media_id", "gps_lat", "gps_lon"), places(spark, d))


@query("""SELECT cx, cy, count(*) AS n, round(avg(gps_lat), 6) AS lat, round(avg(gps_lon), 6) AS lon, max(gps_lat) - min(gps_lat) < 1e-4 AND max(gps_lon) - min(gps_lon) < 1e-4 AS at_one_place FROM (
    SELECT *, floor((gps_lon + 180) / 360 * 65536 / 100)::BIGINT AS cx, floor((0.5 - ln((1 + sin(radians(gps_lat))) / (1 - sin(radians(gps_lat)))) / (4 * pi())) * 65536 / 100)::BIGINT AS cy FROM media WHERE gps_lat IS NOT NULL) GROUP BY cx, cy""", MEDIA)
def map_clusters(spark, d):
    out = geo.clusters(filters.located(media(spark, d)), 65536.0, 100.0)
    return out.select("cx", "cy", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "at_one_place")


@query("SELECT lower(n_name) AS word, n_name AS name FROM nation")
def find_place(spark, d):
    p = places(spark, d)
    return geo.find_place(p, p.select(F.lower("name").alias("word")))


# rules, albums, evaluation

RULES = (rules.Provenance("메신저저장", packages=("com.example.chat",)), rules.Provenance("스크린샷", paths=("screenshots",)))


@query("""SELECT media_id, label, 'rule' AS source FROM (
    SELECT media_id, CASE WHEN coalesce(owner_pkg, '') LIKE 'com.example.chat%' THEN '메신저저장' WHEN lower(rel_path) LIKE '%screenshots%' THEN '스크린샷' WHEN camera_model IS NOT NULL THEN '카메라촬영'
        WHEN abs(greatest(width, height)::DOUBLE / least(width, height) - 1.5) / 1.5 <= 0.02 AND width IS NOT NULL THEN '스크린샷' WHEN lower(rel_path) LIKE '%download%' THEN '다운로드' ELSE '저장/다운로드' END AS label FROM media
    UNION ALL SELECT media_id, '야간' FROM media WHERE taken_at_source = 'exif' AND (hour(make_timestamp(taken_at * 1000000)) >= 20 OR hour(make_timestamp(taken_at * 1000000)) < 6)
    UNION ALL SELECT media_id, '위치있음' FROM media WHERE gps_lat IS NOT NULL)""", MEDIA)
def rule_tags(spark, d):
    return rules.rule_tags(media(spark, d), RULES, (1.5,), 0.02).select("media_id", "label", "source")


@query("""SELECT kind, key, count(*) AS n, count(*) FILTER (video) AS videos FROM (
    SELECT 'folder' AS kind, bucket AS key, media_kind = 'video' AS video FROM media WHERE is_accessible
    UNION ALL SELECT 'tag', label, media_kind = 'video' FROM media JOIN (SELECT DISTINCT media_id, label FROM tags WHERE label <> 'k0') USING (media_id) WHERE is_accessible
    UNION ALL SELECT 'user', 'favorites', media_kind = 'video' FROM media WHERE is_accessible AND media_id % 31 = 0
    UNION ALL SELECT 'user', CAST(l_orderkey AS VARCHAR), media_kind = 'video' FROM media JOIN lineitem ON media_id = l_partkey WHERE is_accessible) GROUP BY kind, key
    UNION ALL SELECT kind, key, n, videos FROM (SELECT 'event' AS kind, CAST(l_suppkey AS VARCHAR) AS key, count(*) AS n, count(*) FILTER (media_kind = 'video') AS videos
        FROM media JOIN lineitem ON media_id = l_partkey WHERE is_accessible GROUP BY l_suppkey ORDER BY max(taken_at) DESC NULLS LAST, key LIMIT 60)
    UNION ALL SELECT 'user', CAST(o_orderkey AS VARCHAR), 0, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN media ON media_id = l_partkey WHERE is_accessible)""", MEDIA, TAGS)
def album_list(spark, d):
    m = media(spark, d)
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(0).cast("bigint").alias("created_at"))
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("media_id"))
    shot = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("event_id"), F.col("l_partkey").alias("media_id"), F.lit("").alias("title"))
    out = albums.albums(m, tags(spark, d), m.where("media_id % 31 = 0").select("media_id"), orders, items, shot, hidden=("k0",))
    return out.select("kind", "key", "n", "videos")


PAIRS = "pairs AS (SELECT event_id AS item_id, event_type AS truth, CASE event_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN '미분류' ELSE event_type END AS p FROM events)"


def eval_pairs(spark, d) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.selectExpr("event_id AS item_id", "event_type AS truth", "array(CASE event_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN '미분류' ELSE event_type END) AS predicted")


@query("""SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
    SELECT l.label, count(*) FILTER (truth = l.label AND p = l.label) AS tp, count(*) FILTER (truth <> l.label AND p = l.label) AS fp, count(*) FILTER (truth = l.label AND p <> l.label) AS fn
    FROM pairs, (SELECT DISTINCT truth AS label FROM pairs) l GROUP BY l.label)""", PAIRS)
def label_metrics(spark, d):
    out = evaluate.per_label(eval_pairs(spark, d))
    return out.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT round(avg((p = truth)::INT), 6) AS accuracy, round(avg((p <> '미분류')::INT), 6) AS coverage, 1.0::DOUBLE AS mean_tags FROM pairs", PAIRS)
def overall_metrics(spark, d):
    return evaluate.overall(eval_pairs(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"), "mean_tags")


@query("""SELECT truth, count(*) FILTER (p = 'click') AS click, count(*) FILTER (p = 'view') AS view, count(*) FILTER (p = 'signup') AS signup, count(*) FILTER (p = 'error') AS error, count(*) FILTER (p = 'purchase') AS purchase, count(*) FILTER (p = '미분류') AS unclassified FROM pairs GROUP BY truth""", PAIRS)
def confusion_matrix(spark, d):
    return evaluate.confusion(eval_pairs(spark, d), ["click", "view", "signup", "error", "purchase"]).withColumnRenamed("미분류", "unclassified")


@query("""SELECT owner AS query, round(count(*) FILTER (right_) / 10.0, 6) AS p FROM (SELECT owner, bucket = 'view' AS right_, row_number() OVER (PARTITION BY owner ORDER BY blur_score DESC, media_id) AS r FROM media WHERE blur_score IS NOT NULL) WHERE r <= 10 GROUP BY owner""", MEDIA)
def precision_at_10(spark, d):
    m = media(spark, d).where("blur_score IS NOT NULL")
    return evaluate.precision_at(m.select(F.col("owner").alias("query"), "media_id", F.col("blur_score").alias("score"), (F.col("bucket") == "view").alias("right")), 10).select("query", F.round("p", 6).alias("p"))


# state and backups


@query("""SELECT coalesce(s.media_id, k.media_id) AS media_id, CASE WHEN k.media_id IS NULL THEN 'new' WHEN s.media_id IS NULL THEN 'gone' WHEN s.generation <> k.generation THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT media_id, generation FROM media WHERE media_id % 7 <> 0) s FULL JOIN (SELECT media_id, CASE WHEN media_id % 5 = 0 THEN generation + 1 ELSE generation END AS generation FROM media WHERE media_id % 9 <> 0) k ON s.media_id = k.media_id""", MEDIA)
def catalogue_changes(spark, d):
    m = media(spark, d)
    known = m.where("media_id % 9 <> 0").selectExpr("media_id", "CASE WHEN media_id % 5 = 0 THEN generation + 1 ELSE generation END AS generation")
    return state.changes(m.where("media_id % 7 <> 0"), known)


@query("""SELECT media_id, bytes, state, coalesce(date_added, -1) AS date_added FROM (
    SELECT coalesce(f.media_id, m.media_id) AS media_id, coalesce(f.bytes, m.bytes) AS bytes, coalesce(m.state, 0) AS state, coalesce(f.date_added, m.date_added) AS date_added
    FROM (SELECT * FROM media WHERE media_id % 4 <> 1) m FULL JOIN (SELECT media_id, bytes + 1 AS bytes, CASE WHEN media_id % 2 = 0 THEN 5 END AS date_added FROM media WHERE media_id % 3 = 0) f ON m.media_id = f.media_id)""", MEDIA)
def discovered(spark, d):
    m = media(spark, d)
    found = m.where("media_id % 3 = 0").selectExpr("media_id", "bytes + 1 AS bytes", "CAST(CASE WHEN media_id % 2 = 0 THEN 5 END AS BIGINT) AS date_added")
    return state.with_discovered(m.where("media_id % 4 <> 1"), found).select("media_id", "bytes", "state", F.coalesce("date_added", F.lit(-1)).alias("date_added"))


@query("""SELECT media_id, CASE WHEN bad OR (other AND fail_count + 1 >= 3) THEN 3 ELSE state END AS state, fail_count + CASE WHEN other THEN 1 ELSE 0 END AS fail_count
    FROM (SELECT *, media_id % 10 = 0 AS bad, media_id % 10 = 1 AS other FROM media)""", MEDIA)
def failure_counts(spark, d):
    m = media(spark, d)
    failures = m.where("media_id % 10 <= 2").selectExpr("media_id", "CASE media_id % 10 WHEN 0 THEN 'undecodable' WHEN 1 THEN 'io' ELSE 'encoder' END AS class")
    return state.after_failures(m, failures).select("media_id", "state", "fail_count")


@query("SELECT media_id, CASE WHEN state = 2 AND model_id <> 'new' THEN 1 ELSE state END AS state FROM media", MEDIA)
def model_change(spark, d):
    m = media(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return state.after_model_change(m, "new")[0].select("media_id", "state")


@query("""SELECT media_id, label, source FROM tags WHERE NOT (media_id % 4 = 0 AND label = 'click') AND NOT (media_id % 4 = 1 AND label = 'mine')
    UNION ALL SELECT media_id, 'mine', 'user' FROM media WHERE media_id % 4 = 1""", MEDIA, TAGS)
def user_feedback(spark, d):
    m = media(spark, d)
    verdicts = m.where("media_id % 4 = 0").selectExpr("media_id", "'click' AS label", "0 AS verdict", "2 AS ts").unionByName(m.where("media_id % 4 = 0").selectExpr("media_id", "'click' AS label", "1 AS verdict", "1 AS ts")).unionByName(m.where("media_id % 4 = 1").selectExpr("media_id", "'mine' AS label", "1 AS verdict", "1 AS ts"))
    return state.with_feedback(tags(spark, d).withColumn("score", F.lit(None).cast("float")), verdicts).select("media_id", "label", "source")


@query("""SELECT ref, CASE WHEN n = 1 THEN any_id WHEN np = 1 THEN same END AS media_id FROM (
    SELECT r.media_id AS ref, count(*) AS n, min(m.media_id) AS any_id, count(*) FILTER (r.rel_path = m.rel_path) AS np, min(m.media_id) FILTER (r.rel_path = m.rel_path) AS same
    FROM (SELECT * FROM media WHERE media_id % 5 = 2) r JOIN media m ON r.display_name = m.display_name AND r.bucket = m.bucket AND m.is_accessible GROUP BY r.media_id) WHERE n = 1 OR np = 1""",
    MEDIA)
def backup_links(spark, d):
    m = media(spark, d).withColumn("bytes", F.crc32(F.col("bucket").cast("binary"))).withColumn("taken_at", F.lit(None).cast("bigint"))
    refs = m.where("media_id % 5 = 2").select(F.col("media_id").alias("ref"), F.col("display_name").alias("name"), "bytes", F.col("taken_at").alias("taken"), F.col("rel_path").alias("path"))
    return backup.resolved(refs, m)


@query("""SELECT ref, CASE WHEN n = 1 THEN any_id WHEN np = 1 THEN same END AS media_id FROM (
    SELECT r.media_id AS ref, count(*) AS n, min(m.media_id) AS any_id, count(*) FILTER (r.rel_path = m.rel_path) AS np, min(m.media_id) FILTER (r.rel_path = m.rel_path) AS same
    FROM media r JOIN media m ON r.display_name = m.display_name AND r.bytes = m.bytes AND r.taken_at IS NOT DISTINCT FROM m.taken_at AND m.is_accessible GROUP BY r.media_id) WHERE n = 1 OR np = 1
    UNION ALL SELECT -1 - ref, CASE WHEN n = 1 THEN any_id WHEN np = 1 THEN same END FROM (
    SELECT r.media_id AS ref, count(*) AS n, min(m.media_id) AS any_id, count(*) FILTER (r.rel_path = m.rel_path) AS np, min(m.media_id) FILTER (r.rel_path = m.rel_path) AS same
    FROM media r JOIN media m ON r.display_name = m.display_name AND r.bucket = m.bucket AND m.is_accessible GROUP BY r.media_id) WHERE n = 1 OR np = 1""", MEDIA)
def backup_links_of_all(spark, d):
    """References to every row of media: by name, bytes and time, and as -1 - ref by name and bucket, which several share."""
    m = media(spark, d)
    alike = m.withColumn("bytes", F.crc32(F.col("bucket").cast("binary"))).withColumn("taken_at", F.lit(None).cast("bigint"))
    refs = lambda rows: rows.select(F.col("media_id").alias("ref"), F.col("display_name").alias("name"), "bytes", F.col("taken_at").alias("taken"), F.col("rel_path").alias("path"))
    return backup.resolved(refs(m), m).unionByName(backup.resolved(refs(alike), alike).withColumn("ref", -1 - F.col("ref")))


@query("SELECT source AS name, lang, n_chars AS bytes, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def shared_content(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("name"), "lang", F.col("n_chars").alias("bytes"), S.content_hash(F.col("text")).alias("sha256"))
    several = docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256")
    return docs.join(several, "sha256", "left_semi").select("name", "lang", "bytes", "sha256")


@query("SELECT DISTINCT url AS path FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def not_queued(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").withColumnRenamed("url", "path")
    return sources.not_queued(p.where("page_id % 3 <> 0"), p.where("page_id % 2 = 0"))


@query("SELECT conv_id, turn, turn * 997 // 60 || ':' || lpad(CAST(turn * 997 % 60 AS VARCHAR), 2, '0') AS at FROM conversations WHERE turn * 997 < 3600 UNION ALL SELECT conv_id, turn, turn * 997 // 3600 || ':' || lpad(CAST(turn * 997 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn * 997 % 60 AS VARCHAR), 2, '0') FROM conversations WHERE turn * 997 >= 3600")
def clock_text(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", S.clock(F.col("turn") * 997_000).alias("at"))


@query("""SELECT vec_id, round(q / 36 - (s / 36) * (s / 36), 6) AS sharpness FROM (SELECT vec_id, sum(v) AS s, sum(v * v) AS q FROM (
    SELECT vec_id, CAST(e[i] AS DOUBLE) + CAST(e[i + 2] AS DOUBLE) + CAST(e[i - 7] AS DOUBLE) + CAST(e[i + 9] AS DOUBLE) - 4 * CAST(e[i + 1] AS DOUBLE) AS v
    FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings) WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6) GROUP BY vec_id)""")
def sharpness(spark, d):
    return embeddings(spark, d).select("vec_id", F.round(S.laplacian_variance(F.col("embedding"), 8, 8), 6).alias("sharpness"))


# more of sources, state and lists


@query("""SELECT 'EXACT:' || least AS key, CASE WHEN n > 1 THEN media_id END AS media_id, coalesce(keep = media_id, is_best) AS is_best FROM (
    SELECT e.*, least, n, max(CASE WHEN r.media_id = least + 3000 THEN least + 3000 END) OVER (PARTITION BY sha256) AS keep FROM exact e JOIN ranked r USING (media_id))""", MEDIA, EXACT)
def chosen_best(spark, d):
    groups = grouping.exact_groups(media(spark, d))
    choices = groups.select(F.col("key").alias("group_key"), (F.regexp_extract("key", r"\d+", 0).cast("bigint") + 3000).alias("keep_id"), F.lit(False).alias("dismissed")).distinct()
    return grouping.with_choices(groups, choices).select("key", "media_id", "is_best")


@query("""SELECT key, media_id, media_id = coalesce(best, low) AS is_best FROM (
    SELECT key, media_id, count(*) OVER w AS n, min(media_id) FILTER (is_best) OVER w AS best, min(media_id) OVER w AS low
    FROM exact JOIN (SELECT media_id FROM media WHERE is_accessible) USING (media_id) WINDOW w AS (PARTITION BY key)) WHERE n > 1""", MEDIA, EXACT)
def readable_groups(spark, d):
    m = media(spark, d)
    return grouping.readable(grouping.exact_groups(m), m.where("is_accessible")).select("key", "media_id", "is_best")


@query("""SELECT section, media_id, detail FROM (SELECT 'low quality' AS section, media_id, CAST(bytes AS VARCHAR) AS detail FROM media WHERE brightness < 5 OR brightness > 252 OR (width IS NOT NULL AND greatest(width, height) < 600) ORDER BY bytes DESC, media_id LIMIT 500)
    UNION ALL SELECT 'copies', media_id, key FROM exact UNION ALL SELECT 'reclaimable', -1, CAST(coalesce(sum(bytes), 0)::BIGINT AS VARCHAR) FROM exact WHERE NOT is_best""", MEDIA, EXACT)
def cleanup_report(spark, d):
    from .operators import cleanup

    m = media(spark, d)
    return cleanup.report(m, grouping.exact_groups(m), 0.0, 5.0, 252.0, 600).withColumn("media_id", F.coalesce("media_id", F.lit(-1)))


@query("""SELECT event_id, count(*) AS n, count(*) FILTER (media_kind = 'video') AS videos FROM (SELECT o_orderkey AS event_id, l_partkey AS media_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    JOIN media USING (media_id) WHERE is_accessible GROUP BY event_id""", MEDIA)
def event_listing(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("media_id"))
    known = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id"))
    return events.event_counts(items.join(known, "event_id", "left_semi"), media(spark, d))


@query("""SELECT owner, event_no::BIGINT AS event_no, strftime(make_timestamp(min(taken_at) * 1000000), '%Y-%m-%d %H:%M') || ' – ' || strftime(make_timestamp(max(taken_at) * 1000000), '%Y-%m-%d %H:%M') AS span
    FROM sess GROUP BY owner, event_no""", MEDIA, SESSIONS)
def timeline(spark, d):
    return events.timeline(events.rollup(events.sessions(media(spark, d), 3.0, 400.0, by=("owner",)), by=("owner",))).select("owner", "event_no", "span")


@query("SELECT media_id, coalesce(date_added, taken_at, -1) AS date_added FROM media", MEDIA)
def filled_dates(spark, d):
    m = media(spark, d)
    return state.filled(m, m.select("media_id", F.col("taken_at").alias("value")), "date_added").select("media_id", F.coalesce("date_added", F.lit(-1)).alias("date_added"))


@query("SELECT media_id, bucket = 'view' AS is_accessible FROM media", MEDIA)
def partial_access(spark, d):
    m = media(spark, d)
    return state.with_access(m, m.where("bucket = 'view'"), "partial").select("media_id", "is_accessible")


@query("SELECT media_id, CASE WHEN bucket = 'click' THEN 0 ELSE state END AS state, CASE WHEN bucket = 'click' THEN NULL ELSE sha256 END AS sha256 FROM media", MEDIA)
def invalidated(spark, d):
    m = media(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return state.invalidated(m, m.where("bucket = 'click'")).select("media_id", "state", "sha256")


@query("SELECT media_id, label, source FROM tags WHERE media_id NOT IN (SELECT media_id FROM media WHERE bucket = 'error')", MEDIA, TAGS)
def tags_after_deletion(spark, d):
    return state.without({"tags": tags(spark, d)}, media(spark, d).where("bucket = 'error'"))["tags"]


@query("""SELECT media_id, label, source FROM tags WHERE source <> 'rule' OR media_id % 2 = 1
    UNION ALL SELECT media_id, 'fresh', 'rule' FROM media WHERE media_id % 2 = 0 AND media_kind = 'photo'
    UNION ALL SELECT media_id, label, source FROM tags WHERE source = 'rule' AND media_id % 10 = 0""", MEDIA, TAGS)
def replaced_tags(spark, d):
    m = media(spark, d)
    new = m.where("media_id % 2 = 0").selectExpr("media_id", "'fresh' AS label", "CAST(NULL AS FLOAT) AS score").where("media_id % 10 <> 0")
    removed = m.limit(0).selectExpr("media_id", "'' AS label", "0 AS verdict", "0 AS ts")
    return state.with_tags(tags(spark, d).withColumn("score", F.lit(None).cast("float")), new, "rule", removed).select("media_id", "label", "source")


@query("SELECT media_id, CASE WHEN state = 2 AND media_kind = 'video' THEN 1 ELSE state END AS state FROM media", MEDIA)
def requeued_videos(spark, d):
    return state.requeued(media(spark, d).withColumn("embedding", F.lit(None).cast("array<float>")), videos_only=True).select("media_id", "state")


@query("SELECT media_id, CASE WHEN taken_at_source = 'mtime' THEN 7 ELSE coalesce(taken_at, -1) END AS taken_at, 'exif' AS taken_at_source FROM media", MEDIA)
def capture_times(spark, d):
    m = media(spark, d)
    out = state.with_capture_times(m, m.select("media_id", F.lit(7).cast("bigint").alias("taken_at")))
    return out.select("media_id", F.coalesce("taken_at", F.lit(-1)).alias("taken_at"), "taken_at_source")


@query("""SELECT row_number() OVER (ORDER BY part, a, b, media_id) - 1 AS ref, media_id FROM (SELECT media_id, part, a, b, row_number() OVER (PARTITION BY media_id ORDER BY part, a, b) AS r FROM (
    SELECT media_id, 0 AS part, 0 AS a, bytes AS b FROM media WHERE bucket = 'purchase' UNION ALL SELECT l_partkey, 1, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT media_id, 2, 0, bytes FROM media WHERE bucket = 'signup'))
    JOIN media USING (media_id) WHERE r = 1""", MEDIA)
def backup_references(spark, d):
    m = media(spark, d)
    items = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS album_id", "l_partkey AS media_id", "CAST(l_linenumber AS BIGINT) AS added_at")
    mark = lambda b: m.where(F.col("bucket") == b).select("media_id", F.col("bytes").alias("ts"))
    return backup.references(mark("purchase"), items, mark("signup"), m).select("ref", "media_id")


@query("""SELECT lang AS category, source AS title, tier, place::INT AS place FROM (SELECT lang, source, min(t) AS tier, row_number() OVER (PARTITION BY lang ORDER BY min(t), source) AS place FROM (
    SELECT *, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS t FROM documents WHERE source NOT LIKE '%7%') GROUP BY lang, source) WHERE place <= 5""")
def evaluation_set(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("lang AS category", "source AS title", "CASE doc_id % 4 WHEN 0 THEN 'CC0' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'CC BY-SA 3.0' ELSE 'other' END AS licence")
    return sources.evaluation_set(docs, ("7",), 5)


@query("SELECT n_name AS name, 33 + n_nationkey AS lat, 126.5 AS lon, n_regionkey * 10.0 AS radius_km FROM nation WHERE n_nationkey <> 3")
def parsed_places(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    lines = n.selectExpr("n_nationkey AS line", "CASE WHEN n_nationkey = 3 THEN '# ' ELSE '' END || n_name || '\\ta|b\\t' || CAST(33 + n_nationkey AS STRING) || '\\t126.5\\t' || CAST(n_regionkey * 10 AS STRING) AS value")
    return sources.parse_places(lines).select("name", "lat", "lon", "radius_km")


@query("""SELECT section, count(*) AS n FROM (SELECT CASE WHEN m.media_id IN (SELECT media_id FROM tags WHERE label = 'view') THEN 'close' ELSE 'other' END AS section
    FROM vec m WHERE is_accessible AND state >= 1 AND media_kind = 'photo') GROUP BY section""", MEDIA, VECTOR_SQL, TAGS)
def tag_search(spark, d):
    q = parser.Query(text="바다", tags=["view"], media="image")
    p = Params(close_limit=1 << 30, other_limit=1 << 30)
    v = query_vector(spark, d, 5)
    out = search.search(q, with_vectors(spark, d), tags(spark, d), None, v, tag_vector=v, params=p)
    return out.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT section, media_id, (row_number() OVER (PARTITION BY section ORDER BY raw DESC, media_id) - 1)::INT AS pos, round(raw, 6) AS score FROM (
    SELECT CASE WHEN m.media_id IN (SELECT media_id FROM tags WHERE label = 'view') THEN 'close' ELSE 'other' END AS section, m.media_id, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw
    FROM vec m, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE is_accessible AND state >= 1 AND media_kind = 'photo')""", MEDIA, VECTOR_SQL, TAGS)
def tag_ranking(spark, d):
    """What tag_search counts, row by row."""
    asked = parser.Query(text="바다", tags=["view"], media="image")
    p = Params(close_limit=1 << 30, other_limit=1 << 30)
    v = query_vector(spark, d, 5)
    out = search.search(asked, with_vectors(spark, d), tags(spark, d), None, v, tag_vector=v, params=p)
    return out.select("section", "media_id", "pos", F.round("score", 6).alias("score"))


#: Eight frames of each video, four seconds apart, and their scores; r is a frame's place in its video.
HITS = """hits AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY raw DESC, time_ms) AS r FROM (
    SELECT f.vec_id // 8 * 5 AS media_id, f.vec_id % 8 * 4000 AS time_ms, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw FROM embeddings f, (SELECT embedding FROM embeddings WHERE vec_id = 5) q))"""


@query("""SELECT CASE WHEN pos < least(greatest(near, 1), 60) THEN 'close' ELSE 'other' END AS section, media_id, pos::INT AS pos, round(raw, 6) AS score, scenes FROM (
    SELECT *, count(*) FILTER (best - raw <= 0.05) OVER () AS near FROM (SELECT *, max(raw) OVER () AS best, row_number() OVER (ORDER BY raw DESC, media_id) - 1 AS pos FROM (
    SELECT m.media_id, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw, '' AS scenes
    FROM vec m, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE is_accessible AND state >= 1 AND media_kind = 'photo'
    UNION ALL SELECT media_id, raw, concat_ws(',', t1, t2, t3) FROM one LEFT JOIN two USING (media_id) LEFT JOIN three USING (media_id)
    WHERE media_id IN (SELECT media_id FROM vec WHERE is_accessible AND state >= 1 AND media_kind = 'video'))))""", MEDIA, VECTOR_SQL, HITS, FIRST, SECOND, THIRD)
def video_search(spark, d):
    """Photos and videos in one ranking: a video by its best frame, with its scenes."""
    frames = embeddings(spark, d).selectExpr("vec_id DIV 8 * 5 AS media_id", "vec_id % 8 * 4000 AS time_ms", "embedding")
    out = search.search(parser.Query(text="바다"), with_vectors(spark, d), tags(spark, d), frames, query_vector(spark, d, 5), params=Params(close_limit=1 << 30))
    scenes = F.coalesce(F.array_join(F.transform("scenes", lambda x: x["time_ms"].cast("string")), ","), F.lit(""))
    return out.select("section", "media_id", "pos", F.round("score", 6).alias("score"), scenes.alias("scenes"))


@query("""SELECT label, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * v[i])), 6) AS norm, round(v[1], 6) AS first FROM (
    SELECT p.label, list_transform(range(1, 65), lambda i: (p.vector[i] + 0.5 * q.vector[i]) / n.s) AS v FROM prompts p, (SELECT vector FROM prompts WHERE label = 0) q,
    (SELECT a.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.vector[i] + 0.5 * b.vector[i]) * (a.vector[i] + 0.5 * b.vector[i])))) AS s FROM prompts a, (SELECT vector FROM prompts WHERE label = 0) b) n WHERE n.label = p.label)""", PROMPTS)
def personal_prompts(spark, d):
    e = embeddings(spark, d)
    named = prompts(spark, d).select(F.regexp_replace("label", "c", "").cast("int").alias("label"), "vector")
    mine = e.where("label = 0").select("embedding")
    liked = named.select("label").join(mine)  # every label is given the pictures of label 0
    out = vectors.personalised(named, liked, 0.5, 5)
    return out.select("label", F.round(S.dot(F.col("vector"), F.col("vector")), 6).alias("norm"), F.round(F.col("vector")[0], 6).alias("first"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)
