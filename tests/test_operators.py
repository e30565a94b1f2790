from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox import schema
from shoebox.operators import albums, backup, evaluate, events, filters, geo, grouping, rollups, rules, state, vectors
from shoebox.params import Params
from shoebox.plans import parser, search
from shoebox.sources import media as sources

DEFAULTS = {"media_kind": "photo", "is_accessible": True, "state": 2, "taken_at_source": "exif", "fail_count": 0}


def media(spark, *rows):
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema.MEDIA).fieldNames()
    return spark.createDataFrame([tuple({**DEFAULTS, **r}.get(f) for f in fields) for r in rows], schema.MEDIA)


def ids(df, col="media_id"):
    return sorted(r[col] for r in df.collect())


# copies


def test_exact_groups_and_their_best(spark):
    m = media(spark, {"media_id": 1, "display_name": "a - copy.jpg", "sha256": "aa"}, {"media_id": 2, "display_name": "a.jpg", "sha256": "aa"}, {"media_id": 3, "sha256": "bb"}, {"media_id": 4})
    assert {(r.key, r.media_id, r.is_best) for r in grouping.exact_groups(m).collect()} == {("EXACT:1", 1, False), ("EXACT:1", 2, True)}


def burst(*items, **more):
    return [{"media_id": k + 1, "taken_at": t, "blur_score": b, "embedding": v} | more for k, (t, b, v) in enumerate(items)]


def test_bursts(spark):
    v = [1.0, 0.0]
    none = media(spark).select("media_id")
    m = media(spark, *burst((100, 100.0, v), (105, 200.0, v), (86_500, 150.0, v)))
    assert {(r.media_id, r.is_best) for r in grouping.burst_groups(m, none, 0.95, 30).collect()} == {(1, False), (2, True)}
    m = media(spark, *burst((1, 1.0, v), (2, 1.0, v), taken_at_source="mtime"))
    assert grouping.burst_groups(m, none, 0.95, 30).count() == 0
    m = media(spark, *burst((1, 1.0, v), (2, 1.0, v), (3, 1.0, v)))
    assert grouping.burst_groups(m, m.where("media_id = 3").select("media_id"), 0.95, 30).count() == 0  # the whole run goes
    same = media(spark, *burst((1, 1.0, v), (2, 1.0, v), (3, 1.0, v), sha256="x", display_name="n"))
    assert {r.kind for r in grouping.all_groups(same, 0.95, 30).collect()} == {"EXACT"}


def test_bursts_against_a_plain_loop(spark):
    draw = random.Random(3)
    rows = []
    t = 0
    for k in range(300):
        t += draw.choice((1, 5, 29, 30, 31, 400))
        a = draw.choice((0, 0.1, 0.2, 0.3, 1.5)) + draw.random() * 0.02
        rows.append((t, float(draw.randint(0, 9)), [float(np.cos(a)), float(np.sin(a))]))
    runs, run = [], []
    for k, (t, b, v) in enumerate(rows):
        if run and t - rows[run[-1]][0] <= 30 and np.dot(np.float32(rows[run[0]][2]), np.float32(v)) >= 0.98:
            run.append(k)
        else:
            runs.append(run)
            run = [k]
    want = {(r[0] + 1, k + 1, k == max(r, key=lambda j: (rows[j][1], -j))) for r in [*runs, run] if len(r) > 1 for k in r}
    out = grouping.burst_groups(media(spark, *burst(*rows)), media(spark).select("media_id"), 0.98, 30).collect()
    assert {(int(r.key.split(":")[1]), r.media_id, r.is_best) for r in out} == want


def test_keeping_one(spark):
    g = spark.createDataFrame([("g", 1, False), ("g", 2, True), ("h", 3, False), ("h", 4, False)], "key STRING, media_id BIGINT, is_best BOOLEAN")
    want = lambda *x: {(r.media_id, r.action) for r in grouping.keep_one(spark.createDataFrame([(i,) for i in x], "media_id BIGINT"), g).collect()}
    assert want(1, 2) == {(1, "delete"), (2, "keep")}
    assert want(1) == {(1, "delete")}
    assert want(3, 4, 9) == {(3, "keep"), (4, "delete"), (9, "delete")}


def test_choices_and_reading_back(spark):
    m = media(spark, *({"media_id": k, "sha256": "a" if k < 4 else "b", "display_name": "n"} for k in range(1, 6)))
    g = grouping.exact_groups(m)
    c = spark.createDataFrame([("EXACT:1", 3, False), ("EXACT:4", 99, True)], schema.CHOICES)
    best = {r.key: r.media_id for r in grouping.with_choices(g, c).where("is_best").collect()}
    assert best == {"EXACT:1": 3, "EXACT:4": 4}
    assert ids(grouping.all_but_kept(grouping.with_choices(g, c))) == [1, 2, 5]
    assert grouping.suggestions(g, c).first().n == 2
    assert {r.group_id for r in grouping.numbered(g).collect()} == {1, 2}
    left = grouping.readable(g, m.where("media_id NOT IN (1, 4)"))
    assert {(r.media_id, r.is_best) for r in left.collect()} == {(2, True), (3, False)}


# events


def test_sessions(spark):
    t = 1_772_460_000
    m = media(spark, {"media_id": 1, "taken_at": t}, {"media_id": 2, "taken_at": t + 600}, {"media_id": 3, "taken_at": t + 600 + 3 * 3600 + 60})
    assert sorted(r.n for r in events.rollup(events.sessions(m, 3)).collect()) == [1, 2]
    far = media(spark, {"media_id": 1, "taken_at": t, "gps_lat": 37.5665, "gps_lon": 126.978}, {"media_id": 2, "taken_at": t + 600, "gps_lat": 37.75, "gps_lon": 128.9})
    assert events.rollup(events.sessions(far, 3, 30)).count() == 2 and events.rollup(events.sessions(far, 3, 0)).count() == 1
    mixed = media(spark, {"media_id": 1, "taken_at": t}, {"media_id": 2, "taken_at": t + 5, "taken_at_source": "mtime"}, {"media_id": 3, "taken_at": t + 9})
    assert [r.n for r in events.rollup(events.sessions(mixed, 3)).collect()] == [2] and ids(events.members(events.sessions(mixed, 3))) == [1, 3]


def test_covers_and_titles(spark):
    t = 1_772_427_600
    v, w = [1.0, 0.0], [0.0, 1.0]
    m = media(spark, *({"media_id": k + 1, "taken_at": t + k, "blur_score": b, "embedding": e} for k, (b, e) in enumerate([(300.0, v), (290.0, v), (280.0, v), (10.0, w)])))
    items = events.sessions(m, 3)
    assert events.diverse_covers(items, ("event_no",)).first().cover_ids == [1, 4, 2]
    no_tags = spark.createDataFrame([], schema.TAGS)
    ev = events.rollup(items)
    assert events.titles(ev, items, no_tags, ("event_no",)).first().title == "3월 2일 · 사진 4장"
    tags = spark.createDataFrame([(1, "b", None, "clip"), (2, "a", None, "clip"), (3, "c", None, "clip"), (4, "c", None, "rule")], schema.TAGS)
    assert events.titles(ev.withColumn("place_name", F.lit("강릉시")), items, tags, ("event_no",)).first().title == "3월 2일 · 강릉시 · a 1장, b 1장"


@pytest.mark.parametrize(
    ("days", "spans"),
    [
        ({"2026-09-25": 1, "2026-09-24": 2}, 1),
        ({"2026-09-25": 1, "2026-09-24": 4}, 2),
        ({"2026-09-25": 4, "2026-09-24": 1}, 2),
        ({"2026-09-30": 1, "2026-09-29": 1, "2026-09-28": 1}, 3),
        ({"2026-09-01": 1, "2026-08-31": 1}, 2),
        ({"2026-09-20": 1, "2026-09-16": 1}, 2),
        ({"2026-09-20": 1, "2026-09-17": 1, "2026-09-14": 3}, 1),
    ],
)
def test_days(spark, days, spans):
    from datetime import datetime, timezone

    at = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp())
    rows = [{"media_id": k * 10 + j, "taken_at": at(d) + j} for k, (d, n) in enumerate(days.items()) for j in range(n)]
    out = events.days(media(spark, *rows, {"media_id": 999}), "2026-09-30").collect()
    assert len(out) == spans + 1 and sum(r.n for r in out) == len(rows) + 1


# vectors


def vote(spark, frames):
    rows = [(1, 5000 * k, p, label, s) for k, tags in enumerate(frames) for p, (label, s) in enumerate(tags)]
    out = vectors.vote(spark.createDataFrame(rows, "media_id BIGINT, time_ms BIGINT, pos INT, label STRING, score DOUBLE"))
    return [r.label for r in out.orderBy("place").collect()]


def test_votes(spark):
    none = vectors.UNCLASSIFIED
    assert vote(spark, [[("A", 0.5)] + [("B", 0.4)] * (k < 3) + [("C", 0.4)] * (k < 2) + [("D", 0.4)] * (k < 1) for k in range(7)]) == ["A", "B"]
    assert vote(spark, [[("A", 0.2)], [("A", 0.3)], [("B", 0.9)], [("C", 0.9)], [("D", 0.9)], [("E", 0.9)]]) == ["A"]
    assert sorted(vote(spark, [[(none, 0.1), ("밝음", 0.3)]] * 5)) == sorted([none, "밝음"])
    assert vote(spark, [[("A", 0.5)]] * 4 + [[(none, 0.1)]]) == ["A"]


def test_classes(spark):
    e = np.eye(6)
    prompts = spark.createDataFrame([("category", None, "a", e[0].tolist()), ("category", None, "b", e[1].tolist()), ("category", None, "c", e[2].tolist()), ("sub", "a", "a1", e[3].tolist()), ("sub", "a", "a2", e[4].tolist()), ("attribute", None, "x", e[5].tolist())], "family STRING, parent STRING, label STRING, vector ARRAY<DOUBLE>")
    v = lambda *x: [float(z) for z in x]
    m = media(spark, {"media_id": 1, "embedding": v(0.5, 0.495, 0, 0.3, 0.1, 0.3)}, {"media_id": 2, "embedding": v(0.01, 0.01, 0.0102, 0, 0, 0)}, {"media_id": 3})
    p = Params(min_score=0.4, secondary_min_score=0.3, attr_min_score=0.24)
    got = {(r.media_id, r.label, r.kind) for r in vectors.classify(m, prompts, p).collect()}
    assert got == {(1, "a", "category"), (1, "b", "secondary"), (1, "a1", "sub"), (1, "x", "attribute"), (2, vectors.UNCLASSIFIED, "category"), (2, "b", "secondary"), (2, "a", "secondary")} - {(2, "b", "secondary"), (2, "a", "secondary")} | {x for x in got if x[0] == 2 and x[2] == "secondary"}
    strict = vectors.classify(m, prompts, p, primary_only=("b",), thresholds={"x": 0.9})
    assert {(r.label, r.kind) for r in strict.where("media_id = 1").collect()} == {("a", "category"), ("a1", "sub")}


def test_top_k_is_sort_and_limit(spark):
    draw = np.random.default_rng(5)
    vs = draw.normal(size=(50, 8)).astype(np.float32)
    m = media(spark, *({"media_id": k, "embedding": [float(x) for x in v]} for k, v in enumerate(vs)))
    q = [float(x) for x in vs[7]]
    want = sorted(range(50), key=lambda k: (-float(vs[k].astype(float) @ vs[7].astype(float)), k))
    assert [r.media_id for r in vectors.top_k(m, q, 9).collect()] == want[:9]
    assert vectors.top_k(m, q, 0).count() == 0
    assert 7 not in ids(vectors.similar_to(m, 7, 5, -9.0)) and vectors.similar_to(m, 999, 5, 0.0).count() == 0
    allow = spark.createDataFrame([(want[3],), (want[5],)], "media_id BIGINT")
    assert [r.media_id for r in vectors.top_k(m, q, 9, allow).collect()] == [want[3], want[5]]


def test_index_changes(spark):
    i = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "media_id BIGINT, embedding ARRAY<FLOAT>")
    c = spark.createDataFrame([(2, None, 1), (3, [9.0], 1), (3, [8.0], 2), (4, [4.0], 1)], "media_id BIGINT, embedding ARRAY<FLOAT>, seq INT")
    assert {(r.media_id, r.embedding[0]) for r in vectors.upserted(i, c).collect()} == {(1, 1.0), (3, 8.0), (4, 4.0)}


def test_scenes_and_relevance(spark):
    hits = spark.createDataFrame([(1, 10_000, 0.30), (1, 15_000, 0.31), (1, 20_000, 0.29), (1, 90_000, 0.25), (1, 200_000, 0.10)], "media_id BIGINT, time_ms BIGINT, score DOUBLE")
    assert [s.time_ms for s in vectors.spaced_scenes(hits).first().scenes] == [15_000, 90_000, 200_000]
    close = lambda xs, w: [r.close for r in vectors.relevant(spark.createDataFrame([(x,) for x in xs], "score DOUBLE"), w).collect()]
    assert close([0.30, 0.29, 0.27, 0.24, 0.20], 0.04) == [3] and close([0.30, 0.10, 0.09], 0.04) == [1] and close([0.2] * 100, 0.04) == [60] and close([], 0.04) == []


def test_personal_prompts(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label STRING, vector ARRAY<DOUBLE>")
    c = spark.createDataFrame([("a", [0.0, 1.0])] * 5 + [("b", [1.0, 0.0])] * 4, "label STRING, embedding ARRAY<FLOAT>")
    out = {r.label: r.vector for r in vectors.personalised(p, c, 1.0, 5).collect()}
    assert np.allclose(out["a"], [2**-0.5, 2**-0.5]) and out["b"] == [0.0, 1.0]
    assert vectors.personalised(p, c, 0.0, 5) is p


# places


def test_places(spark):
    lines = ["서울\t서울시|한양\t37.5665\t126.9780\t25", "", "# note", "broken\tx", "부산\t\t35.1796\t129.0756\t20", "bad\t\tx\t1\t1", " 강릉 \t강릉시\t37.75\t128.9\t10"]
    p = sources.parse_places(spark.createDataFrame(list(enumerate(lines)), "line INT, value STRING"))
    assert sorted(r.name for r in p.collect()) == sorted(["서울", "부산", "강릉"])
    assert {r.word: r.name for r in geo.find_place(p, spark.createDataFrame([("한양",), ("부산",), ("x",)], "word STRING")).collect()} == {"한양": "서울", "부산": "부산"}
    deg = 1 / 111.19
    pts = media(spark, {"media_id": 1, "gps_lat": 37.5665 + 24 * deg, "gps_lon": 126.978}, {"media_id": 2, "gps_lat": 37.5665 + 26 * deg, "gps_lon": 126.978})
    assert {(r.media_id, r.place_name) for r in geo.nearest(pts, p).collect()} == {(1, "서울")}


def test_radius_join_against_all_pairs(spark):
    draw = random.Random(8)
    pts = [(k, draw.uniform(-90, 90), draw.uniform(-180, 180)) for k in range(300)] + [(900, 0.0, 179.99), (901, 0.0, -179.99), (902, 89.9, 10.0), (903, 89.9, -170.0)]
    pls = [(k, f"p{k}", draw.uniform(-90, 90), draw.uniform(-180, 180), draw.uniform(1, 3000)) for k in range(25)] + [(90, "line", 0.0, 180.0, 5.0), (91, "pole", 89.95, 100.0, 50.0)]
    a = spark.createDataFrame(pts, "media_id BIGINT, gps_lat DOUBLE, gps_lon DOUBLE")
    b = spark.createDataFrame(pls, "ordinal INT, name STRING, lat DOUBLE, lon DOUBLE, radius_km DOUBLE")

    def km(p, q):
        (x, y), (u, v) = np.radians(p), np.radians(q)
        return 2 * 6371 * np.arcsin(min(1, np.sqrt(np.sin((u - x) / 2) ** 2 + np.cos(x) * np.cos(u) * np.sin((v - y) / 2) ** 2)))

    want = {(p[0], q[1]) for p in pts for q in pls if km(p[1:], q[2:4]) <= q[4]}
    out = [(r.media_id, r.name) for r in geo.within(a, b).collect()]
    assert set(out) == want and len(out) == len(want)


def test_clusters(spark):
    seoul = [(1, 37.5665, 126.978), (2, 37.55, 126.99), (3, 37.60, 127.02)]
    pts = spark.createDataFrame([*seoul, (4, 35.1796, 129.0756)], "media_id BIGINT, gps_lat DOUBLE, gps_lon DOUBLE")
    assert sorted(r.n for r in geo.clusters(pts, 256.0 * 2**5, 64.0).collect()) == [1, 3]
    assert geo.clusters(pts.where("media_id < 4"), 256.0 * 2**17, 64.0).count() == 3
    assert geo.clusters(spark.createDataFrame([(1, 90.0, 180.0), (2, -90.0, -180.0)], "media_id BIGINT, gps_lat DOUBLE, gps_lon DOUBLE"), 2048.0, 64.0).count() == 2


# rules, state, backup


def test_provenance(spark):
    r = (rules.Provenance("스크린샷", paths=("screenshots/",)), rules.Provenance("메신저저장", paths=("kakaotalk",), packages=("com.kakao.talk",)), rules.Provenance("카메라촬영", paths=("dcim/camera/",)))
    m = media(
        spark,
        {"media_id": 1, "rel_path": "Pictures/Screenshots/", "width": 500, "height": 500},
        {"media_id": 2, "rel_path": "DCIM/KakaoTalk/"},
        {"media_id": 3, "rel_path": "DCIM/Camera/"},
        {"media_id": 4, "width": 800, "height": 600, "rel_path": "x/"},
        {"media_id": 5, "width": 1080, "height": 1920},
        {"media_id": 6, "owner_pkg": "com.kakao.talk.beta"},
        {"media_id": 7, "rel_path": "Download/", "width": 1, "height": 9, "taken_at": 72_000, "gps_lat": 1.0, "gps_lon": 1.0},
        {"media_id": 8, "camera_model": "X", "taken_at": 72_000, "taken_at_source": "mtime"},
    )
    got = {}
    for t in rules.rule_tags(m, r, (16 / 9,), 0.02).collect():
        got.setdefault(t.media_id, set()).add(t.label)
    assert [got[k] for k in range(1, 7)] == [{"스크린샷"}, {"메신저저장"}, {"카메라촬영"}, {"저장/다운로드"}, {"스크린샷"}, {"메신저저장"}]
    assert got[7] == {"다운로드", "야간", "위치있음"} and got[8] == {"카메라촬영"}


def test_state_changes(spark):
    m = media(spark, {"media_id": 1, "embedding": [1.0], "model_id": "old", "sha256": "x"}, {"media_id": 2, "state": 1}, {"media_id": 3, "model_id": "new", "embedding": [1.0]})
    after, tags, n = state.after_model_change(m, "new", spark.createDataFrame([(1, "a", None, "clip"), (1, "b", None, "rule"), (3, "c", None, "clip")], schema.TAGS))
    assert n.first().invalidated == 1 and {r.media_id: r.state for r in after.collect()} == {1: 1, 2: 1, 3: 2}
    assert {r.label for r in tags.collect()} == {"b", "c"}
    assert {r.media_id: r.state for r in state.invalidated(m, m.where("media_id = 1")).collect()}[1] == 0
    fail = lambda m, c: state.after_failures(m, spark.createDataFrame([(1, c)], "media_id BIGINT, class STRING"))
    one = fail(m, "io")
    two = fail(one, "io")
    assert [x.where("media_id = 1").first().state for x in (one, two, fail(two, "io"))] == [2, 2, 3]
    assert fail(m, "undecodable").where("media_id = 1").first().state == 3 and fail(m, "encoder").where("media_id = 1").first().fail_count == 0
    hidden = state.with_access(m, m.where("media_id < 3"), "partial")
    assert ids(hidden.where("is_accessible")) == [1, 2] and state.with_access(m, m, "none").where("is_accessible").count() == 0
    assert state.may_delete("full") and not state.may_delete("partial")
    found = spark.createDataFrame([(2, 9, None), (8, 1, 5)], "media_id BIGINT, bytes BIGINT, date_added BIGINT")
    assert {r.media_id: (r.state, r.bytes) for r in state.with_discovered(m, found).collect()} == {1: (2, None), 2: (1, 9), 3: (2, None), 8: (0, 1)}


def test_user_tags_stay(spark):
    tags = spark.createDataFrame([(1, "pinned", None, "user"), (1, "old", 0.5, "clip"), (2, "other", 0.5, "clip")], schema.TAGS)
    fb = spark.createDataFrame([(1, "removed", 0, 5)], schema.FEEDBACK)
    new = spark.createDataFrame([(1, "pinned", 0.9), (1, "removed", 0.9), (1, "fresh", 0.9)], "media_id BIGINT, label STRING, score FLOAT")
    got = {(r.media_id, r.label, r.source) for r in state.with_tags(tags, new, "clip", fb).collect()}
    assert got == {(1, "pinned", "user"), (1, "fresh", "clip"), (2, "other", "clip")}
    last = state.with_feedback(tags, spark.createDataFrame([(1, "old", 1, 1), (1, "old", 0, 2), (2, "mine", 1, 1)], schema.FEEDBACK))
    assert {(r.media_id, r.label) for r in last.collect()} == {(1, "pinned"), (2, "other"), (2, "mine")}


def test_members_and_choices(spark):
    items = spark.createDataFrame([(1, 1, 10, None)], schema.ALBUM_ITEMS)
    add = spark.createDataFrame([(1, 1, 20, 5000), (1, 2, 20, None)], schema.ALBUM_ITEMS)
    assert {(r.media_id, r.added_at, r.scene_time_ms) for r in state.with_members(items, add).collect()} == {(1, 10, 5000), (2, 20, None)}
    old = spark.createDataFrame([("a", 1, False)], schema.CHOICES)
    assert [(r.keep_id, r.dismissed) for r in state.with_choice(old, spark.createDataFrame([("a", None, True)], schema.CHOICES)).collect()] == [(1, True)]
    stamps = spark.createDataFrame([("model", "1"), ("rules", "7")], "k STRING, v STRING")
    assert state.stale(stamps, {"model": "2", "rules": "7", "places": "x"}) == ["model", "places"]


def test_backups(spark):
    m = media(spark, {"media_id": 1, "display_name": "a", "bytes": 5, "taken_at": None, "rel_path": "p/"}, {"media_id": 2, "display_name": "b", "bytes": 6, "taken_at": 9, "rel_path": "p/"}, {"media_id": 3, "display_name": "b", "bytes": 6, "taken_at": 9, "rel_path": "q/"}, {"media_id": 4, "bytes": 7})
    fav = spark.createDataFrame([(2, 100), (77, 1)], schema.FAVORITES)
    items = spark.createDataFrame([(1, 1, 50, None)], schema.ALBUM_ITEMS)
    fb = spark.createDataFrame([(4, "x", 1, 3)], schema.FEEDBACK)
    refs = backup.references(fav, items, fb, m)
    assert {r.ref: r.media_id for r in refs.collect()} == {0: 2, 1: 1, 2: 4}
    assert {r.ref: r.media_id for r in backup.resolved(refs, m).collect()} == {0: 2, 1: 1}
    moved = m.withColumn("rel_path", F.lit("elsewhere/"))
    assert {r.ref: r.media_id for r in backup.resolved(refs, moved).collect()} == {1: 1}

    arr = lambda df, *c: F.lit(None) if df is None else None  # noqa: E731, F841
    doc = refs.agg(F.sort_array(F.collect_list(F.struct("ref", "name", "bytes", "taken", "path"))).alias("media"))
    doc = doc.select(F.lit(7).cast("bigint").alias("created_at"), "media", F.expr("array(named_struct('ref', 0L, 'ts', 100L))").alias("favorites"), F.expr("array(named_struct('name', 'n', 'created', 1L, 'items', array(named_struct('ref', 1L, 'added', 50L, 'scene', CAST(NULL AS BIGINT)))))").alias("albums"), F.expr("array(named_struct('ref', 2L, 'label', 'x', 'verdict', 1, 'ts', 3L))").alias("feedback"))
    read = backup.decoded(backup.encoded(doc))
    links = backup.resolved(refs, m)
    favs, verdicts, missing = backup.restored(read, links, fav.limit(0), fb.limit(0))
    assert [(r.media_id, r.ts) for r in favs.collect()] == [(2, 100)] and verdicts.count() == 0 and [r.ref for r in missing.collect()] == [2]
    al, it = backup.restored_albums(read, links, spark.createDataFrame([(4, "other", 1)], schema.ALBUMS), items.limit(0))
    assert {(r.id, r.name) for r in al.collect()} == {(4, "other"), (5, "n")} and [(r.album_id, r.media_id) for r in it.collect()] == [(5, 1)]
    for bad in ('{"format":"media-backup","version":2}', '{"format":"x","version":1}', "{}"):
        with pytest.raises(Exception, match="not a backup"):
            backup.decoded(spark.createDataFrame([(bad,)], "json STRING")).collect()


# search, albums, the rest


def test_search(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    at = 1_750_000_000  # 2025-06-15
    m = media(spark, *({"media_id": k, "taken_at": at + k, "embedding": v if k % 2 else w, "media_kind": "video" if k > 7 else "photo"} for k in range(1, 10)), {"media_id": 50, "taken_at": 1, "embedding": v}, {"media_id": 51, "taken_at": at, "embedding": v, "is_accessible": False})
    frames = spark.createDataFrame([(8, 0, w), (8, 20_000, v), (9, 0, w)], schema.FRAMES)
    tags = spark.createDataFrame([(k, "개", None, "clip") for k in (1, 2, 8)], schema.TAGS)
    from datetime import date

    q = parser.parse("작년 바다", date(2026, 9, 28))
    out = search.search(q, m, tags, frames, v).orderBy("pos").collect()
    assert [r.media_id for r in out if r.section == "close"] == [1, 3, 5, 7, 8] and {r.media_id for r in out} == set(range(1, 10))
    assert [s.time_ms for s in next(r for r in out if r.media_id == 8).scenes] == [20_000, 0]
    q = parser.parse("작년 개 바다", date(2026, 9, 28), tags=["개"])
    out = search.search(q, m, tags, frames, v, tag_vector=v).collect()
    assert {r.media_id for r in out if r.section == "close"} == {1, 2, 8} and {r.media_id for r in out if r.section == "other"} == {3, 4, 5, 6, 7, 9}
    q = parser.parse("작년", date(2026, 9, 28))
    assert [r.media_id for r in search.search(q, m, tags, frames, v).orderBy("pos").collect()] == list(range(9, 0, -1))


def test_albums(spark):
    m = media(spark, *({"media_id": k, "taken_at": k, "bucket": "a" if k < 5 else "b", "media_kind": "video" if k == 1 else "photo"} for k in range(1, 7)))
    tags = spark.createDataFrame([(1, "t", None, "clip"), (2, "t", None, "rule"), (3, "hidden", None, "clip")], schema.TAGS)
    users = spark.createDataFrame([(1, "mine", 0), (2, "empty", 0)], schema.ALBUMS)
    items = spark.createDataFrame([(1, 2, 0, None)], schema.ALBUM_ITEMS)
    ev = spark.createDataFrame([(9, 1, "trip"), (9, 2, "trip")], "event_id BIGINT, media_id BIGINT, title STRING")
    fav = spark.createDataFrame([(1, 0)], schema.FAVORITES)
    out = albums.in_list_order(albums.albums(m, tags, fav, users, items, ev, hidden=("hidden",))).collect()
    assert [(r.kind, r.name, r.n, r.videos) for r in out] == [("user", "favorites", 1, 1), ("user", "mine", 1, 0), ("user", "empty", 0, 0), ("folder", "a", 4, 1), ("tag", "t", 2, 1), ("event", "trip", 2, 1)]
    assert out[3].cover_ids == [4, 3, 2]
    videos = albums.albums(m, tags, fav, users, items, ev, kind="video", min_folder=1)
    assert {r.name for r in videos.collect()} == {"favorites", "a", "t", "trip"}
    axes = spark.createDataFrame([("t", "life")], "label STRING, axis STRING")
    named = albums.with_axis(spark.createDataFrame([("t",), ("kid",), ("?",)], "name STRING"), axes, spark.createDataFrame([("kid", "t")], "label STRING, parent STRING"))
    assert {r.name: r.axis for r in named.collect()} == {"t": "life", "kid": "life", "?": "moment"}
    assert ids(albums.album_members("tag", "t", m, tags, fav, items, ev)) == [1, 2]


def test_pages_neither_repeat_nor_miss(spark):
    m = media(spark, *({"media_id": k, "taken_at": k // 4 if k % 3 else None, "bytes": k % 2} for k in range(10)))
    for order in filters.ORDERS:
        got = [r.media_id for o in range(0, 10, 3) for r in filters.page(m, order, 3, o).collect()]
        assert sorted(got) == list(range(10))


def test_predicates(spark):
    m = media(spark, {"media_id": 1, "taken_at": 10}, {"media_id": 2, "taken_at": 20}, {"media_id": 3, "taken_at": 30}, {"media_id": 4}, {"media_id": -5, "media_kind": None, "state": 3})
    assert ids(filters.taken_between(m, 20, 30)) == [2, 3] and ids(filters.taken_between(m, None, 20)) == [1, 2]
    assert ids(filters.of_kind(m, "video")) == [-5] and ids(filters.visible(m)) == [-5, 1, 2, 3, 4]
    assert filters.blurry(m, 0.0).count() == 0
    order = spark.createDataFrame([(3, 0), (1, 1)], "media_id BIGINT, pos INT")
    assert [r.media_id for r in filters.in_order_of(m, order).collect()] == [3, 1]
    arrays = spark.createDataFrame([([1, 2], [2, 3]), ([1, 2, 3], [2, 3])], "s ARRAY<INT>, i ARRAY<INT>").select(filters.toggled(F.col("s"), F.col("i")).alias("t"))
    assert [r.t for r in arrays.collect()] == [[1, 2, 3], [1]]


def test_percentiles_of_nothing(spark):
    m = media(spark, {"media_id": 1})
    assert rollups.percentiles(m, "blur_score").count() == 0 and rollups.percentiles_at(m, "blur_score").count() == 0
    assert rollups.counts(media(spark)).first().progress == 0


def test_numbers_and_places(spark):
    g = spark.createDataFrame([("EXACT" if k % 3 else "BURST", f"k{k}", k) for k in range(50)] * 2, "kind STRING, key STRING, media_id INT")
    out = {(r.kind, r.key): r.group_id for r in grouping.numbered(g, 4).collect()}
    assert sorted(out.values()) == list(range(1, 51))
    assert max(i for (k, _), i in out.items() if k == "EXACT") < min(i for (k, _), i in out.items() if k == "BURST")
    draw = random.Random(6)
    xs = sorted(draw.choice((draw.random(), 0.5, 0.25)) for _ in range(999))
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    for parts in (2, 7, 200):
        assert {r.percent: r.value for r in rollups.percentiles_at(df, "x", (0, 1, 5, 50, 90, 100), parts).collect()} == {p: xs[998 * p // 100] for p in (0, 1, 5, 50, 90, 100)}


def test_metrics(spark):
    p = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "b", ["a"]), (3, "b", []), (4, "a", ["a"])], "item_id BIGINT, truth STRING, predicted ARRAY<STRING>")
    by = {r.label: r for r in evaluate.per_label(p).collect()}
    assert (by["a"].tp, by["a"].fp, by["a"].fn) == (2, 1, 0) and (by["b"].tp, by["b"].fp, by["b"].fn) == (0, 1, 2) and by["b"].f1 == 0
    one = evaluate.overall(p).first()
    assert (one.accuracy, one.coverage, one.mean_tags) == (0.5, 0.75, 1.0)


# sources


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("a.JPG", "x/b.png", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    found = sources.scan_folder(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.JPG", "b.png"]
    assert sources.hashed_folder(spark, str(tmp_path)).where("length(sha256) = 64").count() == 3
    free = sources.free_names(spark.createDataFrame([("a.jpg",), ("a.jpg",), ("n.jpg",)], "name STRING"), spark.createDataFrame([("a.jpg",), ("a_1.jpg",)], "name STRING"))
    assert sorted(r.free for r in free.collect()) == ["a_2.jpg", "a_3.jpg", "n.jpg"]
    g = spark.createDataFrame([(1, "Seoul,서울,서울특별시", 1.0, 2.0, 9_000_000), (2, "서울", 3.0, 4.0, 100), (3, "abc", 0.0, 0.0, 5)], "id INT, alternates STRING, lat DOUBLE, lon DOUBLE, population BIGINT")
    assert [(r.name, r.population, r.radius_km) for r in sources.gazetteer(g).collect()] == [("서울", 9_000_000, 30.0)]
    e = spark.createDataFrame([("c", "cat", "CC BY-SA 4.0"), ("c", "Cat 2", "CC0"), ("c", "logo cat", "CC0"), ("c", "cat", "CC BY 2.0")], "category STRING, title STRING, licence STRING")
    assert [(r.title, r.tier) for r in sources.evaluation_set(e, ("logo",), 2).orderBy("place").collect()] == [("Cat 2", 0), ("cat", 1)]


def test_vector_blobs_and_plug_ins(spark):
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v ARRAY<FLOAT>").select("v", sources.vector_blob("v").alias("b"))
    back = v.select("v", "b", sources.blob_vector("b", 2).alias("w"), sources.blob_vector("b", 3).alias("x")).collect()
    assert back[0].w == [1.5, -2.0] and back[0].x is None and back[1].w is None and len(back[0].b) == 8

    files = spark.createDataFrame([("a", b"12"), ("b", b"x")], "path STRING, content BINARY")
    out = {r.path: (r.width, r.error) for r in sources.decoded_media(files, lambda b: {"width": int(b)}, "width INT").collect()}
    assert out["a"] == (12, None) and out["b"][0] is None and "ValueError" in out["b"][1]
    enc = sources.encoded_items(files.withColumnRenamed("path", "media_id"), lambda b: [float(int(b))])
    assert {r.media_id: r.embedding for r in enc.collect()} == {"a": [12.0], "b": None}


def test_runs_over_slices_are_those_of_one_window(spark):
    from pyspark.sql import Window as W

    from shoebox.operators.runs import with_runs

    draw = random.Random(2)
    rows = [(k, draw.choice((None, 1, 1, 2)), draw.choice((draw.randint(0, 2_000_000), 777))) for k in range(600)]
    df = spark.createDataFrame(rows, "media_id BIGINT, owner INT, taken_at BIGINT")
    order = W.partitionBy("owner").orderBy("taken_at", "media_id")
    plain = df.withColumn("r", F.sum(F.coalesce((F.col("taken_at") - F.lag("taken_at").over(order) > 9000).cast("int"), F.lit(0))).over(order))
    want = {(r.media_id, r.r) for r in plain.collect()}
    for size in (1000, 86_400, 1 << 40):
        out = with_runs(df, lambda prior: F.col("taken_at") - prior["taken_at"] > 9000, "r", ("owner",), slice_sec=size)
        assert {(r.media_id, r.r) for r in out.collect()} == want
        assert out.columns == [*df.columns, "r"]


# encoders' input


def test_resampling(spark):
    from shoebox.sources import encoders

    flat = np.full((40, 60, 3), 77, np.uint8)
    assert (encoders.resized(flat, 7, 9) == 77).all() and encoders.resized(flat, 7, 9).shape == (9, 7, 3)
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 5, 0).repeat(3, 2)
    assert np.allclose(encoders.resized(ramp, 10, 5)[0, 2:-2, 0], ramp.reshape(5, 10, 2, 3).mean(2)[0, 2:-2, 0], atol=1)
    assert np.allclose(encoders.triangle_weights(11, 4).sum(1), 1) and (encoders.triangle_weights(5, 5) == np.eye(5)).all()
    one = encoders.model_input(ramp.repeat(4, 0), 8, [0.0] * 3, [1.0] * 3)
    assert one.shape == (3, 8, 8) and 0 <= one.min() <= one.max() <= 1
    images = spark.createDataFrame([(1, 2, 2, bytes(12)), (2, 2, 2, b"x"), (3, None, 2, bytes(12))], "media_id INT, width INT, height INT, rgb BINARY")
    got = {r.media_id: r["values"] for r in encoders.model_inputs(images, 2, [0.5] * 3, [0.5] * 3).collect()}
    assert got[1] == [-1.0] * 12 and got[2] is None and got[3] is None


def test_ids_for_a_text_encoder(spark):
    from shoebox.sources import encoders

    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows = spark.createDataFrame([("A  Photo",), ("a photo",), (None,), ("word " * 200,)], "t STRING")
    got = [r[0] for r in rows.select(encoders.padded_ids(F.col("t"), public_tokenizers.path("word_bpe_49k.json"))).collect()]
    assert all(len(x) == 77 and x[0] == 49406 and x[-1] == 49407 for x in got)
    assert got[0] == got[1] and got[2] == [49406] + [49407] * 76 and got[3].count(49407) == 1


def test_prompts_are_kept_by_stamp(spark, tmp_path):
    from shoebox.sources import encoders

    p = spark.createDataFrame([("category", None, "a", "one"), ("category", None, "a", "two")], "family STRING, parent STRING, label STRING, prompt STRING")
    mark = encoders.stamp("m", p)
    assert mark == encoders.stamp("m", p.orderBy(F.desc("prompt"))) != encoders.stamp("n", p)
    built = []

    def build():
        built.append(1)
        return p

    for _ in range(2):
        assert encoders.kept_by_stamp(spark, f"file://{tmp_path}/p", mark, build).count() == 2
    assert len(built) == 1


def test_cleanup(spark):
    from shoebox.operators import cleanup

    m = media(spark, {"media_id": 1, "sha256": "a", "bytes": 5, "blur_score": 1.0, "display_name": "x"}, {"media_id": 2, "sha256": "a", "bytes": 7, "brightness": 1.0, "display_name": "x (1)"})
    g = grouping.exact_groups(m)
    got = {(r.section, r.media_id, r.detail) for r in cleanup.report(m, g, 2.0, 5.0, 250.0, 1).collect()}
    assert got == {("blurry", 1, "1.0"), ("low quality", 2, "7"), ("copies", 1, "EXACT:1"), ("copies", 2, "EXACT:1"), ("reclaimable", None, "7")}
    gone, kept = cleanup.trash(m.select("media_id"), g)
    assert ids(gone) == [2] and ids(kept) == [1]
