from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shoebox.llm import exact_dedup, queries, session, similar_texts, simhash
from shoebox.llm.components import components

from .data import TEXTS, edges, empty


def brute_groups(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, k, i))
    return {digest: (min(g)[4], len(g)) for digest, g in groups.items()}


def test_exact_copies(spark):
    out = exact_dedup.exact_dedup(edges(spark)).collect()
    want = brute_groups(TEXTS)
    assert len(out) == len(TEXTS)
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = defaultdict(int)
    for r in out:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_an_index_takes_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert all(r.kept for r in index.add(frame([(5, "a b"), (6, "c")]), "one").collect())
    second = {r.doc_id: r for r in index.add(frame([(1, "ab"), (2, "d"), (3, "d")]), "two").collect()}
    assert (second[1].kept, second[1].keep_id) == (False, 5)
    assert (second[2].kept, second[3].kept, second[3].keep_id, second[3].group_size) == (True, False, 2, 2)
    again = {r.doc_id: r for r in index.add(frame([(1, "ab"), (2, "d"), (3, "d")]), "two").collect()}
    assert again == second and index.rows().count() == 3
    reopened = exact_dedup.DigestIndex(spark.newSession(), f"file://{tmp_path}/index")
    assert reopened.rows().count() == 3


def test_a_batch_added_again_keeps_the_same_rows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    made = [(k % 5 if k % 3 else None, ["a b", "ab", " ab", "c", None, ""][k % 6], f"source {k % 4}") for k in range(40)]
    rows = spark.createDataFrame(made, "doc_id BIGINT, text STRING, source STRING")
    told = lambda df: sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())
    first = told(index.add(rows, "one"))
    assert sum("True" in x for x in first) == 3
    for other in (rows.repartition(3), rows.orderBy(F.desc("source"), "text"), rows.coalesce(1).orderBy(F.rand(3))):
        assert told(index.add(other, "one")) == first
    assert not any(r.kept for r in index.add(rows, "two").collect()) and index.rows().count() == 3


def test_no_index_is_left_behind(spark):
    before = spark.catalog.listTables()
    exact_dedup.exact_dedup(edges(spark)).count()
    exact_dedup.drop_exact_copies(edges(spark)).count()
    assert spark.catalog.listTables() == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        session.shared_root(Elsewhere())


def test_the_index_is_read_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([(1, "a")], "doc_id BIGINT, text STRING"), "one")
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_dropping_exact_copies(spark):
    docs = edges(spark)
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert len(out.collect()) == len(brute_groups(TEXTS))
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    prints = list(prints)
    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def brute_ids(rows):
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(set(prints))
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted((str(i), f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints, strict=True))


def shown(df):
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect())


def test_near_copies_at_the_edges(spark):
    assert shown(simhash.near_duplicates(edges(spark))) == brute_ids(TEXTS)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_copies_of_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = queries.op3_simhash(spark, small)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out.collect()) == brute_ids(rows)


def crowded(seed, n=400):
    """Fingerprints in crowds: chains of small steps, all within a few bits of a few centres, and lone ones."""
    draw = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(4):
        at = draw.getrandbits(64)
        for _ in range(n // 5):
            for _ in range(draw.choice((1, 1, 2, 3))):
                at ^= 1 << draw.randrange(64)
            out.add(at)
            if draw.random() < 0.5:
                out.add(at ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    return out | {draw.getrandbits(64) for _ in range(n // 5)}


def roots(spark, prints, crowd):
    frame = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp BIGINT")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(simhash.links(frame, crowd)).collect()}
    groups = defaultdict(set)
    for f in prints:
        groups[found.get(f, f)].add(f)
    return sorted(map(sorted, groups.values()))


def test_links_lose_nothing_at_any_limit(spark):
    prints = crowded(3)
    groups = defaultdict(set)
    for f, r in brute_components(prints).items():
        groups[r].add(f)
    want = sorted(map(sorted, groups.values()))
    for crowd in (1, 4, 64):
        assert roots(spark, prints, crowd) == want


def test_split_keys_lose_no_pair(spark):
    prints = sorted(simhash._signed(f) for f in crowded(8, 250))
    frame = spark.createDataFrame([(f,) for f in prints], "fp BIGINT")
    want = {(a, b) for k, b in enumerate(prints) for a in prints[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowd in (1, 3, 64):
        assert {(r.u, r.v) for r in simhash.links(frame, crowd).collect()} == want
    assert simhash._open_after(simhash._open_after(simhash._open_after(64))) <= simhash.MAX_OPEN


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1100)] + [(7000, 7000)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "u BIGINT, v BIGINT")).collect()}
    assert out == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def brute_similar(rows, words=5, similarity=0.8):
    """The component of each row, as a position."""
    sets = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    meets, first = defaultdict(set), {}
    for k, x in enumerate(sets):
        if x in first:
            root[k] = first[x]
            continue
        first[x] = k
        for j in {j for g in x for j in meets[g]}:
            if len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = sorted((find(j), find(k)))
                root[b] = a
        for g in x:
            meets[g].add(k)
    return [find(k) for k in range(len(rows))]


def first_of_similar(rows, **how):
    groups = defaultdict(list)
    for (i, _), root in zip(rows, brute_similar(rows, **how), strict=True):
        groups[root].append((i is None, i or 0, i))
    return sorted(str(min(g)[2]) for g in groups.values())


def made_texts(seed, n=60):
    """Texts with near copies on both sides of the threshold, chains of them, and passages that most share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    rows = []
    for _ in range(n):
        text = rng.choices(words, k=rng.choice([3, 6, 12, 30, 120]))
        if rng.random() < 0.6:
            text = text + rng.choice(passages).split()
        for _ in range(rng.choice([1, 1, 3, 8])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1])] = [rng.choice(words).upper()]
    rng.shuffle(rows)
    return rows


def test_dropping_near_copies(spark):
    docs = edges(spark)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == first_of_similar(TEXTS)
    assert simhash.drop_near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_similar_texts_against_brute_force(spark, similarity):
    rows = made_texts(7)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.component_id for r in similar_texts.similar_texts(df.repartition(3), similarity=similarity).collect()}
    roots = brute_similar(rows, similarity=similarity)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(i, least.get(root, i))
    assert got == {i: least[root] for (i, _), root in zip(rows, roots, strict=True)}
    assert 1 < len(set(got.values())) < len(rows)
    kept = simhash.drop_near_copies(df, similarity=similarity)
    assert sorted(str(r.doc_id) for r in kept.collect()) == first_of_similar(rows, similarity=similarity)


def test_any_order_finds_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "SLOTS", 64)
    rows = made_texts(8, 30)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = simhash.drop_near_copies(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == first_of_similar(rows)


def test_scratch_folders_are_removed(spark):
    from shoebox.llm.session import filesystem, shared_root

    simhash.drop_near_copies(edges(spark)).count()
    exact_dedup.drop_exact_copies(edges(spark)).count()
    fs, root = filesystem(spark, shared_root(spark) + "/shoebox")
    assert not any("scratch" in s.getPath().getName() for s in fs.listStatus(root))


def test_fingerprints_meet_their_leader(spark):
    draw = random.Random(5)
    centre = [draw.getrandbits(64) for _ in range(20)]
    rows, want = [(k, simhash._signed(f), 0) for k, f in enumerate(centre)], set()
    for k, f in enumerate(centre):
        for bits in (0, 1, 2, 3, 4):
            for bit in draw.sample(range(64), bits):
                f ^= 1 << bit
            want.add((k, len(rows)))
            rows.append((len(rows), simhash._signed(f), 1))
            f = centre[k]
    out = {(r.u, r.v) for r in simhash.met(spark.createDataFrame(rows, "node BIGINT, fp BIGINT, own INT")).collect()}
    assert want <= out and len(out) < 2 * len(want)
    far = [(0, 0, 0), (1, simhash._signed(((1 << 20) - 1) << 44), 0)]
    assert simhash.met(spark.createDataFrame(far, "node BIGINT, fp BIGINT, own INT")).count() == 0


def test_near_copies_are_first_sought_by_fingerprints(spark, monkeypatch):
    found, met = [], simhash.met

    def told(table):
        found.append((met(table).count(), table.selectExpr("count(DISTINCT fp)").first()[0]))
        return met(table)

    monkeypatch.setattr(simhash, "met", told)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 150]) for k in range(0, 4)]  # each two share almost all shingles
    df = spark.createDataFrame([*enumerate(texts), (9, "nothing like the others at all")], "doc_id BIGINT, text STRING")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == [0, 9]
    assert len(found) == 1 and found[0][0] >= 1 and found[0][1] >= 2
