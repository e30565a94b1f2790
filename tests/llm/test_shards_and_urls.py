from __future__ import annotations

import re
import time
from collections import Counter
from itertools import combinations, product

import pytest

from shoebox.llm import queries, sharding, url_rules

from .data import TEXTS, edges, empty


# shards


def rows(df):
    return Counter(str(tuple(r)) for r in df.collect())


def test_every_row_comes_back(spark):
    store = sharding.shard_arrivals(edges(spark), 8)
    assert rows(store.read()) == rows(edges(spark)) and store.read().columns == edges(spark).columns
    assert sharding.shard_arrivals(empty(spark), 4).read().count() == 0


def test_runs_of_like_size_merge(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, min_runs=3)
    part = lambda n: spark.range(n).selectExpr("id", "repeat(sha2(CAST(id AS STRING), 256), 3) AS t").repartition(2)
    for _ in range(2):
        store.append(part(3000))
    store.append(part(100))
    assert store.compact() == 3  # two alike and a small one: nothing is due
    store.append(part(3000))
    before = store.manifest()
    assert store.compact() == 5
    runs = {r["tier"]: r for r in store.manifest()["runs"]}
    assert sorted(runs) == [0, 1] and len(store.manifest()["runs"]) == 2
    total = sum(sharding.run_bytes(r) for r in before["runs"] if sharding.run_bytes(r) > 50_000)
    assert len(runs[1]["files"]) <= 1 + total // (1 << 20)
    assert store.read().count() == 9100 == store.read(version=4).count()
    assert len(store.remove_unused()) == 3 and store.read().count() == 9100
    assert store.compact() == 5


def test_two_writers(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(3))
    seen = store.manifest()
    store.append(spark.range(4))
    with pytest.raises(RuntimeError):
        store._commit(seen, [], seen["schema"])
    assert store.version() == 2 and store.read().count() == 7
    with pytest.raises(ValueError):
        store.append(spark.range(2).withColumnRenamed("id", "other"))
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, f"file://{tmp_path}/none").read()


def test_the_plan_of_a_merge_has_no_shuffle_and_no_python(spark, small):
    plan = queries.op6_sharding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)


# urls

URLS = [
    "http://A.Example.NET/en/1", "https://example.net/de/1", "http://x.net", "http://x.net?q=1", "net/", None, "", "http://example.com/de/", "http://a.example.com/de/x?y#z",
    "http://badexample.com/de/", "http://example.org/fr/1", "http://fr.org/fr", "ftp://h.org#/fr/", "http://example.net/en", "http://[::1]/a b?c", "http://Ü.NET/Ü", "http://example.com://en/", "http://spam.com/win/1", "http://spam.com/win/2",
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING")


def test_fixed_rules(spark):
    out = {r.page_id: r for r in url_rules.judge(frame(spark, URLS * 2), queries.URL_RULES).collect()}
    assert len(out) == 2 * len(URLS)
    for k, url in enumerate(URLS * 2):
        host, path, best = brute_rule(url)
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, best and best[0])
        assert best is None or out[k].verdict == best[1]
    assert out[5].verdict == out[6].verdict == "allow"
    assert url_rules.judge(frame(spark, URLS).limit(0), queries.URL_RULES).count() == 0


def brute_mined(baskets, support, confidence):
    """Every rule by counting every set of tokens."""
    n, count = len(baskets), Counter()
    for tokens, label in baskets:
        for size in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), size):
                count[some] += 1
                count[some, label] += 1
    found = {}
    for key, c in count.items():
        if isinstance(key[0], tuple) and c >= support * n and c / count[key[0]] >= confidence:
            found[key] = (c / count[key[0]], c / n)
    return {k: v for k, v in found.items() if not any((tuple(t for t in k[0] if t != x), k[1]) in found and found[tuple(t for t in k[0] if t != x), k[1]][0] >= v[0] for x in k[0])}


def expanded(rules):
    """Each rule with each choice of the tokens that stand for one another."""
    out = {}
    for r in rules.collect():
        assert [w[0] for w in r.ways] == list(r.tokens)
        for some in product(*r.ways):
            out[tuple(sorted(some)), r.verdict] = (round(r.confidence, 9), round(r.support, 9))
    return out


BASKETS = [
    [(["a", "b", "c"], "block"), (["a", "b"], "block"), (["a"], "allow"), (["b", "d"], "allow"), (["c", "d"], "block"), (["a", "b", "d"], "block"), (["d"], "allow"), (["e"], "allow")] * 2,
    [(["a", "a2", "b"], "block"), (["a", "a2", "c", "c2", "c3"], "block"), (["b", "c", "c2", "c3", "s", "s2"], "block"), (["b", "s", "s2"], "block"), (["a", "a2"], "allow"), (["c", "c2", "c3"], "allow"), ([], "allow"), (["b"], "else")] * 3,
]


@pytest.mark.parametrize("baskets", BASKETS)
def test_mined_rules_and_their_match(spark, baskets):
    df = spark.createDataFrame(baskets, "tokens ARRAY<STRING>, label STRING")
    mined = url_rules.mine(df, 0.1, 0.6)
    want = brute_mined(baskets, 0.1, 0.6)
    assert expanded(mined) == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()}
    sets = [("1", ["a", "b"]), ("2", ["d"]), ("3", ["z"]), ("4", []), ("5", ["a", "b", "c", "d", "e"]), ("6", ["a2", "b", "c3"]), ("7", ["c2", "a"]), ("8", ["s2"]), ("9", ["b"])]
    out = {r.key: r.verdict for r in url_rules.match(spark.createDataFrame(sets, "key STRING, tokens ARRAY<STRING>"), mined).collect()}
    for key, tokens in sets:
        fits = [(c, s, len(t), v == "allow", "\x01".join(t), v) for (t, v), (c, s) in want.items() if set(t) <= set(tokens)]
        assert out[key] == (max(fits)[-1] if fits else "allow")


def test_many_shared_parameters_are_one(spark):
    """Thirty parameters that come together would be 2 ** 30 sets."""
    query = "?" + "&".join(f"p{k}={k}" for k in range(30))
    urls = [f"http://site{k}.net/shop/{k}{query if k % 2 else ''}" for k in range(100)] + [f"http://site{k}.org/fr/{k}{query if k % 2 else ''}" for k in range(100)]
    urls += [f"http://other.com/shop/1{query}", f"http://other.com/fr/2{query}", f"http://other.com/none{query}"]
    began = time.time()
    out = {r.page_id: r for r in url_rules.judge(frame(spark, urls), queries.URL_RULES).collect()}
    assert [out[k].verdict for k in (200, 201, 202)] == ["block", "allow", "allow"]
    assert time.time() - began < 60


def test_verdicts_of_a_table_against_brute_force(spark, small):
    """Fixed rules, tokens, mining by counting and matching, all in plain Python."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()

    def tokens(url):
        url = url or ""
        host, path, _ = brute_rule(url)
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url)
        query = re.match(r"[^?#]*\?([^#]*)", url)
        out = {f"scheme:{scheme[1]}"} if scheme else set()
        out |= {f"host:{x}" for x in host.split(".") if x}
        out |= {f"path{min(k, 3)}:{x}" for k, x in enumerate(path.split("/")) if x}
        out |= {f"query:{n}" for x in (query[1].split("&") if query else []) if (n := x.split("=")[0])}
        return out | ({"fragment"} if "#" in url else set())

    told = {p.page_id: (tokens(p.url), brute_rule(p.url)[2]) for p in pages}
    baskets = [(t, best[1]) for t, best in told.values() if best]
    often = Counter(x for t, _ in baskets for x in t)
    baskets = [({x for x in t if often[x] >= url_rules.SUPPORT * len(baskets)}, label) for t, label in baskets]
    rules = brute_mined(baskets, url_rules.SUPPORT, url_rules.CONFIDENCE)
    for r in url_rules.judge(spark.read.parquet(f"{small}/pages.parquet"), queries.URL_RULES).collect():
        t, best = told[r.page_id]
        fits = [(c, s, len(k), v == "allow", "\x01".join(k), v) for (k, v), (c, s) in rules.items() if set(k) <= t]
        assert r.verdict == (best[1] if best else max(fits)[-1] if fits else "allow")


def test_the_method_judges_what_no_rule_fits(spark):
    urls = [f"http://site{k}.net/shop/{k}" for k in range(30)] + [f"http://site{k}.org/fr/{k}" for k in range(30)] + ["http://other.com/shop/1", "http://other.com/fr/2", "http://other.com/none"]
    out = {r.page_id: r for r in url_rules.judge(frame(spark, urls), queries.URL_RULES).collect()}
    assert [out[k].verdict for k in (60, 61, 62)] == ["block", "allow", "allow"]
    assert all(out[k].rule is None for k in (60, 61, 62))
    assert len(TEXTS) > 0
