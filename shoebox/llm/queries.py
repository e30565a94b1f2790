"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language_id, quality, sharding, simhash, token_count, url_rules, warc
from .session import table, work_path


def _remainder(divisor: int):
    """crc32 of the id's text, by which rows are held out; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_remainder(4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    out = language_id.identify(docs, model)
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Network | None:
    """Learned from the labelled rows of docs that aren't held out."""
    return quality.fit(docs.where(_remainder(5) != 0), table(spark, sf_dir, "labels").where(_remainder(5) != 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.scores(docs, quality_network(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    path = work_path(spark, "warc")
    warc.write_archive(warc.with_revisits(pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), "payload"), "page_id"), path)
    number = lambda col: F.nullif(F.regexp_replace(col, "^urn:page:", ""), F.lit("")).cast("long")
    # payloads are decoded for the responses alone; a revisit's headers tell what it revisits
    bodies = warc.read_archive(spark, path).where(F.col("record_type") == "response")
    again = warc.read_archive(spark, path, payload=False).where(F.col("record_type") == "revisit")
    responses = bodies.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = again.select("record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
    return responses.unionByName(revisits).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from a store of eight arrivals after compaction."""
    docs = sharding.shard_arrivals(table(spark, sf_dir, "documents"), arrivals=8).read()
    return docs.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: The rules that come before the mined ones.
URL_RULES = [
    url_rules.Rule("block", "net", "/"),
    url_rules.Rule("allow", "example.net", "/en/"),
    url_rules.Rule("block", "example.com", "/de/"),
    url_rules.Rule("allow", "org", "/fr/"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_url_rules": op9_url_rules,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
            FROM pages
        )
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM p
    """,
    "op6_sharding": """
        SELECT doc_id, lang, source, n_chars, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM documents
    """,
    "op7_decontaminate": r"""
        WITH raw AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents
            UNION ALL
            SELECT 'i', item_id, text FROM benchmark
        ),
        split AS (
            SELECT side, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
            FROM raw
        ),
        items AS (
            SELECT id AS item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM (SELECT id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k
                  FROM split WHERE side = 'i' AND len(w) > 0)
        ),
        docs AS (
            SELECT id AS doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM (SELECT s.id, s.w, l.n, unnest(range(1, len(s.w) - l.n + 2)) AS k
                  FROM split s, (SELECT DISTINCT n FROM items) l WHERE s.side = 'd' AND len(s.w) >= l.n)
        ),
        found AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM docs d JOIN items i ON d.n = i.n AND d.win = i.win),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM found))
            GROUP BY doc_id
        ),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found)
            GROUP BY doc_id
        )
        SELECT s.id AS doc_id, len(s.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(s.w) AS contaminated
        FROM split s LEFT JOIN hit ON s.id = hit.doc_id LEFT JOIN named ON s.id = named.doc_id
        WHERE s.side = 'd'
    """,
    # every set of frequent tokens of every labelled url is counted: plain, and only for small tables
    "op9_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, url, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM u
        ),
        fixed AS (
            SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                           WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                           WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                           WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
                   list_sort(list_distinct(list_concat(
                       list_transform(list_filter([regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)], lambda x: x <> ''), lambda x: 'scheme:' || x),
                       list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
                       list_filter(list_transform(string_split(path, '/'), lambda x, k: CASE WHEN x = '' THEN '' ELSE 'path' || least(k - 1, 3) || ':' || x END), lambda x: x <> ''),
                       list_transform(list_filter(list_transform(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*', 0)), lambda x: x <> ''), lambda x: 'query:' || x),
                       CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END))) AS tokens
            FROM parts
        ),
        labelled AS (SELECT page_id, tokens, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS label FROM fixed WHERE rule IS NOT NULL),
        total AS (SELECT count(*) AS n FROM labelled),
        frequent AS (SELECT token FROM (SELECT unnest(tokens) AS token FROM labelled) GROUP BY token HAVING count(*) >= 0.005 * (SELECT n FROM total)),
        kept AS (SELECT page_id, any_value(label) AS label, list(token ORDER BY token) AS t FROM (SELECT page_id, label, unnest(tokens) AS token FROM labelled) JOIN frequent USING (token) GROUP BY page_id),
        alike AS (SELECT t, label, count(*) AS w FROM kept GROUP BY t, label),
        sets AS (SELECT list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s, label, w FROM (SELECT *, unnest(range(1, CAST(1 << len(t) AS BIGINT))) AS m FROM alike)),
        counted AS (SELECT s, label, sum(w) AS c, sum(sum(w)) OVER (PARTITION BY s) AS of FROM sets GROUP BY s, label),
        rules AS (SELECT s, label, c / of AS confidence, c / n AS support FROM counted, total WHERE c >= 0.005 * n AND c / of >= 0.8),
        needless AS (
            SELECT DISTINCT a.s, a.label FROM (SELECT *, list_filter(s, lambda y: y <> x) AS rest FROM (SELECT *, unnest(s) AS x FROM rules)) a
            JOIN rules b ON b.s = a.rest AND b.label = a.label AND b.confidence >= a.confidence
        ),
        used AS (SELECT * FROM rules ANTI JOIN needless USING (s, label)),
        open AS (SELECT DISTINCT tokens FROM fixed WHERE rule IS NULL),
        told AS (
            SELECT tokens, max_by(label, (confidence, support, len(s), label = 'allow', array_to_string(s, chr(1)))) AS verdict
            FROM open, used WHERE list_has_all(tokens, s) GROUP BY tokens
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(told.verdict, 'allow') END AS verdict
        FROM fixed LEFT JOIN told ON fixed.rule IS NULL AND told.tokens = fixed.tokens
    """,
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM t
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
    """,
}
