"""URL verdicts: fixed rules first, then association rules mined from the urls that those label.

FP-growth mines combinations of URL tokens that go with a label. Rules below the confidence and
support asked for are pruned, and so are rules that a shorter one of at least their confidence makes
needless. Two kinds of needless rules are never mined: with tokens that always come together, of which
one stands for all, and with a token that alone has only one label. An inverted index from token to
rules finds, for each distinct set of tokens, the rules whose tokens are all there; the surest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import scratch, work_path, written

SUPPORT, CONFIDENCE = 0.005, 0.8
DEFAULT = "allow"
_JOINT = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The name or the verdict of the longest rule that fits; null if none does. Of equally long ones the first in order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted: scheme, labels of the host, segments of the path by place, names of the query, and whether there is a fragment."""
    url = F.coalesce(url, F.lit(""))
    some = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    segments = F.transform(F.split(path, "/"), lambda x, k: F.when(x == "", "").otherwise(F.concat(F.least(k, F.lit(3)).cast("string"), F.lit(":"), x)))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(some(F.array(scheme), "scheme:"), some(F.split(host, r"\."), "host:"), some(segments, "path"), some(names, "query:"), fragment)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules from labelled(tokens, label): tokens, verdict, confidence, support, ways. support is a share of the labelled rows.

    Of tokens that are in the same rows, the least stands for all: `ways` has for each of `tokens`
    those that it stands for, itself included, and any of them will do. Null tokens or labels are not
    learned from; no labelled row gives no rules. Sets of tokens that are frequent, vary independently
    and are never sure alone are mined in all their combinations, as many as `support` allows.
    """
    spark = labelled.sparkSession
    baskets = labelled.where("tokens IS NOT NULL AND label IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "label")
    baskets = written(baskets, work_path(spark, "baskets"))
    total = baskets.count()
    if not total:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double, ways array<array<string>>")
    single = baskets.select("id", "label", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"rows{k}") for k in (1, 2)]
    tokens = single.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), *same)
    alike = [F.bit_xor(f"rows{k}").alias(f"rows{k}") for k in (1, 2)]
    tokens = tokens.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("label"), *alike).where(F.col("n") >= support * total)
    classes = tokens.groupBy("n", "rows1", "rows2").agg(F.min("token").alias("least"), F.array_sort(F.collect_list("token")).alias("ways"), F.first("most").alias("most"), F.first("label").alias("label"))
    # at most mean tokens / support of a basket: each of these tokens is in a share of `support` of the rows
    classes = written(classes.select("least", "ways", "n", "label", (F.col("most") == F.col("n")).alias("sure")), work_path(spark, "classes"))
    alone = classes.where("sure").select(F.array("least").alias("tokens"), F.col("label").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))

    stand_ins = classes.where("NOT sure").select(F.col("least").alias("token"))
    kept = single.join(stand_ins, "token").groupBy("id").agg(F.collect_list("token").alias("kept"))
    label = F.concat(F.lit("label="), F.col("label"))
    items = baskets.select("id", label.alias("label")).join(kept, "id", "left").select(F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.array("label")).alias("items"))
    items = written(items, work_path(spark, "items"))
    mined = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    rules = mined.where(F.col("consequent")[0].startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(len("label=") + 1)).alias("verdict"), "confidence", "support")
    rules = written(rules.unionByName(alone), work_path(spark, "rules"))
    # a rule is needless if leaving out one of its tokens gives a rule for the same verdict that is as sure
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    shorter = shorter.select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("token")).alias("rest"))
    other = rules.select(F.col("tokens").alias("rest"), "verdict", F.col("confidence").alias("sure"))
    needless = shorter.join(other, ["rest", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    left = rules.join(needless, ["tokens", "verdict"], "left_anti")
    each = left.select("*", F.posexplode("tokens").alias("at", "least")).join(classes.select("least", "ways"), "least")
    ways = F.transform(F.array_sort(F.collect_list(F.struct("at", "ways"))), lambda x: x["ways"]).alias("ways")
    return written(each.groupBy("tokens", "verdict", "confidence", "support").agg(ways), work_path(spark, "kept_rules"))


def match(sets: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(key, verdict) for each row of sets(key, tokens): that of the rule of highest confidence whose tokens are all there, then of highest support, most tokens, `default` before others, last in order; `default` if none is."""
    index = rules.withColumn("rule", F.concat_ws(_JOINT, "tokens")).withColumn("size", F.size("tokens"))
    index = index.select("rule", "size", "verdict", "confidence", "support", F.posexplode("ways").alias("at", "way")).select("*", F.explode("way").alias("token")).drop("way")
    hits = sets.select("key", F.explode("tokens").alias("token")).join(index, "token")
    met = hits.groupBy("key", "rule", "verdict").agg(F.count_distinct("at").alias("n"), F.first("size").alias("size"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).where("n = size")
    best = met.groupBy("key").agg(F.max_by("verdict", F.struct("confidence", "support", "size", F.col("verdict") == default, "rule")).alias("found"))
    return sets.select("key").join(best, "key", "left").select("key", F.coalesce("found", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: list[Rule], support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (name of the fixed rule, or null), verdict (its, else that of the mined rules).

    A null url has no host, no path, no token: no rule fits, and the default is its verdict. Repeated
    rows and null ids pass through; other columns aren't read. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    base = base.select("page_id", "host", "path", rule_of(host, path, rules, "name").alias("rule"), rule_of(host, path, rules, "verdict").alias("fixed"), tokens_of(F.col("url"), host, path).alias("tokens"))
    base = written(base, work_path(spark, "urls"))
    place = work_path(spark, "told")
    with scratch(spark):
        told, used = _verdicts(base, support, confidence, place)
    told_apart = F.array_intersect("tokens", F.array(*map(F.lit, used)).cast("array<string>"))
    out = base.withColumn("key", F.concat_ws(_JOINT, told_apart)).join(told, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "found", F.lit(DEFAULT)).alias("verdict"))


def _verdicts(base: DataFrame, support: float, confidence: float, place: str) -> tuple[DataFrame, list[str]]:
    """((key, found) written to place, tokens in order that tell keys apart) for the urls that no fixed rule fits."""
    spark = base.sparkSession
    mined = mine(base.where("fixed IS NOT NULL").select("tokens", F.col("fixed").alias("label")), support, confidence)
    # a share of `support` of the urls has each of these tokens, so there are at most mean tokens / support of them
    used = sorted(r.token for r in mined.select(F.explode(F.flatten("ways")).alias("token")).distinct().collect())
    told_apart = F.array_intersect("tokens", F.array(*map(F.lit, used)).cast("array<string>"))
    open_ = base.where("fixed IS NULL").select(told_apart.alias("tokens"), F.concat_ws(_JOINT, told_apart).alias("key"))
    # few distinct sets of such tokens are left of any number of urls
    sets = open_.groupBy("key").agg(F.first("tokens").alias("tokens"))
    return written(match(written(sets, work_path(spark, "sets")), mined).withColumnRenamed("verdict", "found"), place), used
