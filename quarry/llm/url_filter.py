"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bloom import build_filter, possible
from quarry.llm.common import packed, write_stage

MAX_RULES = 10_000


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a trailing slash; scheme, query and fragment go. Null
    where there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+$", "")))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict for every row.

    rules are (verdict, host, path), MAX_RULES at most: one fits its host and all subdomains where
    the url's path starts with its own; of several the longest host + path wins, then the first by
    code point, then allow. listed has a column url: pages whose canonical form is that of a listed url are
    blocked unless a rule fits; all others are allowed. A null url, or one without ://, has empty
    host and path and is allowed. Null or malformed listed urls are ignored, repeated ones count
    once. Extra columns of pages pass through; those named like an added column are replaced.

    Keys of both lists go into one filter. Each distinct url asks for its canonical form and for
    every pair of host suffix and rule-length path prefix; only keys that may be listed reach the
    exact joins, which hash-join rules (a small list, broadcast) and listed urls (shuffled).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    key_hash = lambda c: F.xxhash64(c)
    rule_rows = sorted({(h + p, v) for v, h, p in rules})
    rule_df = spark.createDataFrame(rule_rows, "rule_key string, rule_verdict string")
    lengths = sorted({len(p) for _, _, p in rules})
    known = listed.select(canonical(F.col("url")).alias("listed_key")).where("listed_key is not null").distinct()
    listed_hashes = known.select(key_hash(F.concat(F.lit("url "), "listed_key")).alias("key_hash"))
    rule_hashes = rule_df.select(key_hash(F.concat(F.lit("rule "), "rule_key")).alias("key_hash"))
    bloom = build_filter(listed_hashes.union(rule_hashes), known.count() + len(rule_rows))

    urls = pages.select(F.col(url).alias("of_url")).where(F.col("of_url").contains("://")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    urls = urls.select("of_url", host_of(F.col("of_url")).alias("host"), path_of(F.col("of_url")).alias("path"), canonical(F.col("of_url")).alias("canon"))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))
    urls = urls.select("of_url", "canon", F.array_distinct(pairs).alias("rule_keys"))
    asked = F.concat(F.array(F.concat(F.lit("url "), F.coalesce("canon", F.lit("")))), F.transform("rule_keys", lambda k: F.concat(F.lit("rule "), k)))
    asked = urls.withColumn("asked", F.transform(asked, key_hash))
    probed = write_stage(asked.withColumn("maybe", possible(bloom, spark)("asked")).where(F.array_contains("maybe", True)).drop("asked"), "possible")
    keys = F.filter("rule_keys", lambda k, i: F.get("maybe", i + 1))
    by_rule = probed.select("of_url", F.explode(keys).alias("rule_key")).join(F.broadcast(rule_df), "rule_key")
    by_rule = by_rule.groupBy("of_url").agg(F.min(F.struct(-F.length("rule_key"), "rule_key", "rule_verdict")).alias("r"))
    by_list = probed.where(F.get("maybe", F.lit(0)) & F.col("canon").isNotNull()).join(known, F.col("canon") == F.col("listed_key"), "left_semi")
    found = by_rule.select("of_url", F.col("r.rule_key").alias("rule"), F.col("r.rule_verdict").alias("said")).union(by_list.select("of_url", F.lit(None).cast("string"), F.lit("block")))
    found = found.groupBy("of_url").agg(F.max("rule").alias("rule"), F.max_by("said", F.col("rule").isNotNull()).alias("said"))

    rows, unpacked = packed(pages, F.col(url).alias("own_url"), without={"host", "path", "rule", "verdict"})
    joined = rows.join(found, F.col("own_url") == F.col("of_url"), "left")
    verdict = F.coalesce("said", F.lit("allow")).alias("verdict")
    return joined.select(*unpacked, host_of(F.col("own_url")).alias("host"), path_of(F.col("own_url")).alias("path"), "rule", verdict)
