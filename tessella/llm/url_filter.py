"""URL rules by host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's. Every URL is expanded into the expressions host suffix + path
prefix that a rule could have, the expressions are equi-joined with the rules on the first eight
hex digits of their SHA-256, and a hit counts only if the full digests are equal. Of the rules
that fit, the longest (host and path together) wins; at equal length the longer host, then block.

Suffixes have at most as many labels as the longest rule host, and prefixes are as long as some rule's
path (and end in a slash where all rules of that length do); no other expression could equal a rule,
so nothing is lost, and a URL has no more of them if it is very long. The same URL is judged once. The rules are broadcast while they are at most
BROADCAST_RULES rows; beyond that both sides are dealt by hash prefix and a salt, since an
expression such as `com/` belongs to a large share of all URLs.

Edge cases: a null url and one without `://` have an empty host and path, and no rule. An empty
path matches only rules with an empty path. Only A-Z are lower-cased. Repeated rows are kept.
With an empty rule table every URL gets the default verdict; an empty table of pages gives an empty
result. Columns of pages named host, path, rule or verdict are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _expressions(labels: int, slashes: list[int], others: list[int]) -> Column:
    """All host-suffix + path-prefix expressions of the columns host and path that a rule could have: `slashes`
    and `others` are the lengths of the rules' paths that end in a slash and that do not."""
    parts = F.split("host", r"\.")
    tail = F.when(F.size(parts) > labels, F.slice(parts, F.size(parts) - labels + 1, labels)).otherwise(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda k: F.array_join(F.slice(tail, k, F.size(tail)), "."))
    lengths = lambda of: F.array(*[F.lit(n) for n in of]).cast("array<int>")
    cuts = F.array_union(
        F.filter(lengths(others), lambda n: n <= F.char_length("path")),
        F.filter(lengths(slashes), lambda n: F.substring(F.col("path"), n, F.lit(1)) == "/"),
    )
    paths = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with host, path, rule (host + path of the winning rule, or null) and verdict."""
    rules = rules.where("host IS NOT NULL AND host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.when(F.col("path").endswith("/"), F.char_length("path")))).alias("slashes"),
        F.sort_array(F.collect_set(F.when(~F.col("path").endswith("/"), F.char_length("path")))).alias("others"),
    ).first()
    named = pages.withColumns({"host": url_host(pages[url]), "path": url_path(pages[url])}) if url in pages.columns else pages
    if not shape.n:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = F.sha2(F.col("expression"), 256)
    table = rules.select(F.concat("host", "path").alias("expression"), F.char_length("host").alias("host_chars"), F.col("verdict").alias("rule_verdict"))
    table = table.select("*", digest.alias("rule_digest"), F.substring(digest, 1, 8).alias("prefix")).withColumnRenamed("expression", "rule")
    urls = named.where("host <> ''").select("host", "path").distinct()
    probes = urls.select("host", "path", F.explode(_expressions(shape.labels, list(shape.slashes), list(shape.others))).alias("expression"))
    probes = probes.select("host", "path", digest.alias("digest"), F.substring(digest, 1, 8).alias("prefix"))
    if shape.n <= broadcast_rules:
        met = probes.join(F.broadcast(table), "prefix")
    else:
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        met = probes.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["prefix", "salt"])
    met = met.where("digest = rule_digest")
    order = F.struct(F.char_length("rule"), F.col("host_chars"), (F.col("rule_verdict") == "block").cast("int"), F.col("rule"), F.col("rule_verdict"))
    best = met.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    left = [c for c in named.columns if c not in ("rule", "verdict")]
    out = named.select(*left).join(best, ["host", "path"], "left")
    return out.select(*left, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
