"""URL rules by hashed expressions.

Every URL is expanded into host-suffix x path-prefix expressions. Expressions
meet the rules in an equi-join on a short prefix of their SHA-256 digest; the
full digest confirms a meeting, and rule precedence picks the winner.

Path prefixes are plain string prefixes ("/en/1" fits "/en/12"), so the only
prefix lengths worth expanding are the distinct path lengths of the rules; and of
the host only the suffixes with as many labels as some rule's host has. A rule set
of B bytes has at most sqrt(2 B) distinct lengths or label counts, so both lists
are short whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, verdict string"
HASH_PREFIX_HEX = 8         # 4 bytes of the digest are the join key
BROADCAST_BYTES = 16 << 20  # hosts, paths and digests of rules that may be broadcast

# FIXED VALUES: the rules of the contract.
CONTRACT_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rules_frame(spark: SparkSession, rules=CONTRACT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def expression_digest(host: Column, path: Column) -> Column:
    # a host never contains '/', and '\n' keeps (host, path) pairs apart
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def numbers(values: list[int]) -> Column:
    """A constant array of whole numbers, also of very many."""
    return F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<int>") if values else F.array().cast("array<int>")


def host_suffixes(host: Column, labels: Column) -> Column:
    """The host's last n labels for every n of ``labels`` that it has; [] for an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(labels, lambda n: n <= n_labels(host)), lambda n: F.call_function("substring_index", host, F.lit("."), -n)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The distinct URLs of ``pages`` that a rule fits: (url, rule, verdict).

    The longest rule (host + path) wins; equal lengths: the longer host, then
    block before allow. Null URLs and URLs without ``://`` have an empty host
    and fit no rule. Repeated URLs are judged once. Rules with a null part are
    ignored; repeated rules act as one. URLs of any length and with any number of
    labels cost time in proportion to their length and the rules' distinct lengths
    and label counts. An empty rule set or an empty page table gives an empty result.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    shapes = rules.agg(F.collect_set(F.length("r_path")), F.collect_set(n_labels(F.col("r_host"))),
                       F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 100), F.lit(0))).first()
    digests = rules.withColumn("r_digest", expression_digest(F.col("r_host"), F.col("r_path"))) \
                   .withColumn("r_key", F.substring("r_digest", 1, HASH_PREFIX_HEX))
    if shapes[2] <= BROADCAST_BYTES:
        digests = F.broadcast(digests)
    urls = pages.select(F.col(url).alias("url")).where(F.col("url").contains("://")).distinct()
    urls = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    prefixes = F.transform(F.filter(numbers(shapes[0]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expr = (urls.select("url", F.explode(host_suffixes(F.col("host"), numbers(shapes[1]))).alias("suffix"), prefixes.alias("prefixes"))
            .select("url", "suffix", F.explode("prefixes").alias("prefix"))
            .withColumn("digest", expression_digest(F.col("suffix"), F.col("prefix")))
            .withColumn("key", F.substring("digest", 1, HASH_PREFIX_HEX)))
    met = expr.join(digests, expr["key"] == F.col("r_key")).where(F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), (F.col("r_verdict") == "block"))
    return met.groupBy("url").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("w")
    ).select("url", "w.rule", "w.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``; rows that no
    rule fits get a null rule and the ``default`` verdict. A URL held by very
    many rows is a hot join key; adaptive execution splits it."""
    hits = judge_urls(pages, rules, url, default).withColumnRenamed("url", "hit_url")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    return rows.join(hits, F.col("url") == F.col("hit_url"), "left").select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
