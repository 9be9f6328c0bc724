"""URL filters: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules in an equi-join on
short hash prefixes; full digests confirm a meeting, and the longest rule that fits decides.

All native. Expressions are no longer than the rules need: the most labels and the deepest path of any rule bound them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, verdict): a rule fits its host and all subdomains, if the URL's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RULE_SCHEMA = T.StructType([T.StructField("rule_host", T.StringType()), T.StructField("rule_path", T.StringType()), T.StructField("rule_verdict", T.StringType())])
#: Rows of rules up to which their hashes are sent to every executor: below 20 MB.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end; A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def folder(path: Column) -> Column:
    """Up to the last slash, which it includes; empty without one."""
    return F.regexp_extract(path, r"^(?s:.*/)?", 0)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def short_hash(expression: Column) -> Column:
    """The first four bytes of the digest, as hexadecimal digits."""
    return F.substring(F.sha2(expression, 256), 1, 8)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """key, host, path, rule (its host and path, else null) and verdict (the rule's, else otherwise), for each row of pages.

    The longest rule wins (its host and path together, then its host); of equal rules with both verdicts, block. Repeated
    rows come back as often as they came in. Rules with a null or empty host or a null path fit nothing."""
    rules = rules.filter((F.col("rule_host") != "") & F.col("rule_path").isNotNull()).withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max(F.col("rule_verdict") == "block").alias("_block"))
    rules = rules.withColumn("_rule_digest", F.sha2(F.concat("rule_host", F.lit(" "), folder(F.col("rule_path"))), 256)).withColumn("_short", F.substring("_rule_digest", 1, 8))
    n, most_labels, most_depth, least_depth = rules.agg(F.count("*"), F.max(labels(F.col("rule_host"))), F.max(depth(F.col("rule_path"))), F.min(depth(F.col("rule_path")))).first()
    plain = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    parts = plain.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    names, folders = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(most_labels or 1))), lambda k: F.array_join(F.slice(names, -k, k), "."))
    deepest = F.least(depth(F.col("path")), F.lit(most_depth or 0))
    prefixes = F.when(
        deepest >= F.lit(least_depth or 0),
        F.transform(F.sequence(F.lit(least_depth or 0), deepest), lambda d: F.when(d == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, 1, d), "/"), F.lit("/")))),
    ).otherwise(F.array().cast("array<string>"))
    expressions = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(" "), p)))))
    rows = parts.select("_key", "_url", "host", "path", F.posexplode_outer(F.array_distinct(expressions)).alias("_at", "_expression"))
    rows = rows.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_short", F.substring("_digest", 1, 8))
    small = n <= BROADCAST_RULES
    met = rows.join(F.broadcast(rules) if small else rules.hint("merge"), "_short", "left")
    fits = (F.col("_digest") == F.col("_rule_digest")) & F.startswith("path", F.col("rule_path"))
    name = F.concat("rule_host", "rule_path")
    rank = F.when(fits, F.struct(F.length(name), F.length("rule_host"), name.alias("rule"), F.col("_block").alias("block")))
    # A row may meet several rules; it is counted where its first expression met the first of them.
    first = F.when(F.coalesce("_at", F.lit(0)) == 0, F.lit(1))
    per_page = met.groupBy("_key", "_url", "_at").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("_best"), F.count("*").alias("_n"), F.count_distinct("rule_host", "rule_path").alias("_k"))
    per_page = per_page.groupBy("_key", "_url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("_best").alias("_best"), F.max(F.when(first == 1, F.col("_n") / F.greatest("_k", F.lit(1)))).cast("int").alias("_copies"))
    one = per_page.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    verdict = F.when(F.col("_best").isNull(), F.lit(otherwise)).when(F.col("_best.block"), F.lit("block")).otherwise(F.lit("allow"))
    return one.select(F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))
