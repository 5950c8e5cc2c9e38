"""Allow and block rules for urls by a sort-merge range join over reversed hosts.

A host is turned into its labels in reverse, each closed by a dot: ``a.example.org`` is ``org.example.a.``. All hosts
under a rule's host then begin with the rule's key, so a rule is an interval of the sorted keys, and intervals are
nested or apart. One sweep over rules and distinct hosts in key order carries the stack of nested rules at the last
rule passed; a host drops from that stack what does not begin it. Paths are handled by a second sweep of the same
kind: for each rule host left on the stack, the path prefixes of its rules are intervals again. No Python runs.

The sweep is cut by ranges of keys, so it needs no single task: rows are range-partitioned and written, and each
range starts with the stack that the ranges before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import ascii_lower
from alertsieve.session import materialise

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _stacks(rules: DataFrame, value: str) -> DataFrame:
    """For each rule key of a group: the nested rules at it, outermost first, as (key, value).

    A rule's enclosing rules are those whose key begins its own. They are found by the prefixes of its key, which costs
    the length of the keys and not the number of rules.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))
    parts = rules.select("grp", F.col("key").alias("of"), F.explode(prefixes).alias("key"))
    outer = parts.join(rules, ["grp", "key"])
    return outer.groupBy("grp", F.col("of").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.char_length("key").alias("n"), "key", value))).alias("stack"))


def sweep(points: DataFrame, rules: DataFrame, value: str, carried: list[str]) -> DataFrame:
    """``points`` (grp, key, ...) with ``active``: the rules (n, key, value) of their group whose key begins theirs, outermost first.

    Both are distinct by grp and key. ``carried`` names further columns of the points.
    """
    stacks = _stacks(rules, value)
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    opens = stacks.select("grp", "key", F.lit(0).alias("kind"), "stack", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried])
    hits = points.select("grp", "key", F.lit(1).alias("kind"), none.alias("stack"), *carried)
    events = opens.unionByName(hits).repartitionByRange("grp", "key", "kind").withColumn("range", F.spark_partition_id())
    events = materialise(events)  # the ranges must not change from here on
    last = events.where("kind = 0").groupBy("range").agg(F.max_by(F.struct("grp", "stack"), F.struct("grp", "key")).alias("last"))
    ranges = events.select("range").distinct().join(last, "range", "left")  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range", F.last("last", True).over(before).alias("start"))
    starts = starts.where("start IS NOT NULL").select(
        F.col("start.grp").alias("grp"), F.lit("").alias("key"), F.lit(-1).alias("kind"), F.col("start.stack").alias("stack"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried], "range"
    )
    order = Window.partitionBy("range").orderBy(F.when(F.col("kind") < 0, 0).otherwise(1), "grp", "key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("stack").isNotNull(), F.struct("grp", "stack")), True).over(order)
    swept = events.unionByName(starts).withColumn("at", at).where("kind = 1")
    active = F.when(F.col("at.grp") == F.col("grp"), F.filter(F.col("at.stack"), lambda r: F.startswith(F.col("key"), r["key"])))
    empty = F.array().cast(stacks.schema["stack"].dataType)
    return swept.select("grp", "key", F.coalesce(active, empty).alias("active"), *carried)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (host and path of the rule that fits, or null), verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all hosts below it if the path begins with its own;
    the longest (host and path together, then host, then in order of text) wins, and of equal rules ``block``. Urls
    that no rule fits get ``default``. Null urls and those without ``://`` have empty host and path, which only a rule
    of empty host and path fits. Repeated rows are kept; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is the larger word
    hosts = rules.groupBy("host").agg(F.lit("").alias("grp")).select("grp", host_key(F.col("host")).alias("key"), "host")
    urls = rows.groupBy("host", "path").agg(F.lit(1).alias("_one")).select("host", "path")
    found = sweep(urls.select("host").distinct().select(F.lit("").alias("grp"), host_key(F.col("host")).alias("key"), "host"), hosts, "host", ["host"])
    # each active rule host of a host, then the paths below it
    fits = found.select("host", F.explode("active").alias("r")).where((F.col("r.host") != "") | (F.col("host") == "")).select("host", F.col("r.host").alias("rule_host"))
    wanted = urls.join(fits, "host").select(F.col("rule_host").alias("grp"), F.col("path").alias("key")).distinct()
    by_path = rules.select(F.col("host").alias("grp"), F.col("path").alias("key"), F.struct("path", "verdict").alias("rule"))
    paths = sweep(wanted, by_path, "rule", []).select(F.col("grp").alias("rule_host"), F.col("key").alias("path"), F.try_element_at("active", F.lit(-1))["rule"].alias("rule")).where("rule IS NOT NULL")
    scored = urls.join(fits, "host").join(paths, ["rule_host", "path"]).select(
        "host", "path", F.struct((F.char_length("rule_host") + F.char_length("rule.path")).alias("n"), F.char_length("rule_host").alias("h"), "rule_host", F.col("rule.path").alias("rule_path"), F.col("rule.verdict").alias("verdict")).alias("best")
    )
    best = scored.groupBy("host", "path").agg(F.max("best").alias("best"))
    done = rows.join(best, ["host", "path"], "left")
    return done.select(F.col("_id").alias(id_col), "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
