"""URL rules as nested intervals, met by one sorted sweep.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. The canonical key
of a rule is its host with the labels reversed, each followed by a dot, then its path; all keys with that prefix form
an interval, and two intervals are nested or apart. A url has one key for its host and one for each parent domain,
each followed by its path, so that subdomains meet their domain's paths as well.

Interval borders and keys are sorted together by range. The depth of the stack of open intervals is a running count
of borders; the rule on top at depth k is the last one opened at depth k. What a range needs from those before it
(the depth, and the last rule opened at each depth) is a few numbers per range. Equal keys are spread by a hash, so a
host or url that a third of all rows name may span many ranges. Distinct (host, path) pairs are swept, not rows.

Among the rules that fit, the longest (host and path together) wins, then the longer host, then the greater string.
Of rules with the same host and path, ``block`` wins over ``allow``.

Defined cases: a null url or one without ``://`` has an empty host and path; an empty host fits no rule; without a
fitting rule the verdict is ``default``; repeated rows are judged one by one; no rules or an empty table give the
default for every row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposight.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<host:string,path:string,verdict:string>"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _bytes(key: Column) -> Column:
    return F.encode(key, "UTF-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _reversed(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def best_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``host, path`` → those that some rule fits, with ``rule, verdict`` of the winner."""
    usable = rules.where("host <> '' AND (path = '' OR startswith(path, '/'))")
    nested = usable.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    lower = _bytes(F.concat(_reversed(_labels(F.col("host"))), F.col("path")))
    rule = F.struct("host", "path", "verdict").cast(RULE)
    nothing = F.lit(None).cast("string")
    # 0xFF is in no UTF-8 text: it sorts after every key with the prefix.
    border = F.explode(F.array(
        F.struct(lower.alias("key"), F.lit(1).alias("step")),
        F.struct(F.concat(lower, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step")),
    ))
    borders = nested.select(border.alias("b"), rule.alias("rule")).select(
        "b.key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("spread"), "b.step", "rule",
        nothing.alias("host"), nothing.alias("path"),
    )
    labels = _labels(F.col("host"))
    level = F.explode(F.sequence(F.lit(1), F.size(labels)))
    keys = pairs.where("host <> ''").select("host", "path", labels.alias("labels"), level.alias("level"))
    keys = keys.select(
        _bytes(F.concat(_reversed(F.slice("labels", 1, F.col("level"))), F.col("path"))).alias("key"),
        F.lit(1).alias("kind"), F.xxhash64("host", "path").alias("spread"), F.lit(0).alias("step"),
        F.lit(None).cast(RULE).alias("rule"), "host", "path",
    )
    ranged = borders.unionByName(keys).repartitionByRange("key", "kind", "spread")
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "url-ranges")

    # Depth after each border. Depths before a range come from one sum per range.
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    depths = ranged.groupBy("part").agg(F.sum("step").alias("net"))
    depths = depths.select("part", F.coalesce(F.sum("net").over(by_part), F.lit(0)).alias("open"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("within", F.sum("step").over(sweep)).join(depths, "part")
    swept = swept.withColumn("depth", F.col("within") + F.col("open")).where("depth > 0 OR step <> 0")

    # Top of the stack: the last rule opened at this depth, in this range or one before it.
    at_depth = Window.partitionBy("part", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("step") == 1, F.col("rule"))
    swept = swept.withColumn("top", F.last(opened, ignorenulls=True).over(at_depth))
    swept = materialise(swept.select("part", "depth", "key", "kind", "step", "rule", "top", "host", "path"), "url-sweep")
    tops = swept.where("step = 1").groupBy("part", "depth").agg(F.max_by("rule", "key").alias("rule"))
    asked = swept.where("kind = 1 AND top IS NULL").select("part", "depth").distinct()
    marks = tops.unionByName(asked.withColumn("rule", F.lit(None).cast(RULE)))
    marks = marks.groupBy("part", "depth").agg(F.max("rule").alias("rule"))
    before = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("part", "depth", F.last("rule", ignorenulls=True).over(before).alias("carried"))
    met = swept.where("kind = 1").join(carried, ["part", "depth"], "left")
    met = met.select("host", "path", F.coalesce("top", "carried").alias("rule"))

    text = F.concat("rule.host", "rule.path")
    best = F.max(F.struct(F.length(text).alias("n"), F.length("rule.host").alias("m"), text.alias("rule"), F.col("rule.verdict").alias("verdict")))
    return met.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    best = best_rules(rows.select("host", "path").distinct(), rules)
    verdict = F.coalesce("verdict", F.lit(default))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
