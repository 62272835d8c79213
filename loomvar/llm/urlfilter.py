"""URL rules by a sort-merge range join, in DataFrame functions alone.

A host becomes its labels in reverse, each closed by a separator, so that a rule for a host and all its subdomains is one
interval of keys, and intervals nest. Where the intervals open and close is merged with the keys of the urls in one sorted
sweep, which keeps the stack of the open intervals: a running height, and for each height the rules of the interval that was
opened there last. A url finds on the stack all rules of its host and the hosts above it. Of those whose path begins the
url's path the longest wins (host and path together; ties go to the longer host, then the smaller rule text).

Rules come as a list or as a table (host, path, verdict). The sweep runs in salted lanes: every lane has all openings and
closings and a share of the urls, so one host with a third of all urls is spread evenly. Shuffle: the url columns once. The
stack has as many places as the longest rule's host has labels; that number alone is read by the driver.

Nulls: a null url, or one without `://`, has an empty host and an empty path and gets the default verdict. Repeated rows are
judged each. Rules with a null are ignored. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomvar.llm.common import ascii_lower, partitions

#: (host, path, verdict) of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
SEP, AFTER = "\x01", "\x02"
ACTIVE = "array<struct<host:string,path:string,verdict:string>>"


def split_url(url) -> tuple:
    """(host, path) columns."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    if isinstance(rules, DataFrame):
        rows = rules.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict"))).dropna()
    else:
        listed = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
        rows = spark.range(1).select(F.inline(F.from_json(F.lit(listed), ACTIVE)))
    return rows.withColumn("host", ascii_lower(F.col("host"))).distinct()


def events(rules: DataFrame) -> DataFrame:
    """(key, step, held): an interval of keys opens (1, with the host's rules) or closes (-1)."""
    hosts = rules.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).cast(ACTIVE).alias("held"))
    key = host_key("host")
    opens = hosts.select(key.alias("key"), F.lit(1).alias("step"), "held")
    return opens.unionByName(hosts.select(F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit(AFTER)).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(ACTIVE).alias("held")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", lanes: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    spark = pages.sparkSession
    lanes = lanes or 4 * partitions(spark)
    told = rule_table(spark, rules)
    deepest = told.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0  # labels of a host: the stack is no higher
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(lanes)).cast("int").alias("lane"))
    urls = urls.select("lane", host_key("host").alias("key"), F.lit(0).alias("step"), F.lit(None).cast(ACTIVE).alias("held"), "page_id", "host", "path")
    marks = events(told).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    marks = marks.select("lane", "key", "step", "held", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"))
    # at one key an interval opens before the urls of its host
    sweep = Window.partitionBy("lane").orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.union(marks).withColumn("height", F.sum("step").over(sweep))
    # the stack: its k-th place is what the last interval that opened at height k holds, while the height is k or more
    place = lambda k: F.last(F.when((F.col("step") == 1) & (F.col("height") == k), F.col("held")), ignorenulls=True).over(sweep)
    swept = swept.withColumns({f"place{k}": place(k) for k in range(1, deepest + 1)}).where("step = 0")
    none = F.array().cast(ACTIVE)
    active = F.concat(none, *(F.when(F.col("height") >= k, F.col(f"place{k}")).otherwise(none) for k in range(1, deepest + 1)))
    fits = F.filter(active, lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"]))
    text = F.transform(fits, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("size"), (-F.length(r["host"])).alias("host_size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    return swept.withColumn("best", F.array_min(text)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, strpos(url, '://') AS cut_at, url FROM pages
), rest AS (
  SELECT page_id, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest FROM cut
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT u.page_id, u.host, u.path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM urls u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY u.page_id, u.host, u.path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
"""
