"""URL filters as a sort-merge range join.

Hosts and rules get the same canonical key, the host's labels reversed ("org.example."), so that a rule's host and all its
subdomains are one interval of the key order and rule intervals are either nested or disjoint. Distinct hosts and rules are
cut into key ranges; a rule is copied to each range that its interval meets; inside a range one sorted sweep keeps the
stack of the rules whose interval is open. Urls are never swept themselves: a host with a third of all urls is one row.

Defined results: a url that is null or lacks "://" has an empty host and path, which no rule fits. Repeated urls and rows
are judged alike. Of two equal rules the block rule counts. There are as many ranges as four times the shuffle partitions, and at most BOUND_SAMPLE. "Longest" compares the host first, then the path.
An empty table gives an empty result, an empty rule list the default verdict. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, lower_ascii, parallelism

#: host, path, action
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Keys sampled to choose range bounds: the only thing gathered by the driver, of this size whatever the input.
BOUND_SAMPLE = 4096


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot; a subdomain's key starts with its parent's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (cell, key, kind); rules (kind 0) come before hosts (kind 1) of the same key."""
    cell, stack = None, []
    for frame in frames:
        out = []
        for c, key, kind, host, path, action in zip(frame.cell, frame.key, frame.kind, frame.host, frame.path, frame.action, strict=True):
            if c != cell:
                cell, stack = c, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append({"host": host, "path": path, "action": action})
            elif stack:
                out.append((host, [r for _, rules in reversed(stack) for r in sorted(rules, key=lambda r: (-len(r["path"]), r["path"], r["action"] != "block"))]))
        yield pd.DataFrame(out, columns=["host", "active"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """pages: id, url; rules: host, path, action. Returns id, host, path, rule, verdict."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    hosts = urls.filter("host <> ''").select("host").distinct().select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit("").alias("path"), F.lit("").alias("action"))
    marks = rules.select(host_key(lower_ascii(F.col("host"))).alias("key"), F.lit(0).alias("kind"), lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("action"))
    sample = sorted(r.key for r in hosts.select("key").orderBy(F.xxhash64("key"), "key").limit(BOUND_SAMPLE).collect())
    step = max(1, len(sample) // (4 * parallelism(spark)))  # some ranges for each task
    bounds = F.array(*[F.lit(k) for k in sample[step::step]]) if sample[step::step] else F.expr("array()")
    cell = lambda key: F.size(F.filter(bounds, lambda b: b <= key))
    hosts = hosts.withColumn("cell", cell(F.col("key")))
    marks = marks.withColumn("cell", F.explode(F.sequence(cell(F.col("key")), cell(F.concat("key", F.lit("\U0010ffff"))))))
    ordered = hosts.unionByName(marks).repartition("cell").sortWithinPartitions("cell", "key", "kind")
    active = ordered.mapInPandas(_sweep, "host string, active array<struct<host:string,path:string,action:string>>")
    active = active.withColumnRenamed("host", "swept_host")
    hit = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.when(F.size("active") > 0, F.try_element_at(hit, F.lit(1)))
    return urls.join(active, F.col("host") == F.col("swept_host"), "left").withColumn("best", best).select(
        F.col(id_column), "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, act) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
m AS (
  SELECT u.*, rh || rp AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM m WHERE k = 1
"""
