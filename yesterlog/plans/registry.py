"""Registration of queries with their SQL, and the two observation views that most of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import prefix

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir: str) -> DataFrame:
    """Line items as observations: supplier and part as entities, year as season, y = returned; integer money and per cent."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("ord"), F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("kind"), (F.col("l_linenumber") % 2).alias("hand"), F.col("l_linenumber").alias("cnt"),
        F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.round(F.col("l_discount") * 100).cast("int").alias("pct"),
    )


ITEMS = """items AS (
  SELECT l_suppkey AS supplier, l_partkey AS part, l_orderkey AS ord, CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS month,
    CAST(l_returnflag = 'R' AS INT) AS y, l_linestatus AS kind, l_linenumber % 2 AS hand, l_linenumber AS cnt, CAST(l_quantity AS BIGINT) AS qty,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS INT) AS pct FROM lineitem)"""


def events(spark, sf_dir: str) -> DataFrame:
    """Events with pseudo-season (five days), y = purchase, and the user's as-of state: n events and s purchases before."""
    raw = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("season"),
        (F.col("event_type") == "purchase").cast("int").alias("y"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(1).alias("one"),
    )
    out = prefix(raw, ["user_id"], ["event_id"], ["one", "y"])
    return out.withColumnsRenamed({"one_before": "n", "y_before": "s"}).drop("one").withColumn("rate", F.try_divide("s", "n"))


EVENTS = """ev AS (
  SELECT *, CASE WHEN n > 0 THEN s / n END AS rate FROM (
    SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor((day(ts) - 1) / 5) AS INT) AS season,
      CAST(event_type = 'purchase' AS INT) AS y, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER u - 1 AS n,
      CAST(coalesce(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)))"""


def over(views: str, rest: str) -> str:
    """SQL of a query over views; rest starts with a SELECT, or with "," and further views."""
    return f"WITH {views}{rest if rest.lstrip().startswith(',') else ' ' + rest}"
