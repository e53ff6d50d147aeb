"""Sources and sinks as round trips over the item and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.blend import DRAW_SQL, PRIME
from ..sources import arrays, io
from .registry import EVENTS, ITEMS, events, items, over, query, table


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, d):
    """Written as CSV in ascending ranges and read with a schema; prices are kept as 32-bit floats."""
    path = io.scratch(spark, "csv")
    io.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path, "o_orderkey")
    back = io.read_csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", floats=True)
    return back.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def head_rows(spark, d):
    """The first rows by a unique key: a top-k, never a bare limit."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@query("season_prefix_scan", over(ITEMS, "SELECT season, count(*) AS n, sum(cents)::BIGINT AS cents FROM items WHERE season <= 1997 GROUP BY season"))
def season_prefix_scan(spark, d):
    """Written in folders by season; only the prefix's folders are read again."""
    path = io.scratch(spark, "seasons")
    items(spark, d).select("season", "cents").repartition("season").write.partitionBy("season").parquet(path)
    return io.prefix_seasons(spark.read.parquet(path), "season", 1997).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("json_artifact_scan", over(ITEMS, "SELECT supplier, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY supplier"))
def json_artifact_scan(spark, d):
    """A frozen table kept as JSON records."""
    path = io.scratch(spark, "json")
    items(spark, d).groupBy("supplier").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")).write.json(path)
    return spark.read.schema("supplier long, total long, n long").json(path)


@query("bundle_round_trip", over(ITEMS, "SELECT hand, cnt, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY hand, cnt"))
def bundle_round_trip(spark, d):
    """Tables stored with a manifest and verified when they are loaded."""
    path = io.scratch(spark, "bundle")
    io.save_bundle(spark, path, {"rates": items(spark, d).groupBy("hand", "cnt").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))}, {"prior": 0.2})
    return io.load_bundle(spark, path)[0]["rates"]


@query("array_round_trip", over(ITEMS, "SELECT supplier, count(*) AS n, sum(y)::BIGINT AS total FROM items GROUP BY supplier"))
def array_round_trip(spark, d):
    """Written as array files, a file for each task, and read in ranges of rows; the member that isn't asked for is never touched."""
    path = io.scratch(spark, "arrays")
    rates = items(spark, d).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.avg("y").alias("rate"))
    arrays.register(spark)
    rates.write.format("arrays").mode("append").save(path)
    return spark.read.format("arrays").option("members", "supplier,n,total").option("rowsPerPartition", 10_000).load(path).drop("row")


@query("cache_read_through", over(EVENTS, "SELECT user_id, count(*) AS n, true AS reused FROM ev GROUP BY user_id"))
def cache_read_through(spark, d):
    """The second call finds the rows unchanged and reads what the first wrote."""
    path, source = io.scratch(spark, "cache"), events(spark, d).select("user_id", "event_id")
    make = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    io.cached(spark, path, source, make)
    rows, reused = io.cached(spark, path, source, make)
    return rows.withColumn("reused", F.lit(reused))


@query("report_lock", over(ITEMS, "SELECT count(*) AS n, sum(cents)::BIGINT AS cents FROM items"))
def report_lock(spark, d):
    """A result that is stored once and must be reproduced."""
    path, row = io.scratch(spark, "lock"), items(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).first().asDict()
    io.write_once(spark, path, row)
    return spark.createDataFrame([tuple(io.write_once(spark, path, row)[k] for k in ("n", "cents"))], "n long, cents long")


@query("load_generator", f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n, min(c_acctbal) OVER () AS low, max(c_acctbal) OVER () AS high FROM customer), r AS (SELECT unnest(range(3 * (SELECT count(*) FROM customer))) AS id)
  SELECT id AS c_custkey, c_nationkey, c_mktsegment, round(low + {DRAW_SQL.format(k="id", d="42")} / {PRIME} * (high - low), 6) AS c_acctbal FROM r JOIN c ON id % n = i""")
def load_generator(spark, d):
    """Three times the customers, with balances drawn anew and nation and segment kept together."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return io.generate_load(c, "c_custkey", 3 * c.count(), ["c_nationkey", "c_mktsegment"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("table_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier", "customer", "part", "orders")))
def table_inventory(spark, d):
    """Rows of each table, from Parquet footers alone."""
    out = None
    for t in ("region", "nation", "supplier", "customer", "part", "orders"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
