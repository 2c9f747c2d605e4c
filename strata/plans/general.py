"""General relational queries: grouping sets, unpivot, frames, sets, dates, JSON, sketches, event windows, SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.rounds import shared_folder
from strata.plans.registry import query, t
from strata.streaming.cache import cached, with_store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """SQL text over the tables of a folder, as temporary views: views, CTEs, subqueries and recursion are Spark's own.

    Recursion ends where it gives no more rows: Spark's limits of a million rows and a hundred levels are lifted for the session, as
    the rows grow with the tables.
    """
    for limit in ("RowLimit", "LevelLimit"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}", "-1")
    for name in TABLES:
        t(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


_YEAR = "CAST(year(o_orderdate) AS INT)"
_ROLLUP = f"SELECT o_orderstatus, {_YEAR} AS y, count(*) AS n, CAST(grouping(o_orderstatus) + grouping({_YEAR}) AS INT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, {_YEAR})"


@query("rollup_orders", _ROLLUP)
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"))
    return o.rollup("o_orderstatus", "y").agg(F.count(F.lit(1)).alias("n"), (F.grouping("o_orderstatus").cast("int") + F.grouping("y").cast("int")).alias("level"))


@query("grouping_sets_orders", f"SELECT o_orderpriority, {_YEAR} AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ({_YEAR}), ())")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"))
    return o.groupingSets([["o_orderpriority"], ["y"], []], "o_orderpriority", "y").agg(F.count(F.lit(1)).alias("n"))


@query("unpivot_items", "UNPIVOT (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem) ON quantity, tax, discount INTO NAME what VALUE amount")
def _(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    # Numbers over all items: counted per range of keys, then over the ranges.
    items = t(spark, sf, "lineitem").withColumn("part", F.floor(F.col("l_orderkey") / 4096))
    before = items.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rows = items.withColumn("n", n).join(before, "part").select((F.col("n") + F.col("before")).alias("i"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return rows.unpivot("i", ["quantity", "tax", "discount"], "what", "amount")


@query("range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def _(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return t(spark, sf, "part").select("p_partkey", F.count(F.lit(1)).over(w).alias("near"))


@query("groups_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM part")
def _(spark, sf):
    w = Window.partitionBy("p_brand")
    ranked = t(spark, sf, "part").withColumn("g", F.dense_rank().over(w.orderBy("p_size")))
    return ranked.select("p_partkey", F.sum("p_size").over(w.orderBy("g").rangeBetween(-1, 0)).alias("total"))


@query("quantile_ranks", "SELECT p_partkey, ntile(4) OVER w AS quarter, percent_rank() OVER w AS share, cume_dist() OVER w AS upto FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def _(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return t(spark, sf, "part").select("p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("upto"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("top_three_per_customer", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def _(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@query("customers_and_orders", "SELECT 'both' AS who, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'idle', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, sf):
    c, o = t(spark, sf, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).select(F.lit("both").alias("who"), "k").unionByName(c.exceptAll(o).distinct().select(F.lit("idle").alias("who"), "k"))


@query(
    "date_parts",
    """
    SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, dayofyear(o_orderdate)::INT AS d, (dayofweek(o_orderdate) + 1)::INT AS weekday, strftime(o_orderdate, '%Y-%m-%d') AS shown,
           strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_of_month, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_of_month, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days, quarter(o_orderdate)::INT AS q FROM orders""",
)
def _(spark, sf):
    d = F.to_date("o_orderdate")
    shown = lambda x: F.date_format(x, "yyyy-MM-dd")
    return t(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofyear(d).alias("d"), F.dayofweek(d).alias("weekday"), shown(d).alias("shown"), shown(F.trunc(d, "month")).alias("first_of_month"), shown(F.last_day(d)).alias("last_of_month"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("days"), F.quarter(d).alias("q"))


@query("json_parsed", "SELECT event_id, (props->>'k') AS k, json_valid(props) AS valid, to_json({'event': event_id, 'type': event_type}) AS packed FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k string")
    return t(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("packed"))


@query("distinct_sketch", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY 1")
def _(spark, sf):
    """Sketches of each status, united by priority; within 5 % of the exact count."""
    o = t(spark, sf, "orders")
    parts = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.hll_sketch_agg("o_custkey", 14).alias("s"))
    about = parts.groupBy("o_orderpriority").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("about"))
    exact = o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"))
    return exact.join(about, "o_orderpriority").select("o_orderpriority", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query(
    "sliding_counts",
    """
    SELECT event_type, epoch(start_at)::BIGINT AS start_at, count(*) AS n FROM (
        SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start_at FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")
    return t(spark, sf, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_seconds("w.start").alias("start_at"), "n")


@query(
    "session_counts",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_at, count(*) AS n FROM s GROUP BY user_id, session""",
)
def _(spark, sf):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return t(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("w.start").alias("start_at"), "n")


_TEXT = """
    WITH busy AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 1)
    SELECT c.c_custkey, b.n, b.top, (SELECT max(n_name) FROM nation WHERE n_nationkey = c.c_nationkey) AS nation
    FROM customer c JOIN busy b ON b.o_custkey = c.c_custkey
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
      AND c.c_acctbal > (SELECT avg(c_acctbal) FROM customer)"""


@query("sql_text", _TEXT)
def _(spark, sf):
    return sql(spark, sf, _TEXT)


_CHAIN = """
    WITH RECURSIVE up(id, here, depth) AS (
        SELECT event_id, event_id, 0 FROM events
        UNION ALL SELECT id, {half}, depth + 1 FROM up WHERE here > 0)
    SELECT id AS event_id, max(depth) AS depth FROM up GROUP BY id"""


@query("sql_recursion", _CHAIN.format(half="here // 2"))
def _(spark, sf):
    return sql(spark, sf, _CHAIN.format(half="here div 2"))


@query("ordered_lists", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, round(median(o_totalprice), 4) AS middle, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"), F.round(F.median("o_totalprice"), 4).alias("middle"), F.count_distinct("o_orderstatus").alias("kinds"))


@query("left_full_semi_anti", "SELECT coalesce(c_nationkey, s_nationkey)::INT AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey % 2 > 0 GROUP BY 1) ON c_nationkey = s_nationkey")
def _(spark, sf):
    c = t(spark, sf, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    s = t(spark, sf, "supplier").where("s_nationkey % 2 > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, "nation", "full")


@query(
    "cache_stream",
    """
    WITH r AS (SELECT user_id AS lineage, event_id, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    p AS (SELECT *, lag(i) OVER (PARTITION BY lineage, key ORDER BY i) AS before FROM r)
    SELECT lineage, event_id AS seq, key, coalesce((SELECT count(DISTINCT b.key) FROM p b WHERE b.lineage = a.lineage AND b.i > a.before AND b.i < a.i) < 3, false) AND before IS NOT NULL AS hit, i AS version FROM p a""",
)
def _(spark, sf):
    """Every user's events as requests of a cache of three kinds, least recently used first out, kept as a stream's state: a request hits if fewer than three others came since its last."""
    with_store(spark)
    found = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    events = spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern: a stream takes no path of one file
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.array(seconds, F.col("event_id").cast("long"))
    requests = events.select(F.col("user_id").alias("lineage"), F.col("event_type").alias("key"), F.lit(1).cast("long").alias("size"), order.alias("seq"))
    stream = cached(requests, 3).writeStream.format("parquet").option("path", f"{found}/rows").option("checkpointLocation", f"{found}/state").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{found}/rows").select("lineage", F.col("seq")[1].alias("seq"), "key", "hit", "version")
