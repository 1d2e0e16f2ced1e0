"""Relational coverage beyond the decision tables: grouped summaries, cubes, ranges, windows and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def r01_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 20")
def r02_top_customers(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(20)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def r03_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def r04_revenue_by_nation(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t02_hourly_events(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY ALL""")
def t07_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("ts").over(w))
    new = F.when(F.col("ts") - F.col("prev") <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def a36_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ntile(4) OVER (PARTITION BY event_type ORDER BY value, event_id) AS quarter, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS place FROM events")
def w15_window_analytics(spark, d):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return table(spark, d, "events").select("event_id", F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.cume_dist().over(Window.partitionBy("event_type").orderBy("value")), 6).alias("place"))


@query("SELECT e.event_id, max(o.ts) AS before FROM events e JOIN events o ON e.user_id = o.user_id AND o.event_type = 'purchase' AND o.ts <= e.ts AND e.event_type = 'view' GROUP BY e.event_id")
def j24_as_of(spark, d):
    """For each view the user's last purchase before it: one sort per user over both streams instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "view")
    e = table(spark, d, "events").where("event_type IN ('purchase', 'view')")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("before", last).where("event_type = 'view' AND before IS NOT NULL").select("event_id", "before")


QUERIES = Q
