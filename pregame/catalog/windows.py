"""Window and join operators on orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.catalog.base import query, rounded, rounded_sql
from pregame.catalog.tables import read
from pregame.functions.scalars import elapsed_days
from pregame.operators import joins as J
from pregame.operators import ordered as O

KEYS, ORDER = ["o_custkey", "season"], ["o_orderdate", "o_orderkey"]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
        F.year("o_orderdate").alias("season"), F.floor("o_totalprice").cast("double").alias("x"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("gappy"),
        (F.col("o_orderstatus") == "F").cast("int").alias("flag"),
    )


ORDERS = """o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
 CAST(year(o_orderdate) AS INTEGER) AS season, floor(o_totalprice) AS x,
 CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 1000) END AS gappy,
 CAST(o_orderstatus = 'F' AS INTEGER) AS flag FROM orders)"""
W = "PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey"


@query(rounded_sql(f"""SELECT o_orderkey,
 coalesce(sum(x) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prior_total,
 coalesce(sum(gappy) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prior_gappy,
 row_number() OVER ({W}) - 1 AS prior_rows FROM o""", ["prior_total", "prior_gappy"], with_=ORDERS))
def prior_sums_and_counts(spark, folder):
    out = O.running_columns(_orders(spark, folder), KEYS, ORDER, {
        "prior_total": O.prior_sum("x"), "prior_gappy": O.prior_sum("gappy"), "prior_rows": O.prior_count(),
    })
    return rounded(out.select("o_orderkey", "prior_total", "prior_gappy", F.col("prior_rows").cast("bigint").alias("prior_rows")))


_ROLLING = {"mean_3": "avg(x)|3", "mean_5": "avg(x)|5", "mean_7": "avg(gappy)|7", "mean_10": "avg(gappy)|10",
            "mean_20": "avg(x)|20", "sum_20": "sum(x)|20", "sd_10": "stddev_samp(gappy)|10"}


@query(rounded_sql("SELECT o_orderkey, " + ", ".join(
    f"{e.split('|')[0]} OVER ({W} ROWS BETWEEN {e.split('|')[1]} PRECEDING AND 1 PRECEDING) AS {n}" for n, e in _ROLLING.items()
) + " FROM o", list(_ROLLING), with_=ORDERS))
def rolling_rows(spark, folder):
    out = O.running_columns(_orders(spark, folder), KEYS, ORDER, {
        "mean_3": O.last_rows("x", 3), "mean_5": O.last_rows("x", 5), "mean_7": O.last_rows("gappy", 7),
        "mean_10": O.last_rows("gappy", 10), "mean_20": O.last_rows("x", 20), "sum_20": O.last_rows("x", 20, F.sum),
        "sd_10": O.volatility("gappy", 10),
    })
    return rounded(out.select("o_orderkey", *_ROLLING))


@query(rounded_sql(f"""SELECT o_orderkey,
 list_sum(list_transform(v, lambda e, i: e * pow(0.85, len(v) - i))) /
 list_sum(list_transform(v, lambda e, i: pow(0.85, len(v) - i))) AS decayed_mean
 FROM (SELECT o_orderkey, list_filter(list(gappy) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
 lambda e: e IS NOT NULL) AS v FROM o)""", ["decayed_mean"], with_=ORDERS))
def decayed_means(spark, folder):
    out = O.running_columns(_orders(spark, folder), KEYS, ORDER, {"decayed_mean": O.decayed("gappy", 10)})
    return rounded(out.select("o_orderkey", "decayed_mean"))


_SPANS = (1, 3, 5, 14, 30)


@query(rounded_sql("SELECT o_orderkey, " + ", ".join(
    f"coalesce(sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL {d} DAY PRECEDING "
    f"AND INTERVAL 1 MICROSECOND PRECEDING), 0.0) AS sum_{d}d" for d in _SPANS
) + """, coalesce(sum(x) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAY PRECEDING
 AND INTERVAL 7 DAY PRECEDING), 0.0) AS week_ago FROM o""", [*[f"sum_{d}d" for d in _SPANS], "week_ago"], with_=ORDERS))
def trailing_days(spark, folder):
    spans = {f"sum_{d}d": O.last_days("x", d) for d in _SPANS} | {"week_ago": O.days_ago("x", 7)}
    out = O.trailing_time(_orders(spark, folder), ["o_custkey"], "o_orderdate", spans)
    return rounded(out.select("o_orderkey", *spans))


@query(f"""WITH {ORDERS} SELECT o_orderkey, lag(x) OVER ({W}) AS last_x,
 CAST(date_diff('day', lag(o_orderdate) OVER ({W}), o_orderdate) AS DOUBLE) AS rest_days FROM o""")
def rest_and_previous(spark, folder):
    out = O.running_columns(_orders(spark, folder), KEYS, ORDER, {
        "last_x": O.previous("x"), "last_date": O.previous("o_orderdate"),
    })
    return out.select("o_orderkey", "last_x", elapsed_days(F.col("o_orderdate"), F.col("last_date")).alias("rest_days"))


@query(f"""WITH {ORDERS}, c AS (SELECT *, CASE WHEN lag(flag) OVER ({W}) = flag THEN 0 ELSE 1 END AS changed FROM o),
 r AS (SELECT *, sum(changed) OVER ({W}) AS run FROM c)
 SELECT o_orderkey, CASE WHEN flag = 1 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS f_streak,
 CASE WHEN flag = 0 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS other_streak
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, season, run ORDER BY o_orderdate, o_orderkey) AS n FROM r)""")
def status_streaks(spark, folder):
    out = O.streaks(_orders(spark, folder), KEYS, ORDER, "flag", {1: "f_streak", 0: "other_streak"})
    return out.select("o_orderkey", "f_streak", "other_streak")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_order_per_customer(spark, folder):
    rows = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return O.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events)
 SELECT c.event_id, p.event_id AS purchase_id, p.value AS purchase_value
 FROM (SELECT * FROM e WHERE event_type = 'click') c
 ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts > p.ts""")
def clicks_after_last_purchase(spark, folder):
    e = read(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value")
    )
    out = J.asof_strict(clicks, bought, ["user_id"], "ts", ["purchase_id", "purchase_value"], "purchase_id")
    return out.select("event_id", "purchase_id", "purchase_value")


@query("""WITH lines AS (SELECT DISTINCT o_custkey, o_orderkey, o_orderdate, l_partkey % 50 AS member
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 sets AS (SELECT o_custkey, o_orderkey, o_orderdate, list(member) AS s FROM lines GROUP BY ALL),
 lagged AS (SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM sets)
 SELECT l.o_orderkey, l.member, CASE WHEN p IS NOT NULL THEN CAST(list_contains(p, l.member) AS DOUBLE) END AS returned,
 CASE WHEN p IS NOT NULL THEN CAST(len(list_filter(p, lambda e: NOT list_contains(s, e))) AS DOUBLE) END AS previous_missing
 FROM lines l JOIN lagged g ON l.o_orderkey = g.o_orderkey""")
def part_set_continuity(spark, folder):
    lines = read(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("member")).distinct()
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = J.set_continuity(rows, "o_custkey", "o_orderkey", ["o_orderdate"], "member")
    return out.select("o_orderkey", "member", "returned", "previous_missing")


@query("""WITH l AS (SELECT c_custkey, lower(replace(c_name, 'Customer#', '')) AS k, c_nationkey AS n FROM customer),
 r AS (SELECT s_suppkey, lower(replace(s_name, 'Supplier#', '')) AS k, s_nationkey AS n FROM supplier),
 m AS (SELECT c_custkey, s_suppkey FROM l JOIN r ON l.k = r.k AND l.n = r.n)
 SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM m GROUP BY c_custkey HAVING count(DISTINCT s_suppkey) = 1""")
def unique_name_matches(spark, folder):
    name = lambda c, word: F.lower(F.regexp_replace(c, word, ""))
    left = read(spark, folder, "customer").select("c_custkey", name("c_name", "Customer#").alias("k"), F.col("c_nationkey").alias("n"))
    right = read(spark, folder, "supplier").select("s_suppkey", name("s_name", "Supplier#").alias("k"), F.col("s_nationkey").alias("n"))
    return J.unique_match(left, right, ["k", "n"], "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query(rounded_sql("""SELECT s.*, s.revenue - b.revenue AS revenue_delta, s.orders - b.orders AS orders_delta
 FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS variant, sum(floor(o_totalprice)) AS revenue,
   CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY ALL) s
 LEFT JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, sum(floor(o_totalprice)) AS revenue,
   CAST(count(*) AS DOUBLE) AS orders FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL) b ON s.season = b.season""",
   ["revenue", "orders", "revenue_delta", "orders_delta"]))
def deltas_to_baseline(spark, folder):
    runs = read(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("variant")).agg(
        F.sum(F.floor("o_totalprice").cast("double")).alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders")
    )
    return rounded(J.compare_to_baseline(runs, ["season"], "variant", "5-LOW", ["revenue", "orders"]))


@query("""SELECT DISTINCT CAST(m AS VARCHAR) AS member FROM (
 SELECT l_partkey AS m FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT o_custkey FROM orders)""")
def distinct_ids_over_tables(spark, folder):
    from pregame.operators.quality import distinct_members

    return distinct_members({
        "lineitem": (read(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"]),
        "orders": (read(spark, folder, "orders"), ["o_custkey"]),
    })
