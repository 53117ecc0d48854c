"""Every window operator, for chunks and buckets of any size, against a direct pandas loop."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pregame.operators import ordered as o


def _rows(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        ts = datetime(2024, 4, 1) + timedelta(hours=12 * rng.randrange(60))
        rows.append((key, ts, f"g{i:03d}", rng.choice([None, 1.0, 2.0, 5.0]), rng.randrange(2)))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), "k string, ts timestamp, id string, x double, home int")


@pytest.fixture(scope="module")
def expected():
    pdf = pd.DataFrame(_rows(), columns=["k", "ts", "id", "x", "home"])
    pdf["k"] = pdf["k"].fillna("<null>")
    out = {}
    for _, g in pdf.groupby("k"):
        g = g.sort_values(["ts", "id"]).reset_index(drop=True)
        run = 0
        for i, row in g.iterrows():
            before = g.iloc[:i]
            known = before.tail(4)["x"].dropna().to_numpy()
            weights = 0.85 ** np.arange(len(known) - 1, -1, -1)
            run = run + 1 if i and g.home[i - 1] == row.home else 1
            span = before[(before.ts >= row.ts - timedelta(days=3)) & (before.ts < row.ts)]
            out[row.id] = dict(
                total=before.x.sum(),
                n=float(i),
                avg=before.tail(4).x.mean(),
                sd=before.tail(4).x.std(),
                dec=np.average(known, weights=weights) if len(known) else np.nan,
                prev=before.x.iloc[-1] if i else np.nan,
                last=before.x.dropna().iloc[-1] if len(before.x.dropna()) else np.nan,
                span=span.x.sum(),
                ago=before[before.ts == row.ts - timedelta(days=1)].x.sum(),
                home_run=float(run) if row.home else 0.0,
                away_run=0.0 if row.home else float(run),
            )
    return out


HOUR = 3_600_000_000


@pytest.mark.parametrize("group_rows, width", [(None, None), (1000, 24 * HOUR), (7, 10 * HOUR), (3, 24 * 28 * HOUR), (1, 7 * HOUR)])
def test_windows_match_loop_for_any_chunk_and_bucket(frame, expected, group_rows, width):
    specs = {
        "total": o.prior_sum("x"),
        "n": o.prior_count(),
        "avg": o.last_rows("x", 4),
        "sd": o.volatility("x", 4),
        "dec": o.decayed("x", 4),
        "prev": o.previous("x"),
        "last": o.prior_last("x"),
    }
    out = o.running_columns(frame, ["k"], ["ts", "id"], specs, group_rows, width)
    out = o.trailing_time(out, ["k"], "ts", {"span": o.last_days("x", 3), "ago": o.days_ago("x", 1)}, **({"width": width} if width else {}))
    out = o.streaks(out, ["k"], ["ts", "id"], "home", {1: "home_run", 0: "away_run"}, group_rows)
    rows = out.collect()
    assert len(rows) == len(expected)
    for row in rows:
        for name, value in expected[row.id].items():
            got = row[name]
            if value != value:
                assert got is None, (row.id, name, got)
            else:
                assert got == pytest.approx(value, abs=1e-9), (row.id, name)


def test_a_change_of_the_current_row_changes_nothing_before_it(frame):
    specs = {"total": o.prior_sum("x"), "avg": o.last_rows("x", 4)}
    base = o.running_columns(frame, ["k"], ["ts", "id"], specs)
    bumped = frame.withColumn("x", F.when(F.col("id") == "g050", F.lit(99.0)).otherwise(F.col("x")))
    other = o.running_columns(bumped, ["k"], ["ts", "id"], specs)
    a = base.filter("id = 'g050'").select("total", "avg").first()
    b = other.filter("id = 'g050'").select("total", "avg").first()
    assert a == b


def test_numbering_and_latest(frame):
    out = o.numbered(frame, ["k"], ["ts", "id"], "pos", group_rows=5)
    top = out.groupBy("k").agg(F.max("pos").alias("m"), F.count("*").alias("n"), F.countDistinct("pos").alias("d"))
    assert all(r.m == r.n == r.d for r in top.collect())
    last = o.latest_per_key(frame, ["k"], ["ts", "id"])
    by_pos = out.join(top.select("k", "m"), out.k.eqNullSafe(top.k)).filter("pos = m")
    assert {r.id for r in last.collect()} == {r.id for r in by_pos.collect()}


def test_no_window_over_rows_holds_a_group(frame):
    """Windows are by bucket or chunk; only that over the table of buckets is by group."""
    out = o.running_columns(
        frame, ["k"], ["ts", "id"], {"a": o.prior_sum("x"), "b": o.last_rows("x", 3), "c": o.previous("x")}
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    by = ["bucket" if "[_bucket#" in w else "chunk" if "_chunk#" in w else "group" for w in windows]
    assert sorted(by) == ["bucket", "chunk", "group"]
    assert ["_before_" in w for w in windows] == [k == "group" for k in by]
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # the rows, and the table of their buckets


def test_results_are_equal_to_the_last_bit(frame):
    thirds = frame.withColumn("x", F.col("x") / 3)
    specs = {"total": o.prior_sum("x"), "avg": o.last_rows("x", 4), "dec": o.decayed("x", 9), "sd": o.volatility("x", 5)}
    runs = [sorted(o.running_columns(thirds.repartition(n), ["k"], ["ts", "id"], specs, n).select("id", *specs).collect()) for n in (2, 5, 1000)]
    assert runs[0] == runs[1] == runs[2]


def test_a_hot_group_spreads_over_its_days(spark):
    rows = spark.range(0, 40_000, 1, 4).select(
        F.lit("hot").alias("k"), F.col("id"), (F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 7).cast("double").alias("x"))
    out = o.running_columns(rows, ["k"], ["ts", "id"], {"total": o.prior_sum("x"), "avg": o.last_rows("x", 3)}, 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    last = out.filter("id = 39999").first()
    assert last.total == sum(i % 7 for i in range(39_999)) and last.avg == pytest.approx(sum(i % 7 for i in (39996, 39997, 39998)) / 3)


def test_spans_at_any_place_of_a_bucket(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(-40, 60) if i else None, float(rng.randrange(1, 9)), i) for i in range(160)]
    frame = spark.createDataFrame(rows, "k string, t long, x double, id int")
    spans = {f"s{i}": o.Span("x", a, z) for i, (a, z) in enumerate([(-1, -1), (0, 0), (-8, -1), (-16, -16), (-9, -3), (-20, 5), (3, 11), (-30, -17), (-7, 8)])}
    for width in (1, 4, 8, 50):
        for r in o.trailing_range(frame, ["k"], "t", spans, width).collect():
            for name, s in spans.items():
                want = sum(x for k, t, x, _ in rows if None not in (t, r.t) and k == r.k and r.t + s.start <= t <= r.t + s.end)
                assert r[name] == want, (width, name, r)


def test_order_by_fractions(spark):
    values = [-1e300, -5.5, -5.25, -0.001, -0.0, 0.001, 0.5, 0.75, 1e9, 1e300, float("inf"), float("nan"), None]
    frame = spark.createDataFrame([("k", v, i) for i, v in enumerate(values)], "k string, v double, i int")
    got = {r.i: r.n for r in o.running_columns(frame, ["k"], ["v"], {"n": o.prior_count()}).collect()}
    assert [got[i] for i in range(len(values))] == [*range(1, len(values)), 0]


def test_bounded_groups_give_the_same_rows(frame):
    specs = {"total": o.prior_sum("x"), "avg": o.last_rows("x", 4), "last": o.prior_last("x")}
    rows = []
    for bounded in (True, False):
        laid = o.arrange(frame, ["k"], ["ts", "id"], bounded=bounded).add(specs)
        out = o.streaks(laid, ["k"], ["ts", "id"], "home", {1: "run"})
        rows.append(sorted(o.trailing_time(out, ["k"], "ts", {"s": o.last_days("x", 3)}, bounded=bounded).select("id", *specs, "run", "s").collect()))
    assert rows[0] == rows[1]


def test_latest_per_key_holds_one_copy_of_a_row_that_is_its_own_rank(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, 5), ("b", None, 2), ("a", 0, 9), (None, 3, 3)], "k string, x int, y int")
    newest, oldest = o.latest_per_key(rows, ["k"], ["x", "y"]), o.latest_per_key(rows, ["k"], ["x", "y"], newest=False)
    assert "max_by" not in newest._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in newest.collect()} == {("a", 1, 5), ("b", None, 2), (None, 3, 3)}
    assert {tuple(r) for r in oldest.collect()} == {("a", 0, 9), ("b", None, 2), (None, 3, 3)}
