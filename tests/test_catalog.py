"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from pregame.catalog import load
from pregame.catalog.check import compare

FOLDER = "/root/testdata/sf0.001"
WITH_TWIN = sorted(load()[1])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", WITH_TWIN)
def test_query_equals_its_twin(spark, name):
    assert compare(spark, FOLDER, [name]) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", ["prior_sums_and_counts", "rolling_rows", "trailing_days", "status_streaks", "clicks_after_last_purchase",
                                  "part_set_continuity", "team_form", "null_rate_report", "temporal_split"])
def test_cut_groups_give_the_same_rows(spark, name):
    """The same check with every group cut into chunks of 40 rows."""
    spark.conf.set("pregame.groupRows", "40")
    try:
        assert compare(spark, FOLDER, [name]) == []
    finally:
        spark.conf.unset("pregame.groupRows")


def test_every_twin_has_a_query():
    queries, sql = load()
    assert set(sql) <= set(queries)
    assert not [n for n in queries if "pipeline" in n or n.startswith("op")]


def test_tables_read_once_are_not_kept(spark, tmp_path):
    from pregame.catalog import tables as T

    rows = {
        "orders": ("1 AS o_orderkey, 2 AS o_custkey, timestamp'2024-05-01' AS o_orderdate",),
        "lineitem": tuple(f"1 AS l_orderkey, {p} AS l_partkey, {p % 3} AS l_suppkey, {p}.0D AS l_quantity, {p} AS l_linenumber, 'A' AS l_returnflag" for p in (1, 2, 4)),
        "nation": ("3 AS n_nationkey, 'N' AS n_name",), "customer": ("2 AS c_custkey, 3 AS c_nationkey",),
        "supplier": ("1 AS s_suppkey, 3 AS s_nationkey", "2 AS s_suppkey, 3 AS s_nationkey"),
    }
    for name, lines in rows.items():
        spark.sql(" UNION ALL ".join(f"SELECT {x}" for x in lines)).write.parquet(f"{tmp_path}/{name}.parquet")
    once = T.batting_logs.once(spark, str(tmp_path), T.games.once).select("game_id", "home_runs")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "opposing_pitcher_hand" not in plan  # only what is needed is made
    kept = T.batting_logs(spark, str(tmp_path)).select("game_id", "home_runs")
    assert sorted(once.collect()) == sorted(kept.collect()) and kept.count() == 3
