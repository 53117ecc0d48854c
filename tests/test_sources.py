import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame import schemas
from pregame.sources import pages, payloads, tables
from pregame.streaming import landed

SCHEMA = T.StructType([T.StructField("game_id", T.StringType()), T.StructField("captured_at", T.StringType()), T.StructField("x", T.LongType())])


def test_conform_cleans_types(spark):
    df = spark.createDataFrame([("12.0", "abc", "5", "2024-04-01")], "game_id string, home_score string, away_score string, game_date string")
    row = schemas.conform(df, schemas.GAMES).first()
    assert (row.game_id, row.home_score, row.away_score, str(row.game_date)) == ("12", None, 5.0, "2024-04-01 00:00:00")
    nan = spark.createDataFrame([(float("nan"),)], "home_score double")
    assert schemas.conform(nan, schemas.GAMES).first().home_score is None


def test_align_and_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None, "t", 1)], "season int, a double, empty double, text string, extra int")
    assert schemas.align(df, ["b", "a"]).columns == ["b", "a", "season", "empty", "text", "extra"]
    assert schemas.feature_columns(df) == ["a", "extra"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "20240401", 1), ("b", "20230401", 2)], "game_id string, date string, x int")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    rows = tables.read_dated_csv(spark, str(tmp_path / "raw"), df.schema, [2024]).collect()
    assert [(r.game_id, r.season) for r in rows] == [("a", 2024)]
    assert tables.read_optional(spark, str(tmp_path / "none"), df.schema).isEmpty()
    assert tables.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "raw")], df.schema).count() == 2
    tables.write_table(df.withColumnRenamed("x", "season"), str(tmp_path / "t"))
    both = tables.read_feature_tables(spark, [str(tmp_path / "t"), str(tmp_path / "t")])
    assert both.count() == 4 and "source_file" in both.columns


def test_landed_files_are_taken_once(spark, tmp_path):
    inbox, args = tmp_path / "in", (str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp"), SCHEMA)
    inbox.mkdir()
    put = lambda name, **row: (inbox / name).write_text(json.dumps(row))
    put("one.json", game_id="g", captured_at="2024-04-01T10", x=1)
    landed.ingest(spark, *args)
    landed.ingest(spark, *args)
    put("two.json", game_id="g", captured_at="2024-04-01T12", x=2)
    put("three.json", game_id="h", captured_at="2024-04-01T09", x=3)
    landed.ingest(spark, *args)
    assert spark.read.parquet(args[1]).count() == 3
    assert {r.game_id: r.x for r in landed.latest_snapshots(spark, args[1], ["game_id"]).collect()} == {"g": 2, "h": 3}
    assert landed.manifest(spark, args[1]).count() == 3


def test_pages_are_searched_once(spark):
    html = "<table><tr><th>A</th><th></th></tr><tr><td>1</td><td>&amp;</td></tr><tr><td>2</td></tr></table><table><tr><td>x</td></tr></table><a href='u'>t</a><a>n</a>"
    df = spark.createDataFrame([("p", html), ("q", None), ("r", "none")], "page_id string, html string")
    assert [tuple(r) for r in pages.page_tables(df).collect()] == [("p", 1, 2, ["A", "column_2"], ["1", "&"])]
    assert [tuple(r) for r in pages.page_links(df).collect()] == [("p", 1, "t", "u")]
    made = df.withColumn("html", F.concat("html", F.lit("<b>")))
    for out in (pages.page_tables(made), pages.page_links(made)):
        filters = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert filters and not any("regexp_" in line for line in filters)


def test_provider_documents_are_parsed_once(spark):
    # A filter on the values must not bring their parsing along, once per mention.
    docs = spark.createDataFrame([('{"data": [{"game": {"id": "g"}, "team": "T", "players": [{"order": 1, "player": {"id": "p"}}, {"order": 2, "id": " "}]}, "text"]}',)], "json string")
    out = payloads.provider_lineups(docs, "provider")
    assert [(r.game_id, r.team, r.player_id, r.batting_order) for r in out.collect()] == [("g", "T", "p", 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 25 and "get_json_object" not in plan
