"""Data-quality reports: null rates, season summary, readiness of rolling columns, coverage."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.functions.scalars import is_missing_text, number, percent, zero_filled
from pregame.operators.joins import require_columns
from pregame.operators.medians import distinct_values, middles, small_table
from pregame.schemas import NON_FEATURES
from pregame.session import settle

# Name parts which mark a column as rolling.
ROLLING_MARKERS = ("season_to_date", "last_", "recent_", "rest_days", "fatigue", "used_yesterday")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def exact_medians(df: DataFrame, columns: Sequence[str], written: bool = False) -> DataFrame:
    """(column, median) over all rows, exact at any size; a column without values has no row.

    Histograms are narrowed in passes (`operators.medians`), so `df` is written once, unless it is a
    `written` table already.
    """
    rows = df if written else settle(df.select(*columns))
    lines = [(column, (low + high) / 2) for (_, column), (low, high) in middles(rows, columns).items()]
    return small_table(df.sparkSession, lines, [("column", pa.string()), ("median", pa.float64())])


def null_rates(df: DataFrame, medians: bool = True, written: bool = False) -> DataFrame:
    """Per column: type, rows, nulls, and for numbers zero rate, least, median and greatest value.

    One pass of partial aggregates over all columns, unfolded to rows afterwards. With exact medians, which
    take passes of their own, `df` is written first, unless it is a `written` table.
    """
    numbers = set(numeric_columns(df))
    fields = df.schema.fields
    if medians and numbers and not written:
        # A column without a type cannot be written.
        df = settle(df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in fields if isinstance(f.dataType, T.NullType)}))
    measures = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        value = c.cast("double") if f.name in numbers else F.lit(None).cast("double")
        measures.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("non_null"),
                (F.count_if(value == 0) if f.name in numbers else F.lit(None).cast("bigint")).alias("zeros"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            )
        )
    one = df.agg(F.array(*measures).alias("m"))
    flat = one.select(F.explode("m").alias("m")).select("m.*")
    nulls = F.col("rows") - F.col("non_null")
    out = flat.select(
        "column", "dtype", "rows", "non_null", nulls.alias("nulls"),
        F.when(F.col("rows") > 0, nulls / F.col("rows")).alias("null_rate"),
        F.when(F.col("rows") > 0, F.col("zeros") / F.col("rows")).alias("zero_rate"), "min", "max",
    )
    if medians and numbers:
        out = out.join(exact_medians(df, sorted(numbers), written=True), "column", "left")
    return out


def season_summary(df: DataFrame, season: str = "season", date: str = "game_date", target: str | None = None) -> DataFrame:
    values = [F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    if target:
        values.append(F.avg(F.col(target).cast("double")).alias("home_win_rate"))
    return df.groupBy(season).agg(*values)


def rolling_readiness(
    df: DataFrame, season: str = "season", date: str = "game_date", columns: Sequence[str] | None = None, month: int = 5
) -> DataFrame:
    """Null rate of rolling columns per season, over all rows and from `month` on."""
    if columns is None:
        columns = [c for c in numeric_columns(df) if any(m in c for m in ROLLING_MARKERS)]
    mature = F.month(date) >= month
    measures = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.col(c).isNull().cast("double")).alias("null_rate_all"),
            F.avg(F.when(mature, F.col(c).isNull().cast("double"))).alias("null_rate_may_onward"),
            F.count_if(mature & F.col(c).isNotNull()).alias("non_null_may_onward"),
        )
        for c in columns
    ]
    wide = df.groupBy(season).agg(F.array(*measures).alias("m"))
    return wide.select(season, F.explode("m").alias("m")).select(season, "m.*")


def quality_report(
    df: DataFrame, season: str = "season", date: str = "game_date", target: str | None = None
) -> dict[str, DataFrame]:
    require_columns(df, [season, date], "features")
    return {
        "null_rates": null_rates(df),
        "season_summary": season_summary(df, season, date, target),
        "rolling_readiness": rolling_readiness(df, season, date),
    }


def defaulted_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which expected numeric columns are absent and therefore read as 0."""
    spark = df.sparkSession
    return spark.createDataFrame([(c, c not in df.columns) for c in columns], "column string, column_defaulted boolean")


def column_status(df: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """Per column: included or not and why, with its known count and null rate."""
    reserved_names = F.array(*[F.lit(c) for c in reserved]).cast("array<string>")
    numbers = F.array(*[F.lit(c) for c in numeric_columns(df)]).cast("array<string>")
    name = F.col("column")
    reason = (
        F.when(F.array_contains(reserved_names, name), "metadata_or_target")
        .when(~F.array_contains(numbers, name), "not_numeric")
        .when(F.col("non_null") == 0, "all_null")
        .otherwise("usable")
    )
    out = null_rates(df, medians=False).withColumn("reason", reason)
    return out.select(
        "column", F.when(F.col("reason") == "usable", "included").otherwise("excluded").alias("status"),
        "reason", "non_null", "null_rate",
    )


# Columns that only optical tracking fills, reasons of a feature set, columns a model table carries along.
TRACKING_MARKER = "statcast"
TRACKING_COLUMNS = (
    "home_sp_whiff_rate_to_date", "away_sp_whiff_rate_to_date", "sp_whiff_rate_diff",
    "home_sp_avg_fastball_velocity_to_date", "away_sp_avg_fastball_velocity_to_date", "sp_fastball_velocity_diff",
)
REASONS = {"reserved": "identifier_or_target", "tracking": "mlb_only_tracking", "usable": "npb_public_or_proxy", "empty": "all_null"}
CARRIED = (
    "game_id", "game_date", "season", "home_team", "away_team", "home_score", "away_score", "home_team_win",
    "home_sp_id", "away_sp_id", "venue_id", "prediction_mode",
)


def feature_set(df: DataFrame, reserved: Sequence[str] | None = None, reasons: dict[str, str] = REASONS) -> DataFrame:
    """(column, status, reason, non_null, null_rate) of each numeric or boolean column, for leagues without tracking.

    Reserved columns (by default those that no model may read) are excluded first, then tracking columns, then
    columns without any value, NaN not counting as one. One pass of partial aggregates; an empty table has NULL rates.
    """
    held = set(NON_FEATURES if reserved is None else reserved)
    cells = []
    for name in numeric_columns(df):
        c = F.col(f"`{name}`")
        known = F.count_if(c.isNotNull() & ~F.isnan(c.cast("double")))
        tracked = TRACKING_MARKER in name or name in TRACKING_COLUMNS
        kind = "reserved" if name in held else "tracking" if tracked else None
        reason = F.lit(reasons[kind]) if kind else F.when(known > 0, reasons["usable"]).otherwise(reasons["empty"])
        cells.append(F.struct(
            F.lit(name).alias("column"), reason.alias("reason"), known.alias("non_null"), F.count(F.lit(1)).alias("rows")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, status string, reason string, non_null bigint, null_rate double")
    flat = df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    out = flat.select(
        "column", F.when(F.col("reason") == reasons["usable"], "included").otherwise("excluded").alias("status"), "reason", "non_null",
        F.when(F.col("rows") > 0, (F.col("rows") - F.col("non_null")) / F.col("rows")).alias("null_rate"),
    )
    return out.orderBy("status", "reason", "column")


def model_ready(df: DataFrame, chosen: DataFrame, carried: Sequence[str] = CARRIED) -> DataFrame:
    """The carried columns, then the included ones of a feature set, as far as `df` has them.

    The names are read from `chosen` on the driver, as many as there are columns; rows are only projected.
    """
    require_columns(chosen, ["column", "status"], "feature_set")
    names = [r[0] for r in chosen.filter(F.col("status") == "included").select("column").collect()]
    there = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, *sorted(names)]) if c in there])


def distinct_coverage(tables: dict[str, DataFrame], key: str, base: DataFrame) -> DataFrame:
    """Distinct keys per table and over all tables together, with their share of the base keys."""
    tagged = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(key)).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    known = base.select(key).distinct()
    total = known.agg(F.count(F.lit(1)).alias("total"))
    both = tagged.withColumn("table_name", F.explode(F.array("table_name", F.lit("any")))).distinct()
    inside = both.join(known, key, "left_semi")
    counted = inside.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_keys"))
    # One row per table: the base's own count travels along as one more of them.
    lines = counted.unionByName(total.select(F.lit(None).cast("string").alias("table_name"), F.col("total").alias("n_keys")))
    named = F.col("table_name").isNotNull()
    one = lines.agg(F.max(F.when(~named, F.col("n_keys"))).alias("total"),
                    F.collect_list(F.when(named, F.struct("table_name", "n_keys"))).alias("t"))
    return one.select("total", F.explode("t").alias("t")).select(
        "t.table_name", "t.n_keys", F.bround(F.col("t.n_keys") / F.col("total") * 100.0, 1).alias("percent_of_base")
    )


def coverage_report(games: DataFrame, batting: DataFrame, pitching: DataFrame, lineups: DataFrame) -> DataFrame:
    """(metric, value, percent) of how much of a schedule the canonical tables cover.

    Each table is reduced to one row per game first; everything after works on those rows.
    """
    require_columns(games, ["game_id", "home_sp_id", "away_sp_id"], "games")
    one = F.lit(1)

    def per_game(df: DataFrame, kind: str, starts: bool = False) -> DataFrame:
        flagged = F.count_if(F.col("is_start") == 1) if starts else F.lit(0).cast("bigint")
        return df.filter(F.col("game_id").isNotNull()).groupBy("game_id").agg(
            F.lit(kind).alias("kind"), F.count(one).alias("n"), flagged.alias("starts"),
            F.count_if(is_missing_text("player_id")).alias("unknown"))

    parts = per_game(batting, "batting").unionByName(per_game(pitching, "pitching", True)).unionByName(per_game(lineups, "lineup"))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    wide = parts.groupBy("game_id").agg(
        of("batting", "n").alias("b"), of("pitching", "n").alias("p"), of("lineup", "n").alias("l"),
        of("pitching", "starts").alias("s"), F.sum("n").alias("rows"), F.sum("unknown").alias("unknown"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    logs = wide.agg(
        F.count(one).cast("double").alias("any"), F.count("b").cast("double").alias("b"), F.count("p").cast("double").alias("p"),
        F.count("l").cast("double").alias("l"), total("b").alias("br"), total("p").alias("pr"), total("l").alias("lr"),
        F.count_if(F.col("l") >= 18).cast("double").alias("full"), F.count_if(F.col("s") == 2).cast("double").alias("two"),
        total("unknown").alias("unknown"), total("rows").alias("rows"), F.coalesce(F.bround(F.avg("l"), 2), F.lit(0.0)).alias("mean"))
    plan = games.agg(
        F.count(one).cast("double").alias("games"), F.count_if(~is_missing_text("home_sp_id")).cast("double").alias("h"),
        F.count_if(~is_missing_text("away_sp_id")).cast("double").alias("a"))
    share = lambda name, c: (name, F.col(c), percent(c, "games"))
    plain = lambda name, c: (name, F.col(c), F.lit(None).cast("double"))
    metrics = [
        plain("scheduled_games", "games"), share("covered_games", "any"), share("batting_log_games", "b"), share("pitching_log_games", "p"),
        share("lineup_games", "l"), plain("batting_rows", "br"), plain("pitching_rows", "pr"), plain("lineup_rows", "lr"),
        share("games_with_home_starter", "h"), share("games_with_away_starter", "a"), ("player_id_missing", F.col("unknown"), percent("unknown", "rows")),
        plain("mean_lineup_rows", "mean"), plain("games_with_18_lineup_rows", "full"), plain("games_with_two_starters", "two"),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), q.alias("percent")) for n, v, q in metrics])
    # Two rows with different columns become one.
    both = logs.unionByName(plan, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(F.explode(cells).alias("m")).select("m.*")


def zero_or_blank_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows where a stat is missing, not a number, or zero."""
    measures = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg((zero_filled(number(F.col(c).cast("string"))) == 0).cast("double")).alias("rate"),
        )
        for c in columns
    ]
    return df.agg(F.array(*measures).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def header_audit(headers: DataFrame, required: Sequence[str]) -> DataFrame:
    """For each required column, in how many tables of (table_name, header) it is offered."""
    spark = headers.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "header string")
    seen = headers.select("table_name", "header").distinct().groupBy("header").agg(F.count(F.lit(1)).alias("tables"))
    return wanted.join(seen, "header", "left").select(
        "header", F.coalesce("tables", F.lit(0)).alias("tables"), F.col("tables").isNotNull().alias("available")
    )


def mode_counts(lineups: DataFrame, by: Sequence[str]) -> DataFrame:
    return lineups.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_members(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Distinct non-null ids over several tables and columns."""
    out = None
    for df, columns in tables.values():
        part = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("member")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("member").isNotNull()).distinct()


def diagnostics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null rate and distinct count per numeric column.

    Rates are one pass of partial aggregates. Distinct values are reduced inside each task, column by column,
    and only (column, value) pairs that are left are exchanged.
    """
    rates = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("known")) for c in columns]).alias("m"))
    flat = rates.select("n", F.explode("m").alias("m")).select("m.column", (F.col("m.known") / F.col("n")).alias("non_null_rate"))
    distinct = distinct_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return flat.join(distinct, "column", "left").select("column", "non_null_rate", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def mean_ranks(counts: DataFrame, columns: Sequence[str], n: str) -> DataFrame:
    """(_c, value, rank): the mean rank of each distinct value of each column, by its place in `columns`; rows count `n` times.

    The distinct values are dealt to ranges, a range is ranked by itself, and ranges are put behind one another
    by their totals, so no task holds a column. NaN is the greatest value and equal to itself.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).alias("value")) for i, c in enumerate(columns)]))
    values = counts.select(F.col(n).alias("_n"), cells.alias("_v")).groupBy("_v._c", "_v.value").agg(F.sum("_n").alias("_n"))
    ranges = settle(values.repartitionByRange("_c", "value").withColumn("_part", F.spark_partition_id()))
    totals = ranges.groupBy("_c", "_part").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_c", "_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    up_to = F.sum("_n").over(Window.partitionBy("_c", "_part").orderBy("value"))
    ranked = ranges.withColumn("_up_to", up_to).join(totals, ["_c", "_part"])
    return ranked.select("_c", "value", (F.col("_before") + F.col("_up_to") - (F.col("_n") - 1) / 2.0).alias("rank"))


def rank_correlations(df: DataFrame, columns: Sequence[str], floor: float = 0.95) -> DataFrame:
    """Column pairs whose Spearman correlation is at least `floor` in size, NULL read as the median.

    Equal rows are counted where they are read; distinct ones are ranked and multiplied, with their counts. The
    driver sees one number per pair.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    held = settle(df.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, columns)]))
    rows = settle(held.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    medians = {name: (low + high) / 2 for (_, name), (low, high) in middles(held, names).items()}
    kept = [i for i, n in enumerate(names) if n in medians]
    pairs = [(i, j) for i in kept for j in kept if i < j]
    found = []
    if pairs:
        placed = rows.select("_n", *[F.coalesce(names[i], F.lit(medians[names[i]])).alias(names[i]) for i in kept])
        ranks = settle(mean_ranks(placed, [names[i] for i in kept], "_n"))
        for k, i in enumerate(kept):
            own = ranks.filter(F.col("_c") == k).select(F.col("value").alias(names[i]), F.col("rank").alias(f"_r{i}"))
            placed = placed.join(own, names[i])
        middle = (rows.agg(F.sum("_n")).first()[0] + 1) / 2
        off = lambda i: F.col(f"_r{i}") - F.lit(middle)
        product = lambda i, j: F.sum(F.col("_n") * off(i) * off(j))
        sums = placed.agg(*[product(i, j).alias(f"_{i}_{j}") for i, j in [*pairs, *[(i, i) for i in kept]]]).first()
        for i, j in pairs:
            size = (sums[f"_{i}_{i}"] * sums[f"_{j}_{j}"]) ** 0.5
            if size and abs(sums[f"_{i}_{j}"] / size) >= floor:
                found.append((columns[i], columns[j], sums[f"_{i}_{j}"] / size))
    return df.sparkSession.createDataFrame(found, "left_column string, right_column string, correlation double")
