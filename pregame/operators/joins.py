"""Joins which plain equi joins do not cover: strict as-of, unique matches, two-sided blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalars import DAY_MICROS
from pregame.operators.ordered import (
    Span,
    arrange,
    previous,
    prior_last,
    trailing_range,
)


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed NULLs."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def asof_strict(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    tie: str | None = None,
    width: int = DAY_MICROS,
    bounded: bool = False,
) -> DataFrame:
    """For each left row the latest right row of the same key with a strictly earlier instant.

    Both sides are stacked and dealt into days of each key. Inside a day the last right row before each left
    row is carried forward; the last one of each day is carried over days, in a table of one row per key and
    day. No range condition, and no task holds a key. At equal right instants the greatest `tie` wins; with no
    match the columns are NULL.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    tie_of = F.col(tie).cast("string") if tie else F.lit("")
    found = F.struct(*[F.col(c) for c in columns])
    # kept nested, so left columns may carry the same names as right ones
    seekers = left.select(
        *keys, micros.alias("_t"), F.lit(0).alias("_side"), F.lit("").alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    history = right.select(
        *keys, micros.alias("_t"), F.lit(1).alias("_side"), tie_of.alias("_tie"), found.alias("_found"),
    )
    both = seekers.unionByName(history, allowMissingColumns=True)
    laid = arrange(both, keys, ["_t", "_side", "_tie"], width=width, bounded=bounded).add({"_match": prior_last("_found")})
    kept = laid.done().filter(F.col("_side") == 0)
    own = [F.col("_left")[c].alias(c) for c in left.columns if c not in columns]
    return kept.select(*own, *[F.col("_match")[c].alias(c) for c in columns])


def unique_match(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_id: str,
    right_id: str,
) -> DataFrame:
    """Left rows whose id meets exactly one distinct right id over all its keys; one row per left id.

    The right side is first reduced to one row per join key (its least and greatest id), so a
    name or date shared by many rows on both sides never multiplies.
    """
    values = [c for c in right.columns if c not in on]
    row = F.struct(*[F.col(v) for v in values])
    known = right.filter(F.col(right_id).isNotNull())
    per_key = known.groupBy(*on).agg(
        F.min(right_id).alias("_lo"), F.max(right_id).alias("_hi"), F.min(row).alias("_row")
    )
    met = left.join(per_key, list(on))
    own = [c for c in left.columns if c != left_id]
    best = F.struct(F.col("_row"), *[F.col(c) for c in own])
    ends = met.groupBy(left_id).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(best).alias("_best")
    )
    single = ends.filter(F.col("_lo") == F.col("_hi"))
    return single.select(
        left_id,
        *[F.col("_best")[c].alias(c) for c in own],
        *[F.col("_best._row")[v].alias(v) for v in values],
    )


def two_sided(
    games: DataFrame,
    home: str,
    away: str,
    carry: Sequence[str],
    mirrored: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Two rows per game, one from each side's point of view.

    `mirrored` maps an output column to the (home, away) columns it reads: the side's own first
    for the home row, swapped for the away row. The game is read once and spread in place.
    """
    mirrored = mirrored or {}

    def side(is_home: int) -> Column:
        own, other = (home, away) if is_home else (away, home)
        fields = [F.col(own).alias("team"), F.col(other).alias("opponent"), F.lit(is_home).alias("is_home")]
        for name, (at_home, away_from) in mirrored.items():
            fields.append(F.col(at_home if is_home else away_from).alias(name))
        return F.struct(*fields)

    spread = games.select(*carry, F.explode(F.array(side(1), side(0))).alias("_side"))
    names = ["team", "opponent", "is_home", *mirrored]
    return spread.select(*carry, *[F.col("_side")[n].alias(n) for n in names])


def join_two_sided(base: DataFrame, block: DataFrame, key: str, home: str, away: str, member: str) -> DataFrame:
    """Attach `block` (one row per `key`, `member`) to the home and to the away side.

    All its value columns arrive twice, as `home_<name>` and `away_<name>`. The rows of a key, a handful, travel as one list, so
    that the block is made once and both sides meet it in one join.
    """
    values = [c for c in block.columns if c not in (key, member)]
    row = F.struct(F.col(member).alias("_m"), *[F.col(c).alias(c) for c in values])
    met = block.filter(F.col(key).isNotNull() & F.col(member).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.collect_list(row).alias("_rows"))
    out = base.join(met, base[key] == F.col("_k"), "left").drop("_k")
    of = lambda column: F.filter("_rows", lambda r: r["_m"] == F.col(column))
    for side, column in (("home", home), ("away", away)):
        out = out.select("*", F.explode_outer(of(column)).alias(f"_{side}"))
    flat = [F.col(f"_{side}")[c].alias(f"{side}_{c}") for side in ("home", "away") for c in values]
    return out.select(*[F.col(c) for c in base.columns], *flat)


def set_continuity(
    df: DataFrame,
    group: str,
    unit: str,
    order: Sequence[str],
    member: str,
    group_rows: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Compare each unit's member set with the set of the unit before it in the same group.

    Adds to every row `returned` (1 or 0: was this member in the previous set) and
    `previous_missing` (how many previous members are gone). Both are NULL where there is no
    previous unit or its set is empty. `unit_size` is the number of distinct members of the row's
    own unit. Sets are compared by joins, so they may be of any size.
    """
    units = df.groupBy(group, unit).agg(*[F.min(o).alias(o) for o in order])
    laid = arrange(units, [group], [*order, F.col(unit).try_cast("bigint"), F.col(unit)], group_rows, bounded=bounded).numbered()
    places = laid.df.select(group, unit, laid.position().alias("_no"))
    rows = df.join(places, [group, unit], "left").withColumn("_one", F.when(F.col(member).isNotNull(), 1.0))
    # A member returns when it also has a row exactly one unit earlier.
    spans = {"_before": Span("_one", -1, -1), "_repeats": Span("_one", 0, 0)}
    seen = trailing_range(rows, [group, member], "_no", spans, bounded=bounded)
    share = F.when(F.col("_one").isNotNull(), 1.0 / F.col("_repeats"))
    per_unit = seen.groupBy(group, unit).agg(
        F.max("_no").alias("_no"),
        F.round(F.coalesce(F.sum(share), F.lit(0.0))).alias("unit_size"),
        F.round(F.coalesce(F.sum(F.when(F.col("_before") > 0, share)), F.lit(0.0))).alias("_kept"),
    )
    per_unit = arrange(per_unit, [group], ["_no"], group_rows, bounded=bounded).add({"_had": previous("unit_size")}).done()
    had = F.when(F.col("_had") > 0, F.col("_had"))
    per_unit = per_unit.select(group, unit, "unit_size", (had - F.col("_kept")).alias("previous_missing"))
    out = seen.join(per_unit, [group, unit], "left")
    returned = F.when(F.col("previous_missing").isNotNull(), (F.col("_before") > 0).cast("double"))
    return out.withColumn("returned", returned).drop("_no", "_one", "_before", "_repeats")


def unit_places(df: DataFrame, group: str, unit: str, order: Sequence[str], member: str) -> DataFrame:
    """One row per (group, unit) for groups that are bounded: the unit's number `_no`, `unit_size` and `_had`, the size of the unit
    before it, as in `set_continuity`. A unit without an id has no number."""
    units = df.groupBy(group, unit).agg(*[F.min(o).alias(o) for o in order], F.count_distinct(member).cast("double").alias("unit_size"))
    laid = arrange(units, [group], [*order, F.col(unit).try_cast("bigint"), F.col(unit)], bounded=True).numbered()
    numbered = laid.df.select(group, unit, "unit_size", F.when(F.col(unit).isNotNull(), laid.position()).alias("_no"))
    return arrange(numbered, [group], ["_no"], bounded=True).add({"_had": previous("unit_size")}).done()


def returning(df: DataFrame, group: str, unit: str, member: str, bounded: bool) -> DataFrame:
    """`returned` and `previous_missing`, as in `set_continuity`, of rows that have met `unit_places`; drops its helpers.

    Rows laid out by `member` stay where they are for the first window; the second one is laid out by unit, which serves whatever
    is grouped by unit, alone or with other keys, afterwards.
    """
    rows = df.withColumn("_one", F.when(F.col(member).isNotNull(), 1.0))
    seen = trailing_range(rows, [group, member], "_no", {"_before": Span("_one", -1, -1), "_repeats": Span("_one", 0, 0)}, bounded=bounded)
    share = F.when(F.col("_one").isNotNull() & (F.col("_before") > 0), 1.0 / F.col("_repeats"))
    kept = F.round(F.coalesce(F.sum(share).over(Window.partitionBy(group, unit)), F.lit(0.0)))
    seen = seen.repartition(unit).withColumn("previous_missing", F.when(F.col("_had") > 0, F.col("_had")) - kept)
    returned = F.when(F.col("previous_missing").isNotNull(), (F.col("_before") > 0).cast("double"))
    return seen.withColumn("returned", returned).drop("_no", "_had", "_one", "_before", "_repeats")


def compare_to_baseline(
    df: DataFrame, keys: Sequence[str], variant: str, baseline: str, metrics: Sequence[str]
) -> DataFrame:
    """Add `<metric>_delta` against the baseline row of the same keys."""
    base = df.filter(F.col(variant) == baseline).groupBy(*keys).agg(*[F.max(m).alias(f"_b_{m}") for m in metrics])
    joined = df.join(base, list(keys), "left")
    deltas = {f"{m}_delta": F.col(m) - F.col(f"_b_{m}") for m in metrics}
    return joined.withColumns(deltas).drop(*[f"_b_{m}" for m in metrics])
