"""Windows over "everything strictly before this row", for groups of any size.

Unless the caller states that groups are `bounded`, a group is never one task. `arrange` deals its rows into buckets of the first order column (a day of instants, a
block of whole numbers), and there is one way from there on, whatever the sizes:

* Running aggregates: inside a bucket by a window, plus what all earlier buckets of the group give. The latter
  comes from a table with one row per group and bucket, summed map-side, and a window over those rows.
* Row numbers are running counts, so they need no sort of the group either.
* Row frames: with its number known, a row belongs to a chunk of `group_rows` numbers; the last rows of a chunk
  are shown once more to the next, so a frame never looks outside its chunk. Frames see the same rows in the
  same order for any chunk size, so results are equal to the last bit.
* Time spans: whole buckets inside the span come from the table of bucket sums, only the rows of the buckets at
  its two ends are looked at one by one. Sums are sums of parts, never differences of totals.

Everything is lazy; nothing is written in between and nothing depends on the data's size.

`bounded=True` is a statement about the keys, made where they are chosen: the schedule lets a team or player have
a few hundred rows in a season, however large the tables are. Such a group is one window partition, as cutting it
would only add exchanges. Customers, users and the like have no such bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.functions.scalars import DAY_MICROS, col

# Rows of a chunk, unless the caller or the setting says otherwise. Results do not depend on it.
CHUNK_ROWS = 1 << 14
CHUNK_ROWS_SETTING = "pregame.groupRows"
# Numbers in a bucket where the order is a whole number.
BLOCK = 1 << 12

_POSITION, _BUCKET, _CHUNK, _CONTEXT = "_position", "_bucket", "_chunk", "_context"
_LAYOUT = (_POSITION, _BUCKET, _CHUNK, _CONTEXT)


@dataclass(frozen=True)
class Running:
    """An aggregate of all earlier rows of the group (`here=True`: of this row too)."""

    value: Column
    how: str = "sum"
    here: bool = False


@dataclass(frozen=True)
class Recent:
    """An aggregate of the `rows` rows before this one; `finish` maps the aggregate to the result."""

    value: Column
    rows: int
    how: Callable[[Column], Column] = F.avg
    finish: Callable[[Column], Column] = lambda c: c


def prior_sum(value: Column | str) -> Running:
    return Running(col(value))


def prior_count() -> Running:
    return Running(F.lit(1), "count")


def prior_last(value: Column | str) -> Running:
    return Running(col(value), "last")


def last_rows(value: Column | str, rows: int, how: Callable[[Column], Column] = F.avg) -> Recent:
    return Recent(col(value), rows, how)


def previous(value: Column | str) -> Recent:
    """The value one row earlier, NULL included."""
    return Recent(F.struct(col(value).alias("v")), 1, F.first, lambda c: c["v"])


def decayed(value: Column | str, rows: int, decay: float = 0.85) -> Recent:
    """Weighted mean of the known values among the last rows, the newest weighing most."""

    def mean(values: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        step = lambda a, x: F.struct((a["s"] * decay + x).alias("s"), (a["w"] * decay + 1.0).alias("w"))
        return F.aggregate(values, start, step, lambda a: F.when(a["w"] > 0, a["s"] / a["w"]))

    return Recent(col(value).cast("double"), rows, F.collect_list, mean)


def volatility(value: Column | str, rows: int) -> Recent:
    """Sample standard deviation, NULL for fewer than two known values."""
    return Recent(col(value), rows, F.stddev_samp)


# how: (aggregate inside a window, value when nothing came before, joining of two stretches)
_RUNNING = {
    "sum": (F.sum, 0.0, lambda a, b: a + b),
    "count": (F.count, 0, lambda a, b: a + b),
    "max": (F.max, None, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), None, lambda a, b: F.coalesce(b, a)),
}


def bucket_of(df: DataFrame, order: Column, width: int | None = None) -> Column:
    """The bucket of an order column, ascending with it: a day of instants or dates, `BLOCK` of whole numbers, a
    64th of a power of two of fractions; one for all other kinds."""
    kind = df.select(order).schema[0].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        micros, width = F.unix_micros(order.cast("timestamp")), width or DAY_MICROS
    elif isinstance(kind, T.IntegralType):
        micros, width = order.cast("bigint"), width or BLOCK
    elif isinstance(kind, T.DoubleType | T.FloatType):
        size = F.floor(F.signum(order) * F.log2(1 + F.abs(order)) * 64)
        return F.when(F.isnan(order), F.lit((1 << 63) - 1)).otherwise(size).cast("bigint")
    else:
        return F.lit(0).cast("bigint")
    return F.floor(micros / F.lit(width)).cast("bigint")


@dataclass(frozen=True)
class Arranged:
    """A frame dealt into buckets, with a total order in each group, ready for `add`."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    group_rows: int
    bounded: bool = False

    def numbered(self) -> Arranged:
        """With the 1-based row number inside the group, see `position`."""
        return self if _POSITION in self.df.columns else self.add({_POSITION: _row_number()})

    def position(self) -> Column:
        return F.col(_POSITION)

    def add(self, specs: dict[str, Running | Recent]) -> Arranged:
        """Add one column per entry."""
        if self.bounded:
            kept = [F.col(f"`{c}`") for c in self.df.columns if c not in specs]
            return self._with(self.df.select(*kept, *[self._whole(s).alias(n) for n, s in specs.items()]))
        running = {n: s for n, s in specs.items() if isinstance(s, Running)}
        recent = {n: s for n, s in specs.items() if isinstance(s, Recent)}
        if recent and _POSITION not in self.df.columns:
            running[_POSITION] = _row_number()
        out = self._add_running(running) if running else self
        return out._add_recent(recent) if recent else out

    def _with(self, df: DataFrame) -> Arranged:
        return Arranged(df, self.keys, self.order, self.group_rows, self.bounded)

    def _whole(self, spec: Running | Recent) -> Column:
        """Over the group as one window partition."""
        group = Window.partitionBy(*self.keys).orderBy(*self.order)
        if isinstance(spec, Recent):
            return spec.finish(spec.how(spec.value).over(group.rowsBetween(-spec.rows, -1)))
        aggregate, empty, _ = _RUNNING[spec.how]
        value = aggregate(spec.value).over(group.rowsBetween(Window.unboundedPreceding, 0 if spec.here else -1))
        return value if empty is None else F.coalesce(value, F.lit(empty))

    def _add_running(self, specs: dict[str, Running]) -> Arranged:
        inside = Window.partitionBy(_BUCKET).orderBy(*self.order)
        own, totals, across = [], [], []
        groups = Window.partitionBy(*[F.col("_of")[f"k{i}"] for i in range(len(self.keys))]).orderBy(F.col("_of")["b"])
        earlier = groups.rowsBetween(Window.unboundedPreceding, -1)
        for i, spec in enumerate(specs.values()):
            aggregate = _RUNNING[spec.how][0]
            frame = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.here else -1)
            own.append(aggregate(spec.value).over(frame).alias(f"_own_{i}"))
            if spec.how == "last":
                # The order as one value; rows without a value do not count.
                at = F.when(spec.value.isNotNull(), F.struct(*self.order))
                totals.append(F.max_by(spec.value, at).alias(f"_all_{i}"))
            else:
                totals.append(aggregate(spec.value).alias(f"_all_{i}"))
            join = F.sum if spec.how == "count" else aggregate
            across.append(join(F.col(f"_all_{i}")).over(earlier).alias(f"_before_{i}"))
        buckets = self.df.groupBy(F.col(_BUCKET).alias("_of")).agg(*totals).select("_of", *across)
        joined = self.df.select("*", *own).join(buckets, F.col(_BUCKET) == F.col("_of"))
        values = []
        for i, (name, spec) in enumerate(specs.items()):
            _, empty, join = _RUNNING[spec.how]
            before, here = F.col(f"_before_{i}"), F.col(f"_own_{i}")
            if empty is not None:
                before, here = F.coalesce(before, F.lit(empty)), F.coalesce(here, F.lit(empty))
            values.append(join(before, here).alias(name))
        kept = [c for c in self.df.columns if c not in specs]
        return self._with(joined.select(*[F.col(f"`{c}`") for c in kept], *values))

    def _add_recent(self, specs: dict[str, Recent]) -> Arranged:
        reach = max(s.rows for s in specs.values())
        n = self.group_rows
        chunk = F.floor((F.col(_POSITION) - 1) / n).cast("bigint")
        # A row is shown to its own chunk and to those behind it from which a frame can reach it.
        ahead = (F.floor((F.col(_POSITION) + reach - 1) / n) - chunk).cast("int")
        shown = self.df.withColumn("_ahead", F.explode(F.sequence(F.lit(0), ahead)))
        shown = shown.withColumn(_CHUNK, chunk + F.col("_ahead")).withColumn(_CONTEXT, F.col("_ahead") > 0).drop("_ahead")
        inside = Window.partitionBy(*self.keys, _CHUNK).orderBy(_POSITION)
        values = [s.finish(s.how(s.value).over(inside.rowsBetween(-s.rows, -1))).alias(n) for n, s in specs.items()]
        kept = [c for c in self.df.columns if c not in specs]
        out = shown.select(*[F.col(f"`{c}`") for c in kept], _CONTEXT, *values)
        return self._with(out.filter(~F.col(_CONTEXT)).drop(_CONTEXT))

    def done(self) -> DataFrame:
        return self.df.drop(*_LAYOUT)


def _row_number() -> Running:
    return Running(F.lit(1), "count", here=True)


def arrange(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    group_rows: int | None = None,
    width: int | None = None,
    bounded: bool = False,
) -> Arranged:
    """Lay `df` out by `keys` in the total order `order`.

    `width` is that of a bucket (microseconds, or units of a whole number).
    """
    columns = tuple(col(o) for o in order)
    if bounded:
        return Arranged(df, tuple(keys), columns, 0, True)
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    # One value, never NULL and equal for equal NULLs, so that joins by it are plain ones.
    bucket = F.struct(*parts, bucket_of(df, columns[0], width).alias("b"))
    chunk = group_rows or int(df.sparkSession.conf.get(CHUNK_ROWS_SETTING, str(CHUNK_ROWS)))
    return Arranged(df.withColumn(_BUCKET, bucket), tuple(keys), columns, chunk)


# -- operators -----------------------------------------------------------------------------


def running_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    specs: dict[str, Running | Recent],
    group_rows: int | None = None,
    width: int | None = None,
) -> DataFrame:
    return arrange(df, keys, order, group_rows, width).add(specs).done()


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    laid = arrange(df, keys, order, group_rows).numbered()
    return laid.df.withColumn(name, laid.position()).drop(*_LAYOUT)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key, by the greatest (or smallest) `order`; partial aggregation, no sort.

    Columns in `order` must decide ties, NULL counts as smallest.
    """
    rank, values = F.struct(*[col(o) for o in order]), [c for c in df.columns if c not in keys]
    if set(values) <= {o for o in order if isinstance(o, str)}:  # the rank is the row: one copy of it is enough
        pick = (F.max if newest else F.min)(rank)
    else:
        pick = (F.max_by if newest else F.min_by)(F.struct(*[F.col(c) for c in values]), rank)
    kept = df.groupBy(*keys).agg(pick.alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


@dataclass(frozen=True)
class Span:
    """A sum over instants from `t + start` to `t + end` microseconds, both ends included."""

    column: str
    start: int
    end: int


def last_days(column: str, days: float) -> Span:
    """`[t - days, t)`: the rows at `t` itself never count."""
    return Span(column, -int(days * DAY_MICROS), -1)


def days_ago(column: str, days: float) -> Span:
    """Only rows exactly `days` x 24 hours earlier."""
    return Span(column, -int(days * DAY_MICROS), -int(days * DAY_MICROS))


def trailing_range(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    spans: dict[str, Span],
    width: int = BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Sums over spans of a whole-number axis per group; an empty span and a NULL axis give 0.

    Buckets of `width` that lie in a span for every row of a bucket are summed from one row per group and bucket.
    The rows of those that a span may cut are shown to the buckets that ask for them.
    """
    t, parts = F.col(axis), [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    if bounded:
        group = Window.partitionBy(*keys).orderBy(axis)
        sums = {n: F.sum(s.column).over(group.rangeBetween(s.start, s.end)) for n, s in spans.items()}
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in spans], *[
            F.coalesce(F.when(t.isNotNull(), v), F.lit(0.0)).alias(n) for n, v in sums.items()])
    bucket = F.floor(t / F.lit(width)).cast("bigint")
    laid = df.withColumn(_BUCKET, F.struct(*parts, bucket.alias("b")))
    # For each span: the offsets of the buckets that it may cut, and of the first and last that it surely holds.
    cut: dict[str, set[int]] = {}
    whole: dict[str, tuple[int, int]] = {}
    for name, s in spans.items():
        first, last = s.start // width, s.end // width
        starts = {first} if s.start % width == 0 else {first, first + 1}
        if s.end % width == width - 1:  # up to an instant before one of the bucket `last + 1`: `last` is never cut
            ends, held_to = {last + 1}, last
        else:
            ends = {last} if s.end % width == 0 else {last, last + 1}
            held_to = min(ends) - 1
        cut[name], whole[name] = starts | ends, (max(starts) + 1, held_to)
    columns = sorted({s.column for s in spans.values()})
    sums = laid.groupBy(F.col(_BUCKET).alias("_of")).agg(*[F.sum(c).alias(f"_all_{c}") for c in columns])
    groups = Window.partitionBy(*[F.col("_of")[f"k{i}"] for i in range(len(keys))]).orderBy(F.col("_of")["b"])
    held = sums.select("_of", *[
        F.sum(f"_all_{spans[n].column}").over(groups.rangeBetween(a, z)).alias(f"_whole_{n}")
        for n, (a, z) in whole.items() if a <= z
    ])
    # A row is shown to a bucket only if a span of some moment in there, starting or ending in the row's own, holds it.
    targets = [F.lit(0)]
    for o in sorted({o for those in cut.values() for o in those} - {0}):
        begin = (bucket - o) * width
        reach = [(t - spans[n].start >= begin) & (t - spans[n].end <= begin + width - 1) for n in spans if o in cut[n]]
        targets.append(F.when(reduce(or_, reach), F.lit(-o)))
    targets = F.explode(F.array_compact(F.array(*targets))).alias("_ahead")
    needed = {axis, _BUCKET, *keys, *columns}
    shown = laid.select("*", targets)
    own = F.col("_ahead") == 0
    shown = shown.select(
        "_ahead", *[F.col(f"`{c}`") if c in needed else F.when(own, F.col(f"`{c}`")).alias(c) for c in df.columns],
        F.struct(*[F.col(_BUCKET)[f"k{i}"].alias(f"k{i}") for i in range(len(keys))],
                 (F.col(_BUCKET)["b"] + F.col("_ahead")).alias("b")).alias(_BUCKET),
    )
    along = Window.partitionBy(_BUCKET).orderBy(axis)
    edges = [
        F.sum(F.when((-F.col("_ahead")).isin(*cut[n]), F.col(s.column))).over(along.rangeBetween(s.start, s.end)).alias(f"_edge_{n}")
        for n, s in spans.items()
    ]
    met = shown.select("*", *edges).filter(own).join(held, F.col(_BUCKET) == F.col("_of"))
    zero = lambda c: F.coalesce(F.when(t.isNotNull(), c), F.lit(0.0))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in spans], *[
        ((zero(F.col(f"_whole_{n}")) + zero(F.col(f"_edge_{n}"))) if whole[n][0] <= whole[n][1] else zero(F.col(f"_edge_{n}"))).alias(n)
        for n in spans
    ])


def trailing_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    spans: dict[str, Span],
    calendar_days: bool = False,
    width: int = DAY_MICROS,
    bounded: bool = False,
) -> DataFrame:
    """Sums over spans of earlier time (microseconds) per group; an empty span gives 0."""
    moment = F.col(ts).cast("timestamp")
    timed = df.withColumn("_micros", F.unix_micros(F.date_trunc("day", moment) if calendar_days else moment))
    return trailing_range(timed, keys, "_micros", spans, width, bounded).drop("_micros")


def streaks(
    df: DataFrame | Arranged,
    keys: Sequence[str],
    order: Sequence[str | Column],
    flag: str,
    names: dict[object, str],
    group_rows: int | None = None,
) -> DataFrame:
    """Length of the current run of equal `flag` values; `names` maps a flag value to its column.

    A frame that is laid out already is taken as it is.
    """
    laid = df if isinstance(df, Arranged) else arrange(df, keys, order, group_rows)
    laid = laid.numbered().add({"_was": previous(flag)})
    changed = ~F.col(flag).eqNullSafe(F.col("_was")) | F.col("_was").isNull()
    laid = laid.add({"_since": Running(F.when(changed, laid.position()), "max", here=True)})
    length = (laid.position() - F.col("_since") + 1).cast("double")
    runs = {name: F.when(F.col(flag) == value, length).otherwise(F.lit(0.0)) for value, name in names.items()}
    return laid.df.withColumns(runs).drop("_was", "_since", *_LAYOUT)
