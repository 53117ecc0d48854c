"""Exact medians and distinct values of many columns at once, by narrowing histograms.

The bits of a double, read as an ordered 64-bit number, are cut into four steps of 16. One pass counts how
many values of each column fall under each leading step; the bin that holds the middle rank is known then, and
the next pass counts only values of that bin, one step finer. Counts, least and greatest value of a bin add
up over tasks, so nothing but bins is exchanged: a row is never multiplied by its columns, and no task holds a
column. A bin whose least and greatest value agree ends the search, which whole numbers reach in one or two passes.

NULLs are left out, NaN is greater than all numbers and equal to itself, -0.0 counts as 0.0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Workers get this module's functions with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP = 16
BINS = "_g string, _c int, _bin bigint, _n bigint, _lo bigint, _hi bigint"
STATE = [("_g", pa.string()), ("_c", pa.int32()), ("_parent", pa.int64()), ("_rank", pa.int64()), ("_which", pa.int32())]


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles."""
    clean = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = clean.astype("float64").view("int64")
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(key: int) -> float:
    bits = np.array([key], "int64")
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view("float64")[0])


def _known(column) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of an Arrow column that are there, and their rows."""
    there = np.asarray(column.is_valid())
    return column.drop_null().to_numpy(zero_copy_only=False), np.flatnonzero(there)


def _bins(batch: pa.RecordBatch, names: Sequence[str], shift: int, wanted: dict[int, np.ndarray] | None) -> pa.RecordBatch:
    """Bins of one batch: rows sorted by group and value, one line per stretch with the same leading bits."""
    groups = batch.column("_g").dictionary_encode()
    codes, labels = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary
    parts = []
    for i, name in enumerate(names):
        if wanted is not None and i not in wanted:
            continue
        values, rows = _known(batch.column(name))
        keys, code = ordered_bits(values), codes[rows]
        if wanted is not None:
            inside = np.isin(keys >> np.int64(shift + STEP), wanted[i])
            keys, code = keys[inside], code[inside]
        if not len(keys):
            continue
        order = np.lexsort((keys, code))
        keys, code = keys[order], code[order]
        bins = keys >> np.int64(shift)
        new = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]) | (code[1:] != code[:-1])])
        end = np.r_[new[1:], len(keys)]
        parts.append((code[new], np.full(len(new), i, "int32"), bins[new], end - new, keys[new], keys[end - 1]))
    code, column, bins, n, low, high = (
        [np.concatenate(p) for p in zip(*parts)] if parts else [np.array([], t) for t in ("int32", "int32", *["int64"] * 4)]
    )
    return pa.RecordBatch.from_arrays(
        [labels.take(pa.array(code)), *map(pa.array, (column, bins, n.astype("int64"), low, high))],
        names=["_g", "_c", "_bin", "_n", "_lo", "_hi"],
    )


def _pass(rows: DataFrame, names: Sequence[str], shift: int, wanted: dict[int, np.ndarray] | None, later: dict[str, list[str]] | None) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _bins(batch, names, shift, wanted)

    merged = [F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    bins = rows.mapInArrow(count, BINS).groupBy("_g", "_c", "_bin").agg(*merged)
    if later is not None:
        pairs = [x for g, many in later.items() for x in (F.lit(g), F.array(*map(F.lit, many)).cast("array<string>"))]
        onto = F.create_map(*pairs)[F.col("_g")] if pairs else F.array().cast("array<string>")
        bins = bins.withColumn("_g", F.explode(onto)).groupBy("_g", "_c", "_bin").agg(*merged)
    return bins


def middles(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), before: tuple[str, Sequence[int]] | None = None
) -> dict[tuple[str, str], tuple[float, float]]:
    """{(group, column): (low, high)}: the two middle values, equal where the number of values is odd.

    A group is the JSON text of its `by` values (`group_text`). With `before=(name, cuts)` there is one group per
    cut instead, of all rows where `name` is less than it; rows are still read once a pass, as bins of each value of
    `name` are added up. Jobs run here, at most four passes over `df`: give a written table where its plan is long.
    The driver holds two numbers per group and column, so groups are to be names (models, seasons), not ids.
    """
    columns = list(columns)
    group = group_text(by) if before is None else F.col(before[0]).cast("string")
    rows = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    later = None
    if before is not None:
        rows = rows.filter(F.col("_g").isNotNull())
        values = sorted(r[0] for r in df.select(before[0]).filter(F.col(before[0]).isNotNull()).distinct().collect())
        later = {str(v): [str(c) for c in before[1] if v < c] for v in values}
    names = [f"_v{i}" for i in range(len(columns))]
    found: dict[tuple[str, int, int], float] = {}
    state: list[tuple] | None = None
    for shift in range(64 - STEP, -1, -STEP):
        wanted = None
        if state is not None:
            wanted = {c: np.unique([s[2] for s in state if s[1] == c]) for c in {s[1] for s in state}}
        bins = _pass(rows, names, shift, wanted, later)
        if state is None:
            here = Window.partitionBy("_g", "_c")
            total = F.sum("_n").over(here)
            ranks = F.array(F.struct(F.expr("(_all + 1) div 2").alias("_rank"), F.lit(0).alias("_which")),
                            F.struct(F.expr("_all div 2 + 1").alias("_rank"), F.lit(1).alias("_which")))
            counted = bins.withColumns({"_all": total, "_r": F.sum("_n").over(here.orderBy("_bin"))})
            placed = counted.withColumn("_k", F.explode(ranks)).select("*", "_k.*")
        else:
            goal = small_table(df.sparkSession, state, STATE)
            inside = bins.withColumn("_parent", F.shiftright("_bin", STEP)).join(goal, ["_g", "_c", "_parent"])
            placed = inside.withColumn("_r", F.sum("_n").over(Window.partitionBy("_g", "_c", "_which").orderBy("_bin")))
        holding = placed.filter((F.col("_rank") <= F.col("_r")) & (F.col("_rank") > F.col("_r") - F.col("_n")))
        state = []
        for r in holding.select("_g", "_c", "_which", "_bin", "_lo", "_hi", (F.col("_rank") - F.col("_r") + F.col("_n")).alias("_left")).collect():
            if r["_lo"] == r["_hi"]:
                found[r["_g"], r["_c"], r["_which"]] = from_bits(r["_lo"])
            else:
                state.append((r["_g"], r["_c"], r["_bin"], r["_left"], r["_which"]))
        if not state:
            break
    return {(g, columns[c]): (value, found[g, c, 1]) for (g, c, which), value in found.items() if which == 0}


def small_table(spark, lines: Sequence[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """A few lines as a table that is part of the plan, without a Python task to read it."""
    arrays = [pa.array([line[i] for line in lines], kind) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))


def group_text(by: Sequence[str]):
    """The text that names a group of `middles`."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct doubles of each column, reduced batch by batch before they are exchanged."""
    columns = list(columns)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in columns:
                values = np.unique(ordered_bits(_known(batch.column(name))[0]))
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values)], names=["column", "value"])

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.mapInArrow(reduce, "column string, value bigint").distinct()
