"""Ridge regression for every cut of an ordered column from one pass over the rows.

The fit for cut c (a season) reads all rows before c. Its closed form needs only sums: row counts, values,
products. Those are additive, so each task sums one small matrix per season, the matrices are added up over tasks
and over earlier seasons in one exchange, and each cut is solved from its own. The number of passes over the
rows does not grow with the number of cuts or targets.

Gaps are filled with the median of the rows of the cut, which differs by cut. The summed vector is therefore
(1, x or 0, x is missing, y): filling with m adds m times the indicator, which can be done to the sums afterwards.
Values are taken relative to one median each, as products of large offsets would lose digits.

Per cut and target: gaps filled by medians, columns scaled to mean 0 and population deviation 1 (constant columns are
only centred), `penalty` on the scaled coefficients, none on the intercept. Columns without a value before a cut get no
coefficient there. NaN counts as missing; rows whose target is NULL are left out for that target; a cut without rows
has no line. Rows without the cut column are never learned from.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.operators.medians import middles

# Workers get this module's functions with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FITS = "cut bigint, target string, n bigint, fill array<double>, weight array<double>, intercept double"


def _summed(batch: pa.RecordBatch, d: int, targets: int, shift: np.ndarray, sums: dict) -> None:
    """Add the products of one batch to `sums`, by (season, target)."""
    season = batch.column("_s").to_numpy(zero_copy_only=False)
    x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(d)]).astype("float64")
    gaps = np.isnan(x)
    x = np.where(gaps, 0.0, x - shift)
    for t in range(targets):
        y = batch.column(f"_y{t}").to_numpy(zero_copy_only=False).astype("float64")
        for s in np.unique(season):
            rows = (season == s) & ~np.isnan(y)
            if rows.any():
                z = np.column_stack([np.ones(rows.sum()), x[rows], gaps[rows], y[rows]])
                sums[int(s), t] = sums.get((int(s), t), 0.0) + z.T @ z


def solve(sums: np.ndarray, fill: Sequence[float | None], shift: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients on the filled columns (0 for those without `fill`) and intercept, from summed products."""
    d = len(fill)
    used = np.array([i for i, m in enumerate(fill) if m is not None], int)
    # One row per quantity of the filled data, in terms of the summed vector: 1, the used columns, y.
    mix = np.zeros((len(used) + 2, 2 * d + 2))
    mix[0, 0] = mix[-1, -1] = 1.0
    for k, i in enumerate(used):
        mix[k + 1, 1 + i], mix[k + 1, 1 + d + i] = 1.0, fill[i] - shift[i]
    full = mix @ sums @ mix.T
    n = full[0, 0]
    mean = full[0, 1:] / n
    spread = full[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0) / n)
    # What rounding leaves of a constant column is no spread.
    scale[scale <= 1e-7 * np.sqrt(np.maximum(np.diag(full)[1:-1] / n, 1e-300))] = 1.0
    left = spread[:-1, :-1] / np.outer(scale, scale) + penalty * np.eye(len(used))
    weight = np.linalg.solve(left, spread[:-1, -1] / scale) / scale if len(used) else np.zeros(0)
    out = np.zeros(d)
    out[used] = weight
    return out, float(mean[-1] - weight @ (mean[:-1] + shift[used]))


def fit_before(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], cuts: Sequence[int], by: str = "season", penalty: float = 1.0
) -> DataFrame:
    """(cut, target, n, fill, weight, intercept): one ridge fit per cut and target, of the rows before the cut.

    Jobs run here for the medians (at most four passes, see `middles`); the sums are one lazy pass. Give a written
    table where the plan of `df` is long. Features and cuts are names and are bounded as such: a task holds
    (2 x features + 2)^2 sums per season and target it sees, and the solving task the sums of one cut.
    """
    features, targets, cuts, d = list(features), list(targets), list(cuts), len(features)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.filter(F.col(by).isNotNull()).select(
        F.col(by).cast("bigint").alias("_s"), *[value(c).alias(f"_x{i}") for i, c in enumerate(features)],
        *[value(c).alias(f"_y{t}") for t, c in enumerate(targets)],
    )
    per_target = rows.select("_s", *[
        F.when(F.col(f"_y{t}").isNotNull(), F.col(f"_x{i}")).alias(f"_{t}_{i}") for t in range(len(targets)) for i in range(d)
    ])
    found = middles(per_target, per_target.columns[1:], before=("_s", cuts))
    fills = {
        (cut, t): [sum(found[str(cut), f"_{t}_{i}"]) / 2 if (str(cut), f"_{t}_{i}") in found else None for i in range(d)]
        for cut in cuts for t in range(len(targets))
    }
    last = max(cuts, default=None)
    shift = np.array([(fills[last, 0][i] if cuts and targets else None) or 0.0 for i in range(d)])
    shift = np.where(np.isfinite(shift), shift, 0.0)
    size = 2 * d + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                _summed(batch, d, len(targets), shift, sums)
        for (s, t), matrix in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"_s": [s] * size, "_t": [t] * size, "_i": list(range(size)), "_row": list(matrix)},
                schema=pa.schema([("_s", pa.int64()), ("_t", pa.int32()), ("_i", pa.int32()), ("_row", pa.list_(pa.float64()))]),
            )

    parts = rows.mapInArrow(products, "_s bigint, _t int, _i int, _row array<double>")
    later = F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>"), lambda c: c > F.col("_s"))
    summed = parts.withColumn("_cut", F.explode(later)).groupBy("_cut", "_t", "_i").agg(
        F.array(*[F.sum(F.col("_row")[j]) for j in range(size)]).alias("_row")
    )

    def fit(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("_i")
        cut, t = int(lines["_cut"].iloc[0]), int(lines["_t"].iloc[0])
        sums, fill = np.vstack(lines["_row"].to_numpy()), fills[cut, t]
        weight, intercept = solve(sums, fill, shift, penalty)
        return pd.DataFrame({"cut": [cut], "target": [targets[t]], "n": [int(round(sums[0, 0]))],
                             "fill": [[0.0 if m is None else m for m in fill]], "weight": [list(weight)], "intercept": [intercept]})

    return summed.groupBy("_cut", "_t").applyInPandas(fit, FITS)


# Fits up to this many bytes are sent to every executor, so that rows need not be moved to join them.
BROADCAST_BYTES = 8 << 20


def score_cuts(
    df: DataFrame, fits: DataFrame, features: Sequence[str], columns: dict[str, str], cuts: Sequence[int], by: str = "season"
) -> DataFrame:
    """Add the forecast of each target (`{target: column}`) by the fit whose cut is the row's own; NULL without one.

    `fits` has at most one line per entry of `cuts` and target, which bounds its size.
    """
    one = lambda t: F.max(F.when(F.col("target") == t, F.struct("fill", "weight", "intercept")))
    wide = fits.groupBy(F.col("cut").alias("_cut")).agg(*[one(t).alias(f"_m_{i}") for i, t in enumerate(columns)])
    if len(cuts) * len(columns) * (2 * len(features) + 8) * 8 <= BROADCAST_BYTES:
        wide = F.broadcast(wide)
    joined = df.join(wide, F.col(by).cast("bigint") == F.col("_cut"), "left")

    def forecast(model: str) -> Column:
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return sum((F.col(f"{model}.weight")[i] * F.coalesce(value(c), F.col(f"{model}.fill")[i]) for i, c in enumerate(features)),
                   F.col(f"{model}.intercept"))

    out = joined.withColumns({column: forecast(f"_m_{i}") for i, column in enumerate(columns.values())})
    return out.drop("_cut", *[f"_m_{i}" for i in range(len(columns))])
