"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

`text_statistics` counts whole texts in Arrow batches. `outliers` turns the counts into a vector of
transformed statistics and estimates, in every (lang, source) group, the mean and covariance of the
`share` of rows that lie closest together:

* start: medians and scaled median absolute deviations;
* concentration steps: distances under the current estimate, their `share` quantile per group, mean and
  covariance of the rows up to it. Each is two aggregates that Spark sums map-side, so a group holding a
  third of all rows is spread over all tasks. Only one row per group is inverted in numpy;
* the covariance is scaled to be consistent for normal data, then re-estimated once from all rows within
  the 0.975 quantile, and a row is rejected when its squared distance exceeds the `1 - tail` quantile.

`FLOORS` are the smallest variances a statistic may have: most texts have no symbol at all, and without a
floor the first symbol would be infinitely far out. Groups with fewer than `min_rows` rows are judged as
one group of their language, and those of small languages as one group together; a group that is still
too small gets no verdict (kept).

Quantiles are Spark's `percentile_approx` with a fixed accuracy (rank error 1/10000), for any size.
Cases: a NULL or empty text has no words and fails the base rule; NULL languages and sources are groups;
equal rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, settle, tidy
from pregame.llm.words import BLANK, column_bytes, mix, ranges_hash, split_words

SYMBOLS = "#*$%&|<>"
COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]

_is_symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_is_capital = np.isin(np.arange(256), np.arange(65, 91))
_is_mark = np.isin(np.arange(256), [ord(c) for c in ",.;:!?-()\"'"])
_is_head = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _within_text(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Hashes made different for different texts."""
    return mix(hashes + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def count_texts(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    w = split_words(column)
    data, offsets = w.data, w.offsets
    out = {"n_words": np.diff(w.bounds), "n_symbols": _per_text(_is_symbol[data], offsets),
           "n_capitals": _per_text(_is_capital[data], offsets), "n_marks": _per_text(_is_mark[data], offsets),
           "word_chars": _per_text(_is_head[data] & ~BLANK[data], offsets)}

    # Lines: cut at \n and at the ends of texts.
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1])) if len(data) else np.zeros(0, np.int64)
    begins = begins[begins < len(data)]
    stops = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
    stops = np.where((stops > begins) & (data[stops - 1] == 10), stops - 1, stops) if len(begins) else stops
    has_word = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begins) if len(begins) else np.zeros(0, bool)
    begins, stops = begins[has_word], stops[has_word]
    text = np.searchsorted(offsets, begins, "right") - 1
    # The last of equal offsets is the text that has the bytes: empty texts before it have none.
    lines = np.bincount(text, minlength=w.texts)
    keys = _within_text(ranges_hash(data.astype(np.uint64) + np.uint64(1), begins, stops), text)
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(text[first], minlength=w.texts)

    starts, hashes = w.windows(window, w.hashes())
    keys = _within_text(hashes, w.text_of(starts))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[counts[inverse] > 1] if len(keys) else starts
    edges = np.bincount(again, minlength=len(w.starts) + 1) - np.bincount(again + window, minlength=len(w.starts) + 1)
    out["n_repeat_words"] = _per_text(np.cumsum(edges)[:len(w.starts)] > 0, w.bounds)
    return out


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = count_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *[pa.array(found[c], pa.int64()) for c in COUNTS]],
                names=["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return tidy(docs, COLUMNS).mapInArrow(run, schema)




def statistics() -> dict[str, tuple[Column, float]]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c, of: F.log1p(F.lit(100.0) * F.col(c) / of)
    return {
        "length": (F.log(n), 0.25),
        "word_length": (F.log(chars / n), 0.01),
        "symbols": (share("n_symbols", chars), 0.12),
        "marks": (F.sqrt(F.col("n_marks") / n), 0.01),
        "capitals": (F.sqrt(F.col("n_capitals") / chars), 0.005),
        "repeats": (share("n_repeat_words", n), 1.0),
        "dup_lines": (share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), 1.0),
    }


def chi_square(p: int, probability: float) -> float:
    """Quantile by Wilson and Hilferty's cube."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(probability)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _chi_square_cdf(p: int, x: float) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / p) ** (1 / 3) - (1 - 2 / (9 * p))) / math.sqrt(2 / (9 * p)))


def _fit(names: list[str], floors: list[float], factor: float):
    """One row per group in: count, sums and sums of products. Out: mean and inverse covariance."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                mean = np.array(r.sums, float) / r.n
                cov = np.zeros((p, p))
                for (i, j), s in zip(pairs, r.products):
                    cov[i, j] = cov[j, i] = s / r.n
                # Sums are taken around the group's centre, so this difference does not cancel.
                cov = (cov - np.outer(mean, mean)) * factor + np.diag(floors)
                inverse = np.linalg.inv(cov)
                rows.append((r.grp, [*(mean + np.array(r.centre, float))], [float(inverse[i, j]) for i, j in pairs]))
            yield pd.DataFrame(rows, columns=["grp", "mean", "inverse"])

    return fit


def _squared_distance(p: int) -> Column:
    dev = [F.get("x", F.lit(i)) - F.get("mean", F.lit(i)) for i in range(p)]
    total, k = F.lit(0.0), 0
    for i in range(p):
        for j in range(i, p):
            total = total + dev[i] * dev[j] * F.get("inverse", F.lit(k)) * F.lit(1.0 if i == j else 2.0)
            k += 1
    return total


def outliers(stats: DataFrame, share: float = 0.75, steps: int = 3, tail: float = 1e-6, min_rows: int = 60,
             accuracy: int = 10_000) -> DataFrame:
    """`stats` with `distance` (squared, NULL without a verdict) and `outlier`."""
    spec = statistics()
    names, floors, p = list(spec), [f for _, f in spec.values()], len(spec)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    flags = [F.col("lang"), F.col("lang").isNull()]
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    by_lang = sizes.filter(F.col("rows") < min_rows).groupBy("lang").agg(F.sum("rows").alias("lang_rows"))
    groups = sizes.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    grp = (
        F.when(F.col("rows") >= min_rows, F.xxhash64(F.lit(1), *flags, "source", F.col("source").isNull()))
        .when(F.col("lang_rows") >= min_rows, F.xxhash64(F.lit(2), *flags)).otherwise(F.lit(0).cast("long"))
    )
    groups = settle(groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), grp.alias("grp")))
    x = F.array(*[e.cast("double") for e, _ in spec.values()])
    rows = settle(stats.join(groups, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
                  .drop("l", "s").withColumn("x", x))
    vectors = rows.select("grp", "x")

    def quantiles(df: DataFrame, expressions: list[Column]) -> DataFrame:
        return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.array(*[
            F.percentile_approx(e, 0.5, accuracy) for e in expressions]).alias("mid"))

    centres = settle(quantiles(vectors, [F.get("x", F.lit(i)) for i in range(p)]).filter(F.col("n") >= min_rows)
                     .withColumnRenamed("mid", "centre").drop("n"))
    spread = quantiles(vectors.join(centres, "grp"),
                       [F.abs(F.get("x", F.lit(i)) - F.get("centre", F.lit(i))) for i in range(p)])
    zero, first = F.lit(0.0), []
    for i, j in pairs:
        var = F.pow(F.get("mid", F.lit(i)) * 1.4826, F.lit(2.0)) + F.lit(floors[i])
        first.append(F.lit(1.0) / var if i == j else zero)
    model = settle(spread.join(centres, "grp").select("grp", F.col("centre").alias("mean"), F.array(*first).alias("inverse")))

    def refit(model: DataFrame, near: DataFrame, factor: float) -> DataFrame:
        """Mean and covariance of the rows of `near` (x, grp), summed around the centres."""
        dev = near.join(centres, "grp").select("grp", "centre", *[
            (F.get("x", F.lit(i)) - F.get("centre", F.lit(i))).alias(f"d{i}") for i in range(p)])
        sums = dev.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), F.first("centre").alias("centre"),
            F.array(*[F.sum(f"d{i}") for i in range(p)]).alias("sums"),
            F.array(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i, j in pairs]).alias("products"))
        return settle(sums.mapInPandas(_fit(names, floors, factor), "grp long, mean array<double>, inverse array<double>"))

    def measured(model: DataFrame) -> DataFrame:
        return vectors.join(model, "grp").select("grp", "x", _squared_distance(p).alias("distance"))

    bound = chi_square(p, share)
    consistent = share / _chi_square_cdf(p + 2, bound)
    for _ in range(steps):
        far = measured(model)
        cut = settle(far.groupBy("grp").agg(F.percentile_approx("distance", share, accuracy).alias("cut")))
        model = refit(model, far.join(cut, "grp").filter(F.col("distance") <= F.col("cut")), consistent)
    model = refit(model, measured(model).filter(F.col("distance") <= chi_square(p, 0.975)),
                  0.975 / _chi_square_cdf(p + 2, chi_square(p, 0.975)))
    return (
        rows.join(model, "grp", "left").withColumn("distance", _squared_distance(p))
        .withColumn("outlier", F.coalesce(F.col("distance") > chi_square(p, 1 - tail), F.lit(False)))
        .drop("grp", "x", "mean", "inverse")
    )


def judge(docs: DataFrame, **options) -> DataFrame:
    """The counts with `base_failed` (fixed rules), `distance`, `outlier` and `kept`."""
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    judged = outliers(settle(text_statistics(docs)), **options).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
