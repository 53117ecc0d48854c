"""Substring deduplication of word windows by level-wise doubling.

A window is `window` consecutive words. A word goes if some window over it also starts in a document with
a smaller doc_id. Levels have lengths `start`, twice that, and so on up to `window`:

* Level one. Of all stretches of `start` words in a window, the one with the smallest hash is its anchor
  (the first of equals), so equal windows have equal anchors, and only about 2 in `window - start + 2`
  places are anchors. Anchors found in at least two different texts survive.
* Each further level looks only at windows whose stretch survived the level before, and extends the
  stretch to twice its length within the window. The last level's stretch is the window itself; there,
  the smallest doc_id of each window is what decides.

Counting is by aggregates of minima and maxima, summed map-side; rows come back to their texts by
sort-merge joins that AQE splits where a passage is in very many texts. Equal texts are looked at once: of
their documents all but the smallest lose every word of every window. Hashes of the last level have 96
bits, those before only choose candidates.

Cases: a NULL text has no words; a NULL doc_id comes after all others and is smaller than none; rows
with equal doc_id do not remove each other's words; texts with fewer words than a window stay as they
are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, settle, tidy
from pregame.llm.words import split_words

LAST = (1 << 63) - 1


def level_lengths(window: int, start: int) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of each `width` neighbouring values."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    done = 1
    while done < width:  # best[i]: over values[i : i + done]
        step = min(done, width - done)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        done += step
    return best[:n]


class _Anchors:
    """The windows of a piece and, level by level, their stretches."""

    def __init__(self, column: pa.Array, window: int, start: int):
        self.words = split_words(column)
        self.hashes = self.words.hashes()
        self.first, _ = self.words.windows(window, self.hashes)
        self.window = window
        if len(self.first):
            starts, values = self.words.windows(start, self.hashes)
            level = np.full(len(self.words.starts), np.uint64(2**64 - 1))
            level[starts] = values
            self.anchor = _lowest(level, window - start + 1)[self.first]
        else:
            self.anchor = self.first

    def stretches(self, length: int) -> np.ndarray:
        """Where the stretch of each window starts once it has `length` words."""
        return np.minimum(self.anchor, self.first + self.window - length)

    def keep(self, alive: np.ndarray) -> None:
        self.first, self.anchor = self.first[alive], self.anchor[alive]


def _anchor_rows(window: int, start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            a = _Anchors(b.column("text"), window, start)
            at = np.unique(a.anchor)
            _, hashes = a.words.windows(start, a.hashes)
            where = a.words.windows(start, a.hashes)[0]
            text = a.words.text_of(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[np.searchsorted(where, at)].view(np.int64)), b.column("k1").take(pa.array(text)),
                 pa.array((at - a.words.bounds[text]).astype(np.int32))], names=["h1", "k1", "place"])

    return run


def _stretch_rows(window: int, lengths: list[int], level: int):
    """Rows of `level` from texts with, for each level before, the places that survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            a = _Anchors(b.column("text"), window, lengths[0])
            for before in range(level):
                places = b.column(f"places_{before}").to_pylist()
                known = np.concatenate([np.zeros(0, np.int64)] + [
                    np.asarray(p, np.int64) + base for p, base in zip(places, a.words.bounds) if p])
                a.keep(np.isin(a.stretches(lengths[before]), known))
            length = lengths[level]
            at = np.unique(a.stretches(length))
            where, h1 = a.words.windows(length, a.hashes)
            _, h2 = a.words.windows(length, a.words.hashes(1), 1)
            pick, text = np.searchsorted(where, at), a.words.text_of(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[pick].view(np.int64)), pa.array((h2[pick] >> np.uint64(33)).astype(np.int32)),
                 b.column("k1").take(pa.array(text)), b.column("rank").take(pa.array(text)),
                 pa.array((at - a.words.bounds[text]).astype(np.int32))], names=["h1", "h2", "k1", "rank", "place"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = split_words(b.column("text"))
            counts = np.diff(w.bounds)
            edges = np.zeros(len(w.starts) + 1, np.int64)
            rows = zip(b.column("places").to_pylist(), b.column("copy").to_pylist())
            for k, (places, copy) in enumerate(rows):
                if copy and counts[k] >= window:
                    edges[w.bounds[k]] += 1
                    edges[w.bounds[k + 1]] -= 1
                elif places:
                    at = np.unique(np.asarray(places, np.int64)) + w.bounds[k]
                    edges[at] += 1
                    edges[at + window] -= 1
            gone = np.cumsum(edges)[:-1] > 0
            raw, kept, removed = w.data.tobytes(), [], []
            for k in range(w.texts):
                part = slice(w.bounds[k], w.bounds[k + 1])
                stay = np.flatnonzero(~gone[part]) + w.bounds[k]
                removed.append(int(counts[k] - len(stay)))
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, start: int = 25) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay joined by one space."""
    lengths = level_lengths(window, start)
    d = tidy(docs, {"doc_id": "bigint", "text": "string"}).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7919), "text").alias("k2"))
    # One row for each text: the smallest rank among its documents.
    one = d.groupBy("k1", "k2").agg(F.min("rank").alias("least"))

    found = settle(d.mapInArrow(_anchor_rows(window, lengths[0]), "h1 long, k1 long, place int")) \
        if len(lengths) > 1 else None
    places = None  # k1 and the surviving places of each level so far

    def survivors(rows: DataFrame, keys: list[str]) -> DataFrame:
        # Written: joined straight from the aggregate, a passage in very many texts could not be split.
        often = settle(rows.groupBy(*keys).agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
                       .filter(F.col("low") != F.col("high")).select(*keys))
        return rows.join(often.hint("merge"), keys, "left_semi").groupBy("k1").agg(F.collect_set("place").alias("places"))

    def stretches(level: int) -> DataFrame:
        chosen = d
        if places is not None:
            chosen = d.join(places.hint("merge"), "k1")
        chosen = chosen.join(one.withColumnRenamed("k1", "o1").withColumnRenamed("k2", "o2"),
                             (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")) & (F.col("rank") == F.col("least")))
        return chosen.select("text", "k1", "rank", *[f"places_{n}" for n in range(level)]).mapInArrow(
            _stretch_rows(window, lengths, level), "h1 long, h2 int, k1 long, rank long, place int")

    for level in range(len(lengths) - 1):
        rows, keys = (found, ["h1"]) if level == 0 else (settle(stretches(level)), ["h1", "h2"])
        new = survivors(rows, keys).withColumnRenamed("places", f"places_{level}")
        places = new if places is None else places.join(new, "k1")
        places = settle(places)
    last = settle(stretches(len(lengths) - 1))
    least = settle(last.groupBy("h1", "h2").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
                   .filter(F.col("least") < F.col("most")).drop("most"))
    repeated = (
        last.join(least.hint("merge"), ["h1", "h2"]).filter(F.col("rank") > F.col("least"))
        .groupBy("k1", F.col("rank").alias("of")).agg(F.collect_list("place").alias("places"))
    )
    verdict = one.join(repeated, (one.k1 == repeated.k1) & (one.least == repeated.of), "left").select(
        one.k1, "k2", "least", "places")
    return (
        d.join(verdict.hint("merge"), ["k1", "k2"])
        .select("doc_id", "text", "places", (F.col("rank") > F.col("least")).alias("copy"))
        .mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string")
    )
