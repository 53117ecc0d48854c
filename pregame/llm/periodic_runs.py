"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
`least` and 3 q words that no neighbouring word extends. Runs are found in three steps, for all texts of a
piece at once (words are numbers there, and between two texts stands a number that occurs nowhere else):

* Periods up to `SHORT` are read off directly: for each lag, the stretches whose words equal those `lag`
  words on, if they are long enough.
* Greater periods fall into scales (low, high]. Positions are sampled that have the smallest hash of SHORT
  words in some window, the first of equals; windows double from scale to scale, and the samples of a scale
  are taken from those of the scale before. At each sample stands the hash of the next `high` words.
  Of equal ones, neighbours at a distance within the scale are seeds. Why none is missed: a window inside a
  run and the window q on hold the same words, so both have their sample in the same place; a window that
  fits (`width` words and q + high - 1 more in 3 q) shows both in full; and as high >= q, no sample between
  them can show the same words, else q would not be the smallest period.
* Seeds of one lag that touch are joined and extended word by word to both sides. What is long enough and
  has no smaller period is a run. Words are compared as they are, so a clash of hashes cannot make a run.

Time is O(n log n) in the words of a text. A row is worked on where it is read; nothing is exchanged.

Cases: a NULL or empty text has no words and no runs, and its collapsed text is empty; runs never reach
over two rows; repeated rows and rows with NULL ids each give their own row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import BLANKS, pieces, tidy
from pregame.llm.words import Words, mix, ranges_hash, split_words

SHORT = 8
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def scales(longest: int) -> list[tuple[int, int, int]]:
    """(low, high, width): periods above `low` and up to `high`, sampled over windows of `width`, a power of two."""
    out, low = [], SHORT
    while 3 * (low + 1) <= longest:
        high = low + low // 2
        width = 1 << ((2 * low + 3 - high).bit_length() - 1)  # the greatest that fits: width - 1 + q + high <= 3 q
        out.append((low, high, width))
        low = high
    return out


def word_numbers(words: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each distinct word of the piece, and the words themselves."""
    lengths = words.ends - words.starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    letters = words.data[np.cumsum(inside[:-1]).astype(bool)]
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = each.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), each


def _with_bars(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with a bar after each text, and where each text starts then."""
    texts = len(bounds) - 1
    starts = bounds[:-1] + np.arange(texts)
    x = np.empty(len(numbers) + texts, np.int64)
    bars = bounds[1:] + np.arange(texts)
    here = np.ones(len(x), bool)
    here[bars] = False
    x[here] = numbers
    x[bars] = -1 - np.arange(texts)
    return x, starts


def _short(x: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of the stretches with period `lag`."""
    unequal = np.flatnonzero(x[lag:] != x[:-lag])
    edges = np.concatenate([[-1], unequal, [len(x) - lag]])
    long = np.flatnonzero(np.diff(edges) - 1 + lag >= max(least, 3 * lag))
    for i in long.tolist():
        yield int(edges[i]) + 1, int(edges[i + 1]) + lag, lag


def _block_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the SHORT numbers from each place on, mixed after every step."""
    own = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = len(x) - SHORT + 1
    h = own[:n].copy()
    for i in range(1, SHORT):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += own[i:n + i]
    return mix(h)


def _narrow(at: np.ndarray, h: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of the samples for windows of half the width, those for `width`: for each window the first smallest of its two halves."""
    half = width // 2
    left, right = at[:max(n - width + 1, 0)], at[half:half + max(n - width + 1, 0)]
    return np.where(h[right] < h[left], right, left)


def _extend(x: np.ndarray, start: int, end: int, lag: int) -> tuple[int, int]:
    """The greatest stretch of places i with x[i] == x[i + lag] around x[start:end], which is taken as such."""
    step, limit = 64, len(x) - lag
    while end < limit:
        stop = min(end + step, limit)
        odd = np.flatnonzero(x[end:stop] != x[end + lag:stop + lag])
        if len(odd):
            end += int(odd[0])
            break
        end, step = stop, 2 * step
    step = 64
    while start > 0:
        first = max(start - step, 0)
        odd = np.flatnonzero(x[first:start] != x[first + lag:start + lag])
        if len(odd):
            start = first + int(odd[-1]) + 1
            break
        start, step = first, 2 * step
    return start, end


def _seeded(x: np.ndarray, lengths_left: np.ndarray, longest: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of the stretches with greater periods."""
    if longest < 3 * (SHORT + 1):
        return
    h = _block_hashes(x)
    n = len(h)
    samples, width_now = np.arange(n), 1
    for low, high, width in scales(longest):
        while width_now < width:
            width_now *= 2
            samples = _narrow(samples, h, width_now, n)
        at = np.unique(samples)
        at = at[lengths_left[at] >= high]  # `high` words from here on are in the same text
        if not len(at):
            return
        shown = ranges_hash(h, at, at + high - SHORT + 1)
        order = np.argsort(shown, kind="stable")
        first, then = at[order[:-1]], at[order[1:]]
        lag = then - first
        seeds = (shown[order[:-1]] == shown[order[1:]]) & (lag > low) & (lag <= high)
        first, lag = first[seeds], lag[seeds]
        if not len(first):
            continue
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (first[1:] > first[:-1] + high)])
        last = np.concatenate([np.flatnonzero(new)[1:], [len(first)]]) - 1
        for a, b, d in zip(first[new].tolist(), first[last].tolist(), lag[new].tolist()):
            # A seed says that the words from a to b + high have period d. Each stretch in there counts by itself.
            begin, end = _extend(x, a, a, d)
            while begin < b + high:
                if end - begin + d >= max(least, 3 * d):
                    yield begin, end + d, d
                begin = end + 1
                begin, end = _extend(x, begin, begin, d)


def _has_smaller_period(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """A smaller period of three periods or more divides this one; one prime factor at a time will do."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            shorter = period // factor
            if np.array_equal(x[start:end - shorter], x[start + shorter:end]):
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def runs_of(numbers: np.ndarray, bounds: np.ndarray, least: int = 24) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    counts = np.diff(bounds)
    if not len(numbers) or counts.max() < least:
        return out
    x, starts = _with_bars(numbers, bounds)
    longest = int(counts.max())
    left = np.repeat(starts + counts, counts + 1) - np.arange(len(x))
    found = set()
    for lag in range(1, min(SHORT, longest // 3) + 1):
        found.update(_short(x, lag, least))
    found.update(_seeded(x, left, longest, least))
    for start, end, period in sorted(found, key=lambda r: (r[0], r[2])):
        if not _has_smaller_period(x, start, end, period):
            text = int(np.searchsorted(starts, start, "right")) - 1
            out[text].append((start - int(starts[text]), end - start, period))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(docs: DataFrame, least: int = 24) -> DataFrame:
    """doc_id, n_words, `runs` by start, then period, `best` (the run of the greatest exponent, the first of equals)
    and `collapsed`: the words outside runs and those of each run's first period, joined by one space.

    A word goes when any run holds it behind that run's first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in pieces(batches):
            w = split_words(b.column("text"))
            numbers, each = word_numbers(w)
            runs = runs_of(numbers, w.bounds, least)
            edges = np.zeros(len(numbers) + 1, np.int64)
            for base, of_text in zip(w.bounds.tolist(), runs):
                for start, length, period in of_text:
                    edges[base + start + period] += 1
                    edges[base + start + length] -= 1
            stay = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
            kept = pa.LargeListArray.from_arrays(np.searchsorted(stay, w.bounds), each.take(pa.array(stay)))
            collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
            as_rows = [[dict(zip(("start", "length", "period"), r)) for r in of_text] for of_text in runs]
            best = [None if (r := greatest(of_text)) is None else dict(zip(("start", "length", "period"), r)) for of_text in runs]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(w.bounds), pa.int64()), pa.array(as_rows, pa.list_(kind)),
                 pa.array(best, kind), collapsed],
                names=["doc_id", "n_words", "runs", "best", "collapsed"])

    d = tidy(docs, {"doc_id": "bigint", "text": "string"})
    found = d.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of one line `start,length,period` for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(runs, line), ""), 256)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by a checksum of its id) is made periodic from some word on.

    With h the CRC-32 of the decimal id and g = h div 10: if h mod 10 is 0, each word i >= a becomes word
    a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). The words are joined by one space.
    """
    d = tidy(docs, {"doc_id": "bigint", "text": "string"})
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Texts that stay are not split.
    words = F.when((h % 10 == 0) & (F.btrim("text", F.lit(BLANKS)) != ""),
                   F.split(F.btrim("text", F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+", -1))
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    tail = F.transform(F.sequence(F.col("_a"), n - 1), lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return (
        d.withColumn("_words", words).withColumn("_g", g).withColumn("_a", a).withColumn("_p", p)
        .select("doc_id", F.when(F.col("_words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
    )
