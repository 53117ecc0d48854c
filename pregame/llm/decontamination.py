"""Benchmark decontamination by the q-gram lemma.

Texts are normalised: A-Z in lower case, every run of `[\\x20\\x09-\\x0D]` one blank. If some region of a
document is within `k` edits of an item of `m` characters, the two share at least `m + 1 - q * (k + 1)`
q-grams, and their places differ by the same amount up to `k`. So, per document:

1. q-grams of the document that occur in the item set are looked up (a bitmap first, then binary search);
2. each shared q-gram votes for its item in the two overlapping diagonal bands that its diagonal lies
   in; bands are wider than twice the edit budget, so every region lies whole in one of them;
3. bands with fewer votes than the lemma asks for are dropped, the others are verified by a banded
   alignment with free ends in the document.

The edit budget of an item is `edits` of its length; `q` is the largest of `q_sizes` for which the lemma
still asks for a fifth of the item's q-grams. Items shorter than `min_chars` characters are matched as
they are (no edits), as whole words.

The items are a query set. They are taken in blocks of at most `block_chars` characters; a block is what
tasks hold in memory, and every block meets all documents. Cases: NULL or empty texts and items match
nothing; an item that occurs twice in a document is reported once, with its best region; equal items are
reported each; equal rows are reported each; an empty table on either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pregame.llm.common import pieces, tidy
from pregame.llm.words import BLANK, LOWER, ranges_hash

SCHEMA = "doc_id long, item_id long, edits int, from_char long, to_char long"


def normal(text: str | None) -> str:
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    blank = BLANK[raw]
    raw = np.where(blank, np.uint8(32), raw)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return raw[keep].tobytes().decode().strip(" ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    first = np.arange(max(0, len(codes) - q + 1))
    return ranges_hash(codes + np.uint64(1), first, first + q)


@dataclass
class Item:
    item_id: int
    text: str
    budget: int


class Block:
    """Items that share one q, with the q-grams that vote, in hash order.

    An item's commonest q-grams (over the block) need not vote: of `v` voting ones `v - q * k` survive any
    `k` edits. They are left out as long as a tenth of the item's q-grams must still be found.
    """

    def __init__(self, q: int, items: list[Item]):
        self.q, self.items = q, items
        self.codes = [_codes(i.text) for i in items]
        hashes = [grams(c, q) for c in self.codes]
        every = np.concatenate(hashes)
        names, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        chosen, needed, at = [], [], 0
        for item, own in zip(items, hashes):
            many = counts[inverse[at:at + len(own)]]
            lost, least = q * item.budget, max(1, int(0.1 * len(own)))
            voters = np.sort(np.argsort(many, kind="stable")[:min(len(own), lost + least)])
            chosen.append(voters)
            needed.append(len(voters) - lost)
            at += len(own)
        voting = np.concatenate([h[v] for h, v in zip(hashes, chosen)])
        order = np.argsort(voting, kind="stable")
        self.hashes = voting[order]
        self.item = np.repeat(np.arange(len(items)), [len(v) for v in chosen])[order]
        self.place = np.concatenate(chosen)[order]
        self.bits = max(20, int(len(voting) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True
        self.half = np.array([2 * i.budget + 2 for i in items])
        self.reach = max(len(c) + i.budget for c, i in zip(self.codes, items))
        self.needed = np.array(needed)

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of the bands with enough shared q-grams."""
        found = grams(codes, self.q)
        at = np.flatnonzero(self.seen[found >> np.uint64(64 - self.bits)])
        left = np.searchsorted(self.hashes, found[at], "left")
        many = np.searchsorted(self.hashes, found[at], "right") - left
        at, left, many = at[many > 0], left[many > 0], many[many > 0]
        if not len(at):
            return []
        which = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, place, spot = self.item[which], self.place[which], np.repeat(at, many)
        # A region lies within two neighbouring cells of `reach` characters; leave out those with too few votes.
        cells = len(codes) // self.reach + 3
        cell = item * cells + spot // self.reach + 1
        votes = np.bincount(cell, minlength=cells * len(self.items))
        pair = votes + np.concatenate([votes[1:], [0]])
        enough = (np.maximum(pair, np.concatenate([[0], pair[:-1]])) >= np.repeat(self.needed, cells))[cell]
        item, place, spot = item[enough], place[enough], spot[enough]
        # An item's q-gram counts once per band, however often the text repeats it.
        band = (spot - place + self.reach) // self.half[item]
        item, place = np.concatenate([item, item]), np.concatenate([place, place])
        band = np.concatenate([band, band - 1])  # band b covers the diagonals from b * half to (b + 2) * half
        order = np.lexsort((place, band, item))
        item, band, place = item[order], band[order], place[order]
        edge = np.ones(len(item), bool)
        edge[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        new = edge.copy()
        new[1:] |= place[1:] != place[:-1]
        starts = np.flatnonzero(edge)
        votes = np.add.reduceat(new, starts, dtype=np.int64) if len(starts) else starts
        out = []
        for k in np.flatnonzero(votes >= self.needed[item[starts]]):
            which = int(item[starts[k]])
            low = int(band[starts[k]]) * int(self.half[which]) - self.reach
            out.append((which, low, low + 2 * int(self.half[which]) - 1))
        return out


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of `doc` within the diagonals, free at the document's side;
    None above `budget`. One row per item character, kept to the band; the horizontal steps of a row are a
    running minimum."""
    m, n = len(item), len(doc)
    low, high = low - budget, high + budget
    width = high - low + 1
    big = 1 << 20
    # Cell c of row r stands for doc prefix of length r + low + c.
    column = np.arange(width)
    ends = low + column
    cost = np.where((ends >= 0) & (ends <= n), 0, big)
    start = ends.copy()
    for r in range(1, m + 1):
        ends = r + low + column
        valid = (ends >= 0) & (ends <= n)
        there = np.clip(ends - 1, 0, max(0, n - 1))
        same = (doc[there] == item[r - 1]) & (ends >= 1) & (ends <= n) if n else np.zeros(width, bool)
        step = np.where(ends >= 1, cost + ~same, big)          # match or replace
        skip = np.concatenate([cost[1:], [big]]) + 1           # item character left out
        from_skip = np.concatenate([start[1:], [0]])
        best = np.where(skip < step, skip, step)
        origin = np.where(skip < step, from_skip, start)
        best = np.where(valid, best, big)
        # Document characters put in: best[c] = min over c' <= c of best[c'] + (c - c').
        slope = best - column
        low_so_far = np.minimum.accumulate(slope)
        mark = np.maximum.accumulate(np.where(slope == low_so_far, column, -1))
        cost = np.where(valid, low_so_far + column, big)
        start = origin[mark]
        if cost.min() > budget:
            return None
    c = int(np.argmin(cost))
    return None if cost[c] > budget else (int(cost[c]), int(start[c]), int(m + low + c))


def _whole_words(item: str, text: str) -> int:
    at = text.find(item)
    while at >= 0:
        if (at == 0 or text[at - 1] == " ") and (at + len(item) == len(text) or text[at + len(item)] == " "):
            return at
        at = text.find(item, at + 1)
    return -1


def build(rows: list[tuple[int, str]], edits: float, q_sizes: tuple[int, ...], min_chars: int):
    """Blocks by q, and the short items."""
    by_q: dict[int, list[Item]] = {}
    short: list[tuple[int, str]] = []
    for item_id, text in rows:
        m, budget = len(text), int(edits * len(text))
        fits = [q for q in q_sizes if m >= min_chars and m + 1 - q * (budget + 1) >= 0.2 * (m - q + 1)]
        if fits:
            by_q.setdefault(max(fits), []).append(Item(item_id, text, budget))
        elif m:
            short.append((item_id, text))
    return [Block(q, items) for q, items in by_q.items()], short


def _search(rows: list[tuple[int, str]], edits: float, q_sizes: tuple[int, ...], min_chars: int):
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(build(rows, edits, q_sizes, min_chars))
        blocks, short = made[0]
        # So many characters between two texts that no region reaches over them.
        gap = "\x00" * (max([i.budget for b in blocks for i in b.items], default=0) + 2)
        for batch in pieces(batches):
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            whole = gap.join(texts)
            lengths = np.array([len(t) for t in texts])
            begins = np.cumsum(lengths + len(gap)) - lengths - len(gap)
            codes = _codes(whole)
            best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
            for number, block in enumerate(blocks):
                for k, low, high in block.candidates(codes):
                    item = block.items[k]
                    at = whole.find(item.text, max(0, low), max(0, high) + len(item.text))
                    found = (0, at, at + len(item.text)) if at >= 0 else align(block.codes[k], codes, low, high, item.budget)
                    if found:
                        # An alignment may replace item characters by those of a gap instead of leaving them out, at the
                        # same cost: the text is the one in which the region ends, and the region is cut to it.
                        cost, start, end = found
                        row = int(np.searchsorted(begins, end - 1, "right")) - 1
                        first = int(begins[row])
                        found = (cost, max(start, first), min(end, first + int(lengths[row])))
                        key = (row, number, k)
                        best[key] = min(found, best.get(key, found))
            out = [(row, blocks[n].items[k].item_id, e, s - begins[row], t - begins[row]) for (row, n, k), (e, s, t) in best.items()]
            for item_id, item in short:
                for row, text in enumerate(texts):
                    at = _whole_words(item, text)
                    if at >= 0:
                        out.append((row, item_id, 0, at, at + len(item)))
            rows_, ids, costs, froms, tos = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows_, pa.int64())), pa.array(ids, pa.int64()), pa.array(costs, pa.int32()),
                 pa.array(froms, pa.int64()), pa.array(tos, pa.int64())],
                names=["doc_id", "item_id", "edits", "from_char", "to_char"])

    return run


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for r in tidy(benchmark, {"item_id": "bigint", "text": "string"}).toLocalIterator(prefetchPartitions=False):
        text = normal(r.text)
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.12, q_sizes: tuple[int, ...] = (3, 4, 5, 6),
                 min_chars: int = 40, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, edits, and the region [from_char, to_char) of the normalised text; one row per document row and item."""
    spark = docs.sparkSession
    d = tidy(docs, {"doc_id": "bigint", "text": "string"})
    out = None
    for rows in item_blocks(benchmark, block_chars):
        part = d.mapInArrow(_search(rows, edits, q_sizes, min_chars), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.12, q_sizes: tuple[int, ...] = (3, 4, 5, 6),
                      min_chars: int = 40, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, with their columns, that hold no item; texts stay where they are, one pass per block."""

    def without(rows: list[tuple[int, str]]):
        search = _search(rows, edits, q_sizes, min_chars)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                numbered = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("text")], names=["doc_id", "text"])
                keep = np.ones(b.num_rows, bool)
                for found in search(iter([numbered])):
                    keep[found.column("doc_id").to_numpy()] = False
                yield b.filter(pa.array(keep))

        return run

    for rows in item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(without(rows), docs.schema)
    return docs
