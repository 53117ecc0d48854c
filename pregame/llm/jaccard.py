"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, sorted-array intersection.

A document's set: its distinct word n-grams (A-Z in lower case); with fewer words, the whole sequence as
one; without words, empty. Two documents link when `100 * |intersection| >= percent * |union|`.

1. Documents with equal sets are one class; all later steps see one row per class.
2. N-grams are put in one order for all classes, rare ones first (a count sketch of fixed size tells how
   common they are; any order is correct). Two sets that link share one of the first
   `size - ceil(percent * size / 100) + 1` n-grams of both (prefix filter), and their sizes are close. So
   a tile is an n-gram together with a band of sizes; sets near a band's end are in the next one too. In the
   tile of the first n-gram that two sets share, only what follows it can be shared as well, so pairs whose
   remainders are too short are left out (positional filter).
3. Large groups of near copies would fill tiles with pairs that say the same thing. Before the tiles,
   every class is paired with three leaders per min-hash (stars, so as many pairs as rows), these pairs are
   verified, and what links is one group. One leader is the set with the commonest n-grams: an original has
   the n-grams that its edited copies share, while two copies differ by the edits of both. In the tiles, pairs within a group are left out: they cannot
   change a component. No other pair is. Where links are counted, the members of a group are dealt into blocks, and
   every two blocks meet in a task that intersects all their pairs and gives one number per member.
4. A pair's overlap is bounded from above by its bitmaps: each bit set in one only is an n-gram that the
   other lacks. What may still link is verified on the sorted arrays of n-gram hashes of the texts.

Tiles are sorted runs that stream through a task, never a collected group. Components of links are found
by contraction. N-gram hashes have 64 bits, set hashes 128.

Cases: NULL or empty texts have empty sets, link with nothing and are their own component; a NULL doc_id
takes part and is never a component's name unless all its documents have none; equal rows are members of
one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.llm.common import pieces, settle, tidy
from pregame.llm.components import components
from pregame.llm.words import mix, ranges_hash, split_words

SKETCH_BITS = 18
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in range(3, 9)]
BAND = 4.0  # a band's largest size over its smallest
TILE = 256  # rows of a tile whose pairs are made at once
BLOCK = 512  # members verified against one copy of their leader's text, or against each other
BLOCK_GRAMS = 1_000_000  # n-grams of a block of members that are verified against each other
COLUMNS = 4096  # n-grams that are laid out for all members of two blocks at once


@dataclass
class Sets:
    """The sets of a piece of texts, one after the other; hashes sorted within each."""
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def reduce(self, how, values: np.ndarray) -> np.ndarray:
        """`how` over each set; 0 where it is empty."""
        out = np.zeros(len(self.bounds) - 1, values.dtype)
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[full] = how.reduceat(values, self.bounds[:-1][full])
        return out


def sets_of(column: pa.Array, n: int) -> Sets:
    w = split_words(column, lower=True)
    words = w.hashes()
    first, hashes = w.windows(n, words)
    text = w.text_of(first)
    counts = np.diff(w.bounds)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        hashes = np.concatenate([hashes, ranges_hash(words, w.bounds[few], w.bounds[few + 1])])
        text = np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return Sets(hashes, np.searchsorted(text, np.arange(w.texts + 1)))


def _sketch_rows(n: int):
    """One row per document, and at the end of the task one per bucket of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "s1", "s2", "t1", "bucket", "hits"]
        for b in pieces(batches):
            s = sets_of(b.column("text"), n)
            counts += np.bincount((s.hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            s1, s2 = _set_hashes(s)
            nothing = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s.sizes.astype(np.int32)), pa.array(s1), pa.array(s2), b.column("t1"), nothing,
                 nothing.cast(pa.int64())], names=names)
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none.cast(pa.int32()), none, none, none, pa.array(used.astype(np.int32)), pa.array(counts[used])], names=names)

    return run


def _set_hashes(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    return (s.reduce(np.add, mix(s.hashes)).view(np.int64),
            s.reduce(np.add, mix(s.hashes ^ np.uint64(0xA5A5A5A5DEADBEEF))).view(np.int64))


def bitmap_bits(size: int) -> int:
    return 1 << max(6, min(14, int(2 * size - 1).bit_length()))


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first n-grams the prefix filter needs; 0 where only an equal set can link."""
    out = size - (percent * size + 99) // 100 + 1
    return np.where(100 * size < percent * (size + 1), 0, out)


def _class_rows(n: int, percent: int, common: np.ndarray):
    """The set of each text: hashes, leaders' keys, bitmap and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = sets_of(b.column("text"), n)
            s1, s2 = _set_hashes(s)
            keys = np.stack([s.reduce(np.minimum, mix(s.hashes ^ seed)) ^ seed for seed in SEEDS], axis=1)
            text = np.repeat(np.arange(len(s.sizes)), s.sizes)
            level = common[(s.hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((s.hashes, level, text))
            prefix = prefix_size(s.sizes, percent)
            central = s.reduce(np.add, level.astype(np.float64)) / np.maximum(s.sizes, 1)
            maps, prefixes = [], []
            for i, size in enumerate(s.sizes.tolist()):
                own = slice(s.bounds[i], s.bounds[i + 1])
                bits = np.zeros(bitmap_bits(size), np.uint8)
                bits[(s.hashes[own] & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).tobytes())
                prefixes.append(s.hashes[order[own][:prefix[i]]].view(np.int64))
            starts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            full = pa.array(s.sizes > 0)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s.sizes.astype(np.int32)), pa.array(s1), pa.array(s2), b.column("t1"),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(SEEDS)), pa.array(keys.ravel().view(np.int64))),
                 pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)), pa.array(central)],
                names=["doc_id", "n", "s1", "s2", "t1", "keys", "bits", "prefix", "central"])
            yield out.filter(full)

    return run


def _may_link(percent: int):
    """Keeps the pairs whose bitmaps leave room for enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) > len(y):
                    x = x.reshape(-1, len(y)) if len(y) >= 8 else x
                    x = np.bitwise_or.reduce(x, axis=0)
                while len(y) > len(x):
                    y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
                only_a = int(np.bitwise_count(x & ~y).sum())
                only_b = int(np.bitwise_count(y & ~x).sum())
                most = min(na[i] - only_a, nb[i] - only_b)
                keep[i] = 100 * most >= percent * (int(na[i]) + int(nb[i]) - most)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _verify(n: int, percent: int):
    """Rows of a block come leader first; its members are intersected with it one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leader, own = None, None, None
        for b in pieces(batches):
            s = sets_of(b.column("text"), n)
            out = []
            for i, (a, salt, member) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "salt", "member")))):
                mine = s.hashes[s.bounds[i]:s.bounds[i + 1]]
                if member is None:
                    block, leader, own = (a, salt), a, mine.copy()
                elif (a, salt) == block:
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        out.append((leader, member))
            a, m = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64())], names=["a", "b"])

    return run


def _linked(sets: list[np.ndarray], block: np.ndarray, percent: int) -> np.ndarray:
    """How many others each set links with; with two blocks, only those of the other block."""
    size = np.array([len(x) for x in sets], np.int64)
    member = np.repeat(np.arange(len(sets)), size)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # what one set has alone is in no intersection
    gram, member = (np.cumsum(shared) - 1)[gram[shared[gram]]], member[shared[gram]]
    order = np.argsort(gram, kind="stable")
    gram, member = gram[order], member[order]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), COLUMNS):
        own = slice(*np.searchsorted(gram, [start, start + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[member[own], gram[own] - start] = 1
        both += has @ has.T
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    if block[0] != block[-1]:
        link &= block[:, None] != block[None, :]
    return link.sum(axis=1)


def _count_links(n: int, percent: int):
    """Rows come sorted by (grp, low, high, block, cid), where blocks `low` and `high` of a group meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = None, []

        def out() -> pa.RecordBatch:
            cid, block, sets = zip(*held)
            counts = _linked(list(sets), np.array(block), percent)
            return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(counts, pa.int64())], names=["node", "c"])

        for b in pieces(batches):
            s = sets_of(b.column("text"), n)
            for i, (*key, block, cid) in enumerate(zip(*(b.column(c).to_pylist() for c in ("grp", "low", "high", "block", "cid")))):
                if key != met:
                    if held:
                        yield out()
                    met, held = key, []
                if not held or held[-1][0] != cid:  # equal rows of the table come one after the other
                    held.append((cid, block, s.hashes[s.bounds[i]:s.bounds[i + 1]].copy()))
        if held:
            yield out()

    return run


def _tile_pairs(percent: int):
    """Pairs of a tile from a run sorted by (tile, size): sizes must fit, enough must be left of both sets from
    their shared n-gram on, groups must differ."""

    def fits(size: np.ndarray, left: np.ndarray, i, j) -> np.ndarray:
        return np.minimum(left[i], left[j]) * (100 + percent) >= (size[i] + size[j]) * percent

    def emit(tile, cid, size, left, group) -> tuple[np.ndarray, np.ndarray]:
        if not len(tile):
            return cid, cid
        edge = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        end = np.repeat(edge[1:], np.diff(edge))
        # Partners of row i: the rows after it in its tile whose size is close enough.
        code = np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * (1 << 32)
        last = np.searchsorted(code + size, code + size * 100 // percent, "right")
        many = np.minimum(end, last) - np.arange(len(tile)) - 1
        first = np.repeat(np.arange(len(tile)), many)
        second = first + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        good = (group[first] != group[second]) & fits(size, left, first, second)
        first, second = first[good], second[good]
        return np.minimum(cid[first], cid[second]), np.maximum(cid[first], cid[second])

    def large(cid, size, left, group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A tile with many rows: only rows outside its largest group look for partners, one at a time, so
        memory stays in proportion to the tile and near copies cost nothing."""
        names, counts = np.unique(group, return_counts=True)
        others = np.flatnonzero(group != names[np.argmax(counts)])
        first = np.searchsorted(size * 100, size * percent, "left")
        last = np.searchsorted(size, size * 100 // percent, "right")
        for i in others:
            j = np.arange(first[i], last[i])
            b = cid[j[(group[j] != group[i]) & fits(size, left, i, j)]]
            yield np.minimum(cid[i], b), np.maximum(cid[i], b)

    def split(tile, cid, sized, group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(tile):
            return
        size, left = sized >> 32, (sized >> 32) - (sized & 0xFFFFFFFF)
        edge = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        rows = np.diff(edge)
        small = np.repeat(rows <= TILE, rows)
        yield emit(tile[small], cid[small], size[small], left[small], group[small])
        for k in np.flatnonzero(rows > TILE):
            own = slice(edge[k], edge[k + 1])
            yield from large(cid[own], size[own], left[own], group[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            rows = [np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("tile", "cid", "sized", "grp"))]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # tiles come in ascending order
            held = [r[cut:] for r in rows]
            for x, y in split(*[r[:cut] for r in rows]):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        for x, y in split(*held):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _with_classes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and bitmaps leave."""
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}"))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return (
        pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(close)
        .mapInArrow(_may_link(percent), "a long, b long")
    )


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link. Each text travels once for every leader it meets."""
    pairs = settle(pairs)
    # Written, like `smallest` below: joined straight from an aggregate, a hot key could not be split.
    sizes = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members")))
    salt = F.pmod(F.xxhash64(F.lit(3), "b"), F.ceil(F.col("members") / BLOCK)).cast("int")
    members = pairs.join(sizes.hint("merge"), "a").select("a", salt.alias("salt"), F.col("b").alias("member"))
    leaders = members.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("member"))
    rows = members.unionByName(leaders).withColumn("cid", F.coalesce("member", "a"))
    named = classes.select("cid", "t1", "first_id")
    texts = docs.join(rows.join(named.hint("merge"), "cid").withColumnRenamed("t1", "key").hint("merge"),
                      (F.col("t1") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    dealt = texts.select("a", "salt", "member", "text").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "salt")
    return dealt.sortWithinPartitions("a", "salt", F.col("member").asc_nulls_first()).mapInArrow(
        _verify(n, percent), "a long, b long").distinct()


def _group_links(groups: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """node, c: the number of links of each class within its group, from all pairs of the group."""
    members = settle(groups.select(F.col("component").alias("grp"), F.col("node").alias("cid")).join(
        classes.select("cid", "n", F.col("t1").alias("key"), "first_id").hint("merge"), "cid"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int")
    sizes = settle(members.groupBy("grp").agg(blocks.alias("blocks")))
    rows = members.join(sizes.hint("merge"), "grp").withColumn("block", F.pmod(F.xxhash64(F.lit(4), "cid"), "blocks").cast("int"))
    texts = docs.join(rows.hint("merge"), (F.col("t1") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    met = texts.select("grp", "block", "cid", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "text")
    key = ["grp", "low", "high"]
    dealt = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.sortWithinPartitions(*key, "block", "cid").mapInArrow(_count_links(n, percent), "node long, c long")


def similar_sets(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other classes that the document's class
    links with."""
    return grouped(docs, n, percent, counted=True).select("doc_id", "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with their columns, that stay when one row of each component stays: the one with the
    smallest doc_id (then the smallest text hash). Rows without words are in no component and all stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_t1", F.xxhash64(F.lit(11), text))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    chosen = (
        grouped(docs, n, percent).filter("n_shingles > 0").groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1")).alias("r"))
        .select(F.col("r.doc_id").alias("_id"), F.col("r.t1").alias("_key"))
    )
    kept = d.filter(worded).join(chosen.hint("merge"), (F.col("_t1") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_t1", "doc_id"]).unionByName(d.filter(~worded)).drop("_t1")


def grouped(docs: DataFrame, n: int, percent: int, counted: bool = False) -> DataFrame:
    """Like `similar_sets`, with `group` (NULL for an empty set) and `t1`, a hash of the text; `n_links` only if `counted`."""
    d = tidy(docs, {"doc_id": "bigint", "text": "string"}).withColumn("t1", F.xxhash64(F.lit(11), F.coalesce("text", F.lit(""))))
    seen = settle(d.mapInArrow(
        _sketch_rows(n), "doc_id long, n int, s1 long, s2 long, t1 long, bucket int, hits long"))
    # At most 2^18 numbers, whatever the input.
    hits = seen.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits").alias("hits")).toPandas()
    common = np.zeros(1 << SKETCH_BITS, np.uint8)
    common[hits.bucket.to_numpy(np.int64)] = np.log2(hits.hits.to_numpy(float)) * 8
    rows = seen.filter("bucket IS NULL").drop("bucket", "hits")

    wide = d.mapInArrow(_class_rows(n, percent, common), "doc_id long, n int, s1 long, s2 long, t1 long, "
                        "keys array<long>, bits binary, prefix array<long>, central double")
    classes = settle(
        wide.groupBy("s1", "s2").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1")).alias("first"),
                                     F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"),
                                     F.first("central").alias("central"))
        .select("s1", "s2", "n", F.col("first.doc_id").alias("first_id"), F.col("first.t1").alias("t1"), "keys", "bits", "prefix", "central",
                F.monotonically_increasing_id().alias("cid"))
    )
    band = lambda size: F.floor(F.log(F.col(size).cast("double")) / F.log(F.lit(BAND))).cast("long")
    small = classes.filter(F.size("prefix") > 0)  # the others link with equal sets only

    starred = small.select("cid", "central", F.posexplode("keys").alias("which", "key"), band("n").alias("band"))
    leaders = (
        starred.groupBy("which", "key", "band").agg(
            F.min("cid").alias("low"), F.max("cid").alias("high"), F.max(F.struct("central", "cid")).getField("cid").alias("centre"))
        .filter("low < high")
    )
    stars = (
        starred.join(leaders.hint("merge"), ["which", "key", "band"])
        .select("cid", F.explode(F.array_distinct(F.array("low", "high", "centre"))).alias("leader")).filter("cid <> leader")
        .select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    )
    near = settle(_links(_with_classes(stars, classes, percent), classes, d, n, percent))
    groups = settle(components(near))

    tiled = small.join(groups.hint("merge"), F.col("cid") == F.col("node"), "left").select(
        "cid", F.col("n").alias("size"), F.coalesce("component", "cid").alias("grp"), "prefix")
    low = band("size")
    high = F.floor(F.log(F.floor(F.col("size") * 100 / percent).cast("double")) / F.log(F.lit(BAND))).cast("long")
    tiled = (
        tiled.withColumn("band", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
        .select("cid", "size", "grp", "band", F.posexplode("prefix").alias("place", "gram"))
        .select(F.xxhash64("gram", "band").alias("tile"), "cid", "grp",
                (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).alias("sized"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (
        tiled.repartition(parts, "tile").sortWithinPartitions("tile", "sized", "cid")
        .mapInArrow(_tile_pairs(percent), "a long, b long").distinct()
    )
    more = settle(_links(_with_classes(pairs, classes, percent), classes, d, n, percent))

    links = settle(near.unionByName(more))
    names = components(links)
    member = (
        classes.select("s1", "s2", "first_id", "cid").join(names.hint("merge"), F.col("cid") == F.col("node"), "left").drop("node")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    smallest = settle(member.groupBy("component").agg(F.min("first_id").alias("component_id")))
    member = member.join(smallest.hint("merge"), "component").select(
        F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.col("component").alias("group"), "component_id", "cid")
    if counted:
        # `more` has the links between groups, each once.
        ends = more.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("c"))
        degree = ends.unionByName(_group_links(groups, classes, d, n, percent)).groupBy("node").agg(F.sum("c").alias("n_links"))
        member = member.join(degree.hint("merge"), F.col("cid") == F.col("node"), "left")
    count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    return (
        rows.join(member.hint("merge"), (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2")), "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                *count, "group", "t1")
    )
