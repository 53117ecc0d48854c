"""Mixing sources to target weights by fixed-length blocks of words.

1. The words of a source, document after document, are one long stream, cut into blocks of
   `block_words`. Where a document starts in the stream is a two-level running sum (within a bucket of
   documents, then over the buckets), so a hot source is spread over many tasks.
2. Sources get targets: their weight's share of all words, never above `most` times their own size; the
   excess goes to the others by weight.
3. The number of blocks that a source gives is drawn per output shard: a multinomial draw over the
   shards, given the source's total.
4. The slots of a source, numbered over the shards, run through pseudorandom permutations of its block
   numbers, one permutation per pass: every block is used k or k + 1 times, and at most `most` times.
5. Slots and documents' blocks are joined by (source, block).

Everything depends on the rows and `seed` only, so reruns agree. Cases: a NULL or empty text has no words
and takes none; a NULL source is a source, the last in order; rows equal in doc_id, source and text are
numbered copies, each with its own place in the stream; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregame.llm.common import DOCUMENTS, row_key, settle, tidy

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = {"doc_id": "bigint", "text": "string", "source": "string"}


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size, target. `sizes` has one row per source, which is all that these windows see."""
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (
        sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("most") / F.col("w"))
    )
    # In order of `level`, the sources before some place stand at their maximum; the first one whose
    # level exceeds what is left per weight, and all after it, share that by weight.
    order = everything.orderBy("level", "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
        .withColumn("free", F.col("level") > F.col("left") / F.col("rest"))
    )
    first = F.min(F.when(F.col("free"), F.struct("level", "place", "left", "rest"))).over(everything)
    s = s.withColumn("first", first)
    fixed = F.col("first").isNull() | (F.struct("level", "place") < F.struct("first.level", "first.place"))
    return s.select(
        "source", "source_size",
        F.when(fixed, F.col("most")).otherwise(F.col("first.left") * F.col("w") / F.col("first.rest")).alias("target"),
    )


def permute(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each seed: a Feistel network that walks until it is inside."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    limit, seed = size.astype(np.uint64), seed.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, b, m, s = out[todo], bits[todo], mask[todo], seed[todo]
        left, right = x >> b, x & m
        for turn in range(4):
            f = right * np.uint64(0x9E3779B97F4A7C15) + s + np.uint64(0x632BE59BD9B4E019 * (turn + 1) & (2**64 - 1))
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _draws(shards: int, seed: int):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, slots, blocks in zip(b.sid, b.slots, b.blocks):
                counts = np.random.default_rng([seed, int(sid) & (2**63 - 1)]).multinomial(int(slots), [1 / shards] * shards)
                firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                rows += [(sid, k, int(f), int(c), blocks) for k, (f, c) in enumerate(zip(firsts, counts)) if c]
            yield pd.DataFrame(rows, columns=["sid", "out_shard", "first", "count", "blocks"])

    return draw


def _permuted(seed: int):
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn, index = np.divmod(b.slot.to_numpy(np.int64), b.blocks.to_numpy(np.int64))
            seeds = b.sid.to_numpy(np.int64) + turn * 1_000_003 + seed
            yield pd.DataFrame({"sid": b.sid, "out_shard": b.out_shard, "slot": b.slot,
                                "block": permute(index, b.blocks.to_numpy(np.int64), seeds)})

    return apply


def place_in_stream(docs: DataFrame, buckets: int = 1024) -> DataFrame:
    """key_a, key_b, copy, doc_id, source, size and `start`, the first word's place in its source's stream."""
    d = tidy(docs, COLUMNS)
    d = d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                 *row_key("doc_id", "source", "text"))
    d = d.groupBy("key_a", "key_b").agg(
        F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"),
        F.count(F.lit(1)).alias("copies"))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    d = settle(d.withColumn("bucket", F.pmod("key_b", F.lit(buckets))))
    within = Window.partitionBy("source", "bucket").orderBy("key_a", "key_b", "copy")
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("base"))
    d = d.withColumn("inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return d.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "key_a", "key_b", "copy", "doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, block_words: int = 128,
        shards: int = 64, seed: int = 20240229, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(documents, slots). `documents`: key_a, key_b, copy, doc_id, source, size, source_size, target, taken and
    `pieces`, the word ranges [from, to) taken with how often each. `slots`: sid, out_shard, slot, block."""
    placed = settle(place_in_stream(docs, buckets))
    sid = F.xxhash64(F.lit(5), F.col("source"))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settle(
        source_targets(sizes, weights, most).withColumn("sid", sid)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
        .withColumn("slots", F.when(F.col("source_size") == 0, 0).otherwise(F.least(
            F.col("blocks") * most, F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).cast("long"))
    )
    chunk = 10_000
    dealt = (
        sources.filter("slots > 0").select("sid", "slots", "blocks")
        .mapInPandas(_draws(shards, seed), "sid long, out_shard int, first long, count long, blocks long")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {chunk}"))))
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "out_shard", "chunk")
        .select("sid", "out_shard", "blocks", F.explode(F.sequence(
            F.col("first") + F.col("chunk") * chunk,
            F.least(F.col("first") + F.col("count"), F.col("first") + (F.col("chunk") + 1) * chunk) - 1)).alias("slot"))
        .mapInPandas(_permuted(seed), "sid long, out_shard int, slot long, block long")
    )
    times = dealt.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.expr(f"(start + size - 1) div {block_words}")
    parts = (
        placed.filter("size > 0").withColumn("sid", sid)
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)))
        .select("key_a", "key_b", "copy", "sid", "block",
                (F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")).alias("from"),
                (F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")).alias("to"))
    )
    # Catalyst sees a few rows per source below the slots and would broadcast them all.
    taken = (
        parts.join(times.hint("merge"), ["sid", "block"])
        .groupBy("key_a", "key_b", "copy").agg(
            F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"),
            F.sort_array(F.collect_list(F.struct("from", "to", "times"))).alias("pieces"))
    )
    out = (
        placed.join(taken, ["key_a", "key_b", "copy"], "left")
        .join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
        .select("key_a", "key_b", "copy", "doc_id", "source", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces")
    )
    return out, dealt


_word = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(columns: list[str], most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                text, ends = r["text"], None
                for turn in range(most):
                    parts = [(p["from"], p["to"]) for p in r["pieces"] if p["times"] > turn]
                    if not parts:
                        break
                    merged = [list(parts[0])]
                    for start, end in parts[1:]:
                        if start == merged[-1][1]:
                            merged[-1][1] = end
                        else:
                            merged.append([start, end])
                    if merged == [[0, r["size"]]]:
                        cut = text
                    else:
                        ends = ends or [m.span() for m in _word.finditer(text)]
                        cut = "\n".join(text[ends[s][0]:ends[e - 1][1]] for s, e in merged)
                    rows.append({**{c: r[c] for c in columns}, "text": cut, "n_chars": len(cut)})
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in ("doc_id", "n_chars") if c in columns})

    return run


def mixed_texts(docs: DataFrame, most: int = 3, **options) -> DataFrame:
    """The mix as rows with the columns of documents: one row for each time that words of a document are taken,
    with the words taken then (the text itself where all are)."""
    d = tidy(docs, DOCUMENTS)
    out, _ = mix(d, most=most, **options)
    taken = out.filter("taken > 0").select("key_a", "key_b", "size", "pieces")
    texts = d.select("*", *row_key("doc_id", "source", "text")).dropDuplicates(["key_a", "key_b"])
    schema = ", ".join(f"{c} {t}" for c, t in DOCUMENTS.items())
    return (
        texts.join(taken.hint("merge"), ["key_a", "key_b"])
        .select(*DOCUMENTS, "size", "pieces").mapInPandas(_texts(list(DOCUMENTS), most), schema)
    )
