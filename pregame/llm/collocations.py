"""Phrase collocations by weighted acyclic automata.

Texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into words `[^\\x20\\x09]+`, with A-Z lower-cased.

1. `encode` writes the corpus as shards of about a million words of one language: distinct words and one
   number per word, 0 between pieces. All further steps read this table, so a lost executor changes nothing; it is
   bucketed by shard, so that what comes back to a shard meets it without moving it.
2. Which n-grams can be frequent is found length by length. A shard counts the hashes of all words and pairs, and
   of those longer n-grams whose two (n-1)-grams are still in; one exchange sums them over the shards, and what reaches `least`
   goes back to the shards it came from. Hashes of different phrases may clash, so this only lets too many in.
   A shard sends each range of hashes one block, sorted and as differences. Of each length it sends at most as many
   hashes as it has words; how many pass the sift grows faster than the text, as `least` does not grow with it.
3. Each shard sorts its phrases that are in and builds a count automaton of them, by exact words.
4. The automata are cut into prefix ranges (of nearly equal numbers of phrases, from every 64th phrase),
   and the parts of a range are united, weights summed. What does not reach `least` falls out here, exactly.
5. Each range builds an acceptor of the parts that its phrases are cut into; acceptors go to the ranges of
   their parts and are composed with the counts there. Every part has a count, as it is as frequent as its phrase.
6. Scores, containment and ranks are joins and aggregates over the phrases with a count of `least` or more.

No step takes a key's rows into one task: a hash or a phrase comes at most once from each shard. What reaches
the driver are cut points, 65,536 at most.

Cases: a NULL text is empty, a NULL language is `und`; a piece is never cut, so a text without stops is one shard
at most; rows with equal text or id all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pregame.llm.automata import Automaton, Phrase, Union, summed
from pregame.llm.common import pieces, settle, shared_folder, tidy
from pregame.llm.words import LOWER, column_bytes, mix, ranges_hash

SHARD_WORDS = 1_000_000
HELD_WORDS = 4_000_000
HASH_BITS, RANGE_WORDS = 40, 4_000_000
SAMPLED, PER_RANGE, MOST_RANGES = 64, 500, 1 << 16

STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = STOP.copy()
GAP[[0x20, 0x09]] = True


# -- 1. shards -------------------------------------------------------------------------------


def _words_and_breaks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and whether each begins a piece."""
    data, offsets = column_bytes(column)
    data = LOWER[data]
    inside = ~GAP[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    where = np.zeros(len(ends) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(data[inside])])
    marks = np.cumsum(STOP[data])[starts] + np.searchsorted(offsets, starts, "right") * (len(data) + 1)
    new = np.ones(len(starts), bool)
    new[1:] = marks[1:] != marks[:-1]
    return words, new


class _Shard:
    """The words of one language that a task has met since its last shard."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, words: pa.Array, new: np.ndarray) -> None:
        coded = words.dictionary_encode()
        numbers = self.numbers
        own = np.array([numbers.setdefault(w, len(numbers) + 1) for w in coded.dictionary.to_pylist()], np.int32)
        ids = own[coded.indices.to_numpy(zero_copy_only=False)]
        self.parts.append(np.insert(ids, np.flatnonzero(new), 0))
        self.words += len(ids)

    def row(self, lang: str | None) -> dict:
        ids = np.concatenate(self.parts)
        return {"lang": lang, "n": self.words, "words": b"\n".join(self.numbers), "ids": ids.tobytes()}


SHARD = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, _Shard] = {}

    def out(lang: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held.pop(lang).row(lang)], SHARD)

    for b in pieces(batches):
        rows: dict[str | None, list[int]] = {}
        for i, lang in enumerate(b.column("lang").to_pylist()):
            rows.setdefault(lang, []).append(i)
        for lang, at in rows.items():
            words, new = _words_and_breaks(b.column("text").take(pa.array(at)))
            first = np.flatnonzero(new)
            start = 0
            while start < len(words):  # a very long text gives several shards, cut between pieces
                stop = first[min(np.searchsorted(first, start + SHARD_WORDS), len(first) - 1)] if len(words) - start > SHARD_WORDS else 0
                stop = int(stop) if stop > start else len(words)
                shard = held.setdefault(lang, _Shard())
                shard.add(words.slice(start, stop - start), new[start:stop])
                if shard.words >= SHARD_WORDS:
                    yield out(lang)
                start = stop
        while sum(s.words for s in held.values()) > HELD_WORDS:
            yield out(max(held, key=lambda k: held[k].words))
    for lang in list(held):
        yield out(lang)


def encode(docs: DataFrame) -> DataFrame:
    """The corpus as shards: shard, lang, n (words), words (by newline), ids (32-bit numbers of words from 1; 0 begins a piece)."""
    d = tidy(docs, {"text": "string", "lang": "string"}).withColumn("lang", F.coalesce("lang", F.lit("und")))
    rows = d.mapInArrow(_encode, "lang string, n long, words binary, ids binary")
    # Numbered as it is written; whoever reads the table sees the same numbers.
    return settle_in_buckets(rows.withColumn("shard", F.monotonically_increasing_id()), "shard")


def settle_in_buckets(df: DataFrame, key: str) -> DataFrame:
    """Write `df` to the shared folder in buckets of `key`: joins by it need no exchange of this side, however often."""
    spark = df.sparkSession
    name = f"settled_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/settled/{name}").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files lie outside the warehouse and stay
    return written


# -- 2. n-grams that may be frequent ---------------------------------------------------------


class _Grams:
    """The n-grams of a shard by their first place."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.ids = np.frombuffer(ids, np.int32)
        self.words = words.split(b"\n")
        raw = np.frombuffer(words, np.uint8).astype(np.uint64) + np.uint64(1)
        lengths = np.array([len(w) for w in self.words], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        of_lang = np.frombuffer((lang or "").encode(), np.uint8).astype(np.uint64)
        seed = ranges_hash(of_lang, np.array([0]), np.array([len(of_lang)]))[0]
        self.by_word = np.concatenate([np.zeros(1, np.uint64), mix(ranges_hash(raw, starts, starts + lengths) ^ seed)])

    def hashes(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1 to n: the hash at each place, and whether an n-gram of one piece begins there."""
        each = self.by_word[self.ids]
        h, inside = each, self.ids > 0
        yield h, inside
        for length in range(2, n + 1):
            h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[length - 1:])
            inside = inside[:-1] & (self.ids[length - 1:] > 0)
            yield h, inside


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted `known`."""
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    return known[np.minimum(at, len(known) - 1)] == h


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as values, but lists as Arrow arrays."""
    for i in range(b.num_rows):
        yield {n: c.values if isinstance(c := b.column(n)[i], pa.ListScalar) else c.as_py() for n in b.schema.names}


def _short(h: np.ndarray) -> np.ndarray:
    """The bits of hashes that are exchanged."""
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _sorted_hashes(stored: pa.Array) -> np.ndarray:
    return np.sort(stored.to_numpy(zero_copy_only=False).astype(np.int64))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in as many bytes as the largest needs, equal bytes side by side; the first byte is their width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(stored: bytes) -> np.ndarray:
    planes = np.frombuffer(stored, np.uint8, offset=1).reshape(stored[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, :len(planes)] = planes.T
    return values.view("<i8").ravel()


def _first_hash(part: int, ranges: int) -> int:
    return -(-(part << HASH_BITS) // ranges)


BLOCKS = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _counts_of(n: int, ranges: int):
    """A shard's n-grams that may count: hashes (differences) and counts, one block for each range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                *before, (h, alive) = _Grams(row["lang"], row["words"], row["ids"]).hashes(n)
                if "hashes" in row:
                    live = _among(_short(before[-1][0]), _sorted_hashes(row["hashes"])) & before[-1][1]
                    alive = alive & live[:-1] & live[1:]
                found, counts = np.unique(_short(h[alive]), return_counts=True)
                parts = found * ranges >> HASH_BITS
                cuts = np.flatnonzero(np.diff(parts, prepend=-1, append=ranges)).tolist()
                blocks = []
                for start, stop in zip(cuts, cuts[1:]):
                    part = int(parts[start])
                    steps = np.diff(found[start:stop], prepend=_first_hash(part, ranges))
                    blocks.append({"part": part, "shard": row["shard"], "hashes": _packed(steps), "counts": _packed(counts[start:stop])})
                yield pa.RecordBatch.from_pylist(blocks, BLOCKS)

    return run


def _frequent(ranges: int, least: int):
    """Sums the blocks of each range, which come one after the other: the hashes of each shard that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        for part, blocks in groupby(rows, key=lambda r: r["part"]):
            shards, hashes, counts = [], [], []
            for block in blocks:
                shards.append(block["shard"])
                hashes.append(_first_hash(part, ranges) + np.cumsum(_unpacked(block["hashes"])))
                counts.append(_unpacked(block["counts"]))
            ends = np.cumsum([0, *map(len, hashes)])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.diff(h[order], prepend=-1))
            enough = np.add.reduceat(np.concatenate(counts)[order], first) >= least
            keep = np.empty(len(h), bool)
            keep[order] = np.repeat(enough, np.diff(first, append=len(h)))
            offsets = np.concatenate([[0], np.cumsum(keep)])[ends]
            kept = pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[keep]))],
                names=["shard", "hashes"])
            yield kept.filter(pa.array(np.diff(offsets) > 0))

    return run


def candidates(shards: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """For each length the hashes of n-grams that may reach `least`: shard and `hashes`, those that it holds.

    Pairs are counted whole: the larger the corpus, the fewer words are rare, so words do not sift them.
    """
    words = shards.agg(F.sum("n").alias("n")).first().n or 0
    ranges = 1 + words // RANGE_WORDS
    out: list[DataFrame] = []
    for n in range(1, longest + 1):
        rows = shards.join(out[-1].hint("merge"), "shard") if n > 2 else shards
        blocks = rows.mapInArrow(_counts_of(n, ranges), "part int, shard long, hashes binary, counts binary")
        ordered = blocks.repartition("part").sortWithinPartitions("part")
        kept = ordered.mapInArrow(_frequent(ranges, least), "shard long, hashes array<long>")
        out.append(settle(kept.groupBy("shard").agg(F.flatten(F.collect_list("hashes")).alias("hashes"))))
    return out


# -- 3. count automata of the shards ---------------------------------------------------------


def shard_phrases(row: dict) -> list[tuple[Phrase, int]]:
    """The phrases of a shard whose hashes are among the candidates, with their exact counts, in order."""
    grams = _Grams(row["lang"], row["words"], row["ids"])
    known = {n: row["candidates"].field("hashes")[i].values for i, n in enumerate(row["candidates"].field("n").to_pylist())}
    ids, words, out = grams.ids.astype(np.int64), grams.words, []
    code = alive = None  # by place: equal for equal n-grams, and where one is that counts
    for n, (h, inside) in enumerate(grams.hashes(max(known)), 1):
        if n not in known:
            break
        now = inside & _among(_short(h), _sorted_hashes(known[n]))
        if alive is not None:
            now &= alive[:-1] & alive[1:]
        places, alive = np.flatnonzero(now), now
        keys = ids[places] if code is None else code[places] * (len(words) + 1) + ids[places + n - 1]
        _, first, each, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        code = np.zeros(len(h), np.int64)
        code[places] = each
        for at, count in zip(places[first].tolist(), counts.tolist()):
            out.append((tuple(words[i - 1] for i in ids[at:at + n].tolist()), count))
    out.sort()
    return out


def _shard_automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary()), ("sample", pa.list_(pa.binary()))])
    for b in batches:
        for row in _rows(b):
            phrases = shard_phrases(row)
            sample = [b" ".join(p) for p, _ in phrases[row["shard"] % SAMPLED::SAMPLED]]
            yield pa.RecordBatch.from_pylist(
                [{"lang": row["lang"], "counts": Automaton.build(phrases).to_bytes(), "sample": sample}], schema)


def shard_automata(shards: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """lang, counts (an automaton) and a sample of its phrases, for each shard."""
    known = None
    for n, level in enumerate(levels, 1):
        level = level.select("shard", F.struct(F.lit(n).alias("n"), "hashes").alias("level"))
        known = level if known is None else known.unionByName(level)
    known = known.groupBy("shard").agg(F.collect_list("level").alias("candidates"))
    return settle(shards.join(known.hint("merge"), "shard").mapInArrow(_shard_automata, "lang string, counts binary, sample array<binary>"))


# -- 4. and 5. ranges ------------------------------------------------------------------------


def cut_points(automata: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, phrase) at which ranges begin, ascending. They only decide how evenly the work is dealt."""
    sample = automata.select("lang", F.explode("sample").alias("phrase"))
    ranges = min(MOST_RANGES, 1 + sample.count() // PER_RANGE)
    if ranges == 1:
        return []
    ranged = sample.repartitionByRange(ranges, "lang", "phrase")
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("lang", "phrase")).alias("cut"))
    cuts = sorted((r.cut.lang.encode(), bytes(r.cut.phrase)) for r in first.collect())
    return [(lang.decode(), phrase) for lang, phrase in cuts[1:]]


class _Ranges:
    def __init__(self, cuts: list[tuple[str, bytes]]):
        self.cuts = [(lang.encode(), phrase) for lang, phrase in cuts]

    def split(self, lang: str, phrases: Iterator[tuple[Phrase, int]]) -> Iterator[tuple[int, Automaton]]:
        """Automata of ascending phrases by range."""
        own: dict[int, list[tuple[Phrase, int]]] = {}
        name = lang.encode()
        for phrase, weight in phrases:
            own.setdefault(bisect_right(self.cuts, (name, b" ".join(phrase))), []).append((phrase, weight))
        for part, those in own.items():
            yield part, Automaton.build(those)


PARTS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("counts", pa.binary())])


def _rows_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], Iterator[dict]]]:
    """Rows that come sorted by (part, lang), group by group."""
    rows = (row for b in batches for row in b.to_pylist())
    return groupby(rows, key=lambda r: (r["part"], r["lang"]))


def _by_range(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("part", "lang").sortWithinPartitions("part", "lang", *order)


def united(automata: DataFrame, cuts: list[tuple[str, bytes]], least: int) -> DataFrame:
    """part, lang, counts: for each range the automaton of its phrases with a count of `least` or more."""
    ranges = _Ranges(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                parts = ranges.split(row["lang"], Automaton.from_bytes(row["counts"]).items())
                yield pa.RecordBatch.from_pylist(
                    [{"part": part, "lang": row["lang"], "counts": a.to_bytes()} for part, a in parts], PARTS)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, lang), rows in _rows_by_range(batches):
            union = Union()
            for row in rows:
                union.add(Automaton.from_bytes(row["counts"]))
            counts = Automaton.build((p, w) for p, w in union.items() if w >= least)
            yield pa.RecordBatch.from_pylist([{"part": part, "lang": lang, "counts": counts.to_bytes()}], PARTS)

    schema = "part int, lang string, counts binary"
    return settle(_by_range(automata.select("lang", "counts").mapInArrow(deal, schema)).mapInArrow(unite, schema))


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            found = [(p, w) for p, w in Automaton.from_bytes(row["counts"]).items() if len(p) > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(found), pa.string()), pa.array([b" ".join(p) for p, _ in found], pa.binary()),
                 pa.array([w for _, w in found], pa.int64())], names=["lang", "phrase", "a"])


def phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase (two words or more, by one space) and a, its count."""
    found = counts.mapInArrow(_phrases, "lang string, phrase binary, a long")
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def part_counts(counts: DataFrame, cuts: list[tuple[str, bytes]]) -> DataFrame:
    """lang, part, f: the count of every phrase that is the first or the rest of a cut phrase."""
    ranges = _Ranges(cuts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                wanted = set()
                for p, _ in Automaton.from_bytes(row["counts"]).items():
                    for k in range(1, len(p)):
                        wanted.update((p[:k], p[k:]))
                acceptors = ranges.split(row["lang"], ((p, 1) for p in sorted(wanted)))
                yield pa.RecordBatch.from_pylist(
                    [{"part": part, "lang": row["lang"], "counts": a.to_bytes()} for part, a in acceptors], PARTS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), rows in _rows_by_range(batches):
            own, asked = None, Union()
            for row in rows:
                if row["kind"] == 0:
                    own = Automaton.from_bytes(row["counts"])
                else:
                    asked.add(Automaton.from_bytes(row["counts"]))
            found = list(own.compose(Automaton.build(asked.items()))) if own is not None else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([b" ".join(p) for p, _ in found], pa.binary()),
                 pa.array([w for _, w in found], pa.int64())], names=["lang", "phrase", "f"])

    asked = counts.mapInArrow(ask, "part int, lang string, counts binary").withColumn("kind", F.lit(1))
    both = counts.withColumn("kind", F.lit(0)).unionByName(asked)
    found = _by_range(both, "kind").mapInArrow(answer, "lang string, phrase binary, f long")
    return found.select("lang", F.col("phrase").cast("string").alias("of"), "f")


# -- 6. scores -------------------------------------------------------------------------------


def _sub_phrases(first: str, last: str, length: str) -> str:
    """SQL for all stretches of `words` with from `first` to `last` words."""
    return (f"flatten(transform(sequence({first}, {last}), k -> "
            f"transform(sequence(1, {length} - k + 1), i -> array_join(slice(words, i, k), ' '))))")


def scored(found: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """For each phrase its lowest-scoring cut (the first of equals): lang, phrase, a, l, r, n, score."""
    cuts = found.withColumn("words", F.split("phrase", " ")).select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("array_join(slice(words, 1, k), ' ')")) \
        .withColumn("right", F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')")).drop("words")
    lefts = parts.select(F.col("lang").alias("lang_l"), F.col("of").alias("left_of"), F.col("f").alias("l"))
    rights = parts.select(F.col("lang").alias("lang_r"), F.col("of").alias("right_of"), F.col("f").alias("r"))
    cuts = cuts.join(lefts, (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("left_of")))
    cuts = cuts.join(rights, (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("right_of")))
    big = "decimal(38,0)"
    score = F.expr(f"cast(1000 as {big}) * a * n div (cast(l as {big}) * r)")
    best = F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")
    lowest = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase").agg(best)
    return lowest.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def not_contained(found: DataFrame) -> DataFrame:
    """Phrases that lie in no longer phrase of (at least) the same count."""
    inside = found.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2).select(
        "lang", F.explode(F.expr(_sub_phrases("2", "size(words) - 1", "size(words)"))).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    shards = encode(docs)
    levels = candidates(shards, longest, least)
    automata = shard_automata(shards, levels)
    cuts = cut_points(automata)
    counts = united(automata, cuts, least)
    found = settle(phrases(counts))
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = not_contained(found).select("lang", "phrase")
    best = scored(found, settle(part_counts(counts, cuts)), totals).join(kept, ["lang", "phrase"], "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
