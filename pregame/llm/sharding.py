"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of a few thousand virtual slots, for good. The bytes of each slot are
aggregated; a map says which shard holds which slot. The first map packs the heaviest slots first, each
into the lightest shard, so shards have nearly equal bytes. A map is never overwritten: `rebalance` and
`grow` edit a copy, move as few slots as they need, and are stored as the next version.

All that reaches the driver is one number per virtual slot (`slots` of them, a parameter). Cases: a NULL
text has no bytes and its record counts 1; a NULL doc_id is placed by its text; rows equal in doc_id and
text share a slot; an empty table gives an empty result (its map still names a shard for every slot);
other columns are ignored or, in `place`, kept beside.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregame.llm.common import shared_folder, tidy

SLOTS = 4096


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), doc_id, F.when(doc_id.isNull(), text)), F.lit(slots)).cast("int")


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each virtual slot; `slotted` has columns vslot and size."""
    out = [0] * slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("size")).collect():
        out[r.vslot] = r["size"]
    return out


def _loads(of: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    loads = [0] * shards
    for slot, shard in enumerate(of):
        loads[shard] += sizes[slot]
    return loads


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    of: tuple[int, ...]  # the shard of each virtual slot

    @staticmethod
    def pack(sizes: Sequence[int], shards: int) -> SlotMap:
        """Heaviest slot first, each to the lightest shard."""
        heap, of = [(0, shard) for shard in range(shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            load, shard = heap[0]
            of[slot] = shard
            heapq.heapreplace(heap, (load + max(1, sizes[slot]), shard))
        return SlotMap(1, shards, tuple(of))

    def _drain(self, sizes: Sequence[int], shards: int, receivers: Sequence[int], most: float) -> SlotMap:
        """Move slots from shards above `most` bytes to the lightest receiver, as long as that evens them out."""
        of, loads = list(self.of), _loads(self.of, sizes, shards)
        own: dict[int, list[int]] = {}
        for slot, shard in enumerate(of):
            own.setdefault(shard, []).append(slot)
        for shard in sorted(range(shards), key=lambda s: -loads[s]):
            for slot in sorted(own.get(shard, []), key=lambda s: (-sizes[s], s)):
                to = min(receivers, key=lambda s: loads[s])
                if to == shard or loads[shard] <= most:
                    break
                if sizes[slot] and loads[to] + sizes[slot] <= max(most, loads[shard] - sizes[slot]):
                    of[slot] = to
                    loads[shard] -= sizes[slot]
                    loads[to] += sizes[slot]
        return SlotMap(self.version + 1, shards, tuple(of))

    def rebalance(self, sizes: Sequence[int], tolerance: float = 0.02) -> SlotMap:
        mean = sum(sizes) / self.shards
        return self._drain(sizes, self.shards, range(self.shards), mean * (1 + tolerance))

    def grow(self, sizes: Sequence[int]) -> SlotMap:
        """One more shard, which alone takes slots in."""
        return self._drain(sizes, self.shards + 1, [self.shards], sum(sizes) / (self.shards + 1))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.of)), "vslot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Written once: an existing version is an error."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").collect()
        of = {r.vslot: r.shard for r in rows}
        return SlotMap(version, rows[0].shards, tuple(of[s] for s in range(len(of))))


def place(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """doc_id, size, text_crc32, vslot, shard and `slot`, the gapless place in the shard; and the map.

    Places are numbered within a virtual slot and added to the rows of the shard's earlier slots, so
    no task ever holds more than one virtual slot.
    """
    spark = docs.sparkSession
    d = tidy(docs, {"doc_id": "bigint", "text": "string"})
    d = d.select(
        "doc_id", record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("vslot"),
    )
    counted = d.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    sizes, rows = [0] * slots, [0] * slots
    for r in counted:
        sizes[r.vslot], rows[r.vslot] = r["size"], r["rows"]
    chosen = SlotMap.pack(sizes, shards)
    chosen.save(spark, folder or f"{shared_folder(spark)}/slot-maps/{uuid.uuid4().hex}")
    before, entries = [0] * shards, []
    for slot, shard in enumerate(chosen.of):
        entries.append((slot, shard, before[shard]))
        before[shard] += rows[slot]
    # One row per virtual slot: its size is fixed by `slots`.
    where = F.broadcast(spark.createDataFrame(entries, "vslot int, shard int, before bigint"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = (
        d.withColumn("inside", F.row_number().over(inside)).join(where, "vslot")
        .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    )
    return placed, chosen
