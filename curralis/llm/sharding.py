"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its key alone and never changes. Bytes are summed per slot; a map of the SLOTS slots,
balanced by bytes, is stored with a version and edited when shards are added: only the slots that the map moves change
their shard. What is collected is one row per slot, a fixed number however large the data.

Defined cases: null texts have size HEAD; texts of any length are measured whole; rows with a null key are dealt by their text;
repeated rows and ties are placed one by one, by doc_id and checksum; an empty table gives an empty result and an even map. Other
columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curralis.llm.common import shared_path, written

SLOTS = 8192
#: Bytes that a record takes beside its text.
HEAD = 16


def slot_of(key, slots: int = SLOTS, without="text"):
    """A slot by the key; rows without a key are dealt by their text, so that they are no hot slot."""
    hash_ = F.when(F.col(key).isNull(), F.xxhash64(without)).otherwise(F.xxhash64(key))
    return F.pmod(hash_, F.lit(slots)).cast("int")


def balanced(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot: largest slots first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        size, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + sizes.get(slot, 0), n + 1, shard))
    return out


def grown(assigned: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """assigned edited for one shard more: slots move from the heaviest shards into the new one only, till it has its share."""
    out, load = list(assigned), [0] * (shards + 1)
    by: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(range(len(assigned)), key=lambda s: (sizes.get(s, 0), s)):
        load[assigned[slot]] += sizes.get(slot, 0)
        by[assigned[slot]].append(slot)
    share = sum(load) / (shards + 1)
    heap = [(-load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    while heap and load[shards] < share:
        _, s = heapq.heappop(heap)
        fits = [k for k in by[s] if sizes.get(k, 0) <= share - load[shards] and sizes.get(k, 0)]
        if not fits:
            continue
        slot = fits[-1]
        by[s].remove(slot)
        out[slot] = shards
        load[s] -= sizes.get(slot, 0)
        load[shards] += sizes.get(slot, 0)
        heapq.heappush(heap, (-load[s], s))
    return out


class SlotMap:
    """Versions of the slot-to-shard map as Parquet tables (version, virtual_slot, shard, bytes, rows) in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, assigned: list[int], sizes: dict[int, int], rows: dict[int, int]) -> DataFrame:
        table = self.spark.createDataFrame([(version, s, shard, sizes.get(s, 0), rows.get(s, 0)) for s, shard in enumerate(assigned)], "version int, virtual_slot int, shard int, bytes long, rows long")
        table.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}").select("virtual_slot", "shard", "bytes", "rows")

    def rebalance(self, version: int) -> DataFrame:
        """Stores version + 1, which has one shard more."""
        old = sorted(self.load(version).collect())
        sizes, shards = {r[0]: r[2] for r in old}, max(r[1] for r in old) + 1
        return self.store(version + 1, grown([r[1] for r in old], sizes, shards), sizes, {r[0]: r[3] for r in old})


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of docs, and the map, stored as version 1.

    slot is the row's place in its shard: the rows of the shard's earlier virtual slots, plus the rank in its own. Ranks
    are taken within a virtual slot, so no task has to order a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.length(text) + HEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of("doc_id", slots).alias("virtual_slot"))
    rows = written(rows, "shard-rows")
    sums = {r[0]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}  # one row per slot
    sizes, counts = {k: r[1] for k, r in sums.items()}, {k: r[2] for k, r in sums.items()}
    assigned = balanced(sizes, shards, slots)
    maps = SlotMap(docs.sparkSession, shared_path(docs.sparkSession, "slot-map"))
    placed = maps.store(1, assigned, sizes, counts)
    base = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(base), F.lit(0)).alias("base"))  # over the map's rows only
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    out = rows.withColumn("rank", rank).join(F.broadcast(placed), "virtual_slot")  # a row per slot: fixed size
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot")), maps
