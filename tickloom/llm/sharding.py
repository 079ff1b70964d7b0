"""Sharding over fixed virtual slots.

Every record hashes to one of thousands of slots, and stays there for good.  Bytes are added up per slot,
and a versioned table says which shard holds each slot.  Rebalancing edits that table, never the hash: a
new version moves whole slots and leaves the others where they are.  The table has one row per slot, so
its size is fixed however large the corpus, and the driver may hold it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
SHARDS = 40
#: Bytes that a record costs besides its text.
RECORD_BYTES = 16


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Shard, bytes and rows of every slot, under a version number."""

    shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]
    version: int = 0
    history: tuple[tuple[int, int, int], ...] = field(default=())  # (version, slots moved, bytes moved)

    @staticmethod
    def balanced(size: list[int], rows: list[int], shards: int = SHARDS) -> SlotMap:
        """Slots by falling bytes, each to the shard with the fewest bytes so far."""
        if shards < 1:
            raise ValueError("at least one shard")
        heap = [(0, s) for s in range(shards)]
        shard = [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda k: (-size[k], k)):
            filled, s = heapq.heappop(heap)
            shard[slot] = s
            heapq.heappush(heap, (filled + size[slot], s))
        return SlotMap(shards, tuple(shard), tuple(size), tuple(rows))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, s in enumerate(self.shard):
            out[s] += self.size[slot]
        return out

    def _edited(self, shard: list[int], shards: int) -> SlotMap:
        moved = [k for k in range(len(shard)) if shard[k] != self.shard[k]]
        entry = (self.version + 1, len(moved), sum(self.size[k] for k in moved))
        return replace(self, shards=shards, shard=tuple(shard), version=self.version + 1, history=(*self.history, entry))

    def grown(self) -> SlotMap:
        """One more shard, which takes slots from the fullest shards until it has its share; none moves elsewhere."""
        shard, loads, new = list(self.shard), [*self.loads(), 0], self.shards
        share = sum(self.size) / (self.shards + 1)
        held: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, s in enumerate(shard):
            held[s].append(slot)
        for s in held:  # popped from the end: large ones first
            held[s].sort(key=lambda k: (self.size[k], -k))
        heap = [(-loads[s], s) for s in range(self.shards)]
        heapq.heapify(heap)
        while heap and loads[new] < share:
            _, s = heapq.heappop(heap)
            while held[s]:
                slot = held[s].pop()
                # Too large for what is left of the share: a smaller slot of this shard may still fit.
                if 0 < self.size[slot] <= share - loads[new]:
                    shard[slot] = new
                    loads[new], loads[s] = loads[new] + self.size[slot], loads[s] - self.size[slot]
                    heapq.heappush(heap, (-loads[s], s))
                    break
        return self._edited(shard, self.shards + 1)

    def resized(self, size: list[int], rows: list[int], slack: float = 0.02) -> SlotMap:
        """The map after the corpus changed: slots leave shards above (1 + slack) of the mean, as few as will do."""
        now = replace(self, size=tuple(size), rows=tuple(rows))
        shard, loads = list(now.shard), now.loads()
        limit = (1 + slack) * sum(size) / self.shards
        for s in sorted(range(self.shards), key=lambda k: -loads[k]):
            for slot in sorted((k for k, x in enumerate(shard) if x == s), key=lambda k: (-size[k], k)):
                if loads[s] <= limit:
                    break
                low = min(range(self.shards), key=lambda k: (loads[k], k))
                if size[slot] and loads[low] + size[slot] < loads[s]:
                    shard[slot], loads[s], loads[low] = low, loads[s] - size[slot], loads[low] + size[slot]
        return now._edited(shard, self.shards)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, shards, vslot, shard, bytes, rows, before): `before` counts the rows of earlier slots in the shard."""
        seen, rows = [0] * self.shards, []
        for slot, s in enumerate(self.shard):
            rows.append((self.version, self.shards, slot, s, self.size[slot], self.rows[slot], seen[s]))
            seen[s] += self.rows[slot]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int, bytes long, rows long, before long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of versions; earlier ones stay readable."""
        self.frame(spark).coalesce(1).write.parquet(f"{path.rstrip('/')}/version={self.version:06d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path.rstrip('/')}/version={version:06d}").orderBy("vslot").collect()
        return SlotMap(rows[0]["shards"], tuple(r["shard"] for r in rows), tuple(r["bytes"] for r in rows), tuple(r["rows"] for r in rows), version)


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every record.  The slot hashes the id and the text's checksum, so
    that records which share an id do not share a slot unless they are equal."""
    data = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    rows = df.select(df[id_col].alias("doc_id"), (F.octet_length(data) + RECORD_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return rows.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: `slots` numbers each, summed on the executors."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["size"], r["rows"]
    return size, rows


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot): `slot` is the record's place in its shard, gapless from 0.

    Records are numbered within their virtual slot, after the rows of the shard's earlier slots; so the
    numbering is dealt out by thousands of slots, not by the few shards.
    """
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("__rank", F.row_number().over(order) - 1)
    # One row per slot: bounded by SLOTS.
    named = F.broadcast(slot_map.select("vslot", "shard", "before"))
    return ranked.join(named, "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("__rank")).cast("long").alias("slot"), "vslot")


def shard_documents(
    df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
) -> DataFrame:
    """Every record with its shard and place; version 0 of the slot map is stored under `path` and read back.

    A null text has no bytes; a null id is an id like any other; equal rows share a slot and get places of
    their own.  Equal texts under different ids are spread over the slots like any other records, so a large
    group of copies weighs on no single shard.  A record is never cut: one that is larger than a shard's share makes its shard larger.
    An empty table gives an empty result and a map of empty slots.
    """
    spark = df.sparkSession
    records = slotted(df, id_col, text_col, slots)
    SlotMap.balanced(*slot_sizes(records, slots), shards).save(spark, path)
    return assign(records, spark.read.parquet(f"{path.rstrip('/')}/version=000000"))
