"""Sharding by fixed virtual slots (DataFrame functions only).

A record's slot is a hash of its id modulo a fixed number of slots (thousands). Bytes and rows are aggregated by slot;
a versioned map sends every slot to a shard and is edited, never rebuilt, when shards are added or out of balance.
The slot table has n_slots rows however large the corpus is, so the map is made on the driver.

Null ids share one slot; a null text has 0 bytes (size 1). Repeated rows are separate records. An empty table gives an
empty result. Columns other than the id and text columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_SLOTS = 4096


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def literal(values: list[int], kind: str) -> Column:
    """A constant array; one text that the optimizer folds, not a call for each number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def slot_table(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """Bytes and rows by slot: n_slots rows at most."""
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class SlotMap:
    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def build(cls, slot_bytes: list[int], n_shards: int) -> SlotMap:
        """Heaviest slot first to the lightest shard so far; ties by number."""
        shard_of, load = [0] * len(slot_bytes), [(0, s) for s in range(n_shards)]
        for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
            total, shard = heapq.heappop(load)
            shard_of[slot] = shard
            heapq.heappush(load, (total + slot_bytes[slot], shard))
        return cls(1, n_shards, tuple(shard_of))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += slot_bytes[slot]
        return out

    def rebalance(self, slot_bytes: list[int], tolerance: float = 0.01) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that brings them nearer, until within tolerance."""
        shard_of, load = list(self.shard_of), self.loads(slot_bytes)
        mean = sum(load) / self.n_shards
        moved = False
        while True:
            hi, lo = max(range(self.n_shards), key=lambda s: (load[s], -s)), min(range(self.n_shards), key=lambda s: (load[s], s))
            if load[hi] - load[lo] <= tolerance * mean:
                break
            gap = load[hi] - load[lo]
            fit = [i for i, s in enumerate(shard_of) if s == hi and 0 < slot_bytes[i] < gap]
            if not fit:
                break
            slot = min(fit, key=lambda i: (abs(gap / 2 - slot_bytes[i]), i))
            shard_of[slot], moved = lo, True
            load[hi] -= slot_bytes[slot]
            load[lo] += slot_bytes[slot]
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of)) if moved else self

    def grow(self, slot_bytes: list[int]) -> SlotMap:
        """One more shard; it takes slots from the others until it has its share. No other slot moves."""
        shard_of, load, new = list(self.shard_of), self.loads(slot_bytes), self.n_shards
        share, have = sum(load) / (self.n_shards + 1), 0
        for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
            old, size = shard_of[slot], slot_bytes[slot]
            if size and load[old] - size >= share * 0.999 and have + size <= share * 1.001:
                shard_of[slot], have = new, have + size
                load[old] -= size
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(shard_of))

    def column(self, slot: Column) -> Column:
        return F.element_at(literal(self.shard_of, "int"), slot + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(len(self.shard_of)).select(
            F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), F.col("id").cast("int").alias("virtual_slot"), self.column(F.col("id").cast("int")).alias("shard")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table; older versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # n_slots rows
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def records_of(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    return docs.select(
        F.col(key),
        record_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("text_crc32"),
        slot_of(F.col(key), n_slots).alias("virtual_slot"),
    )


def shard(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(records with shard and place in the shard, the slot map). The map is stored under map_path if given.

    A record's place: the rows of the shard's lower slots, then its order by id, checksum and size within the slot, so
    no task holds more than one slot at a time.
    """
    records = records_of(docs, key, text, n_slots)
    slot_bytes, slot_rows = [0] * n_slots, [0] * n_slots
    for r in slot_table(records).collect():  # n_slots rows at most
        slot_bytes[r["virtual_slot"]], slot_rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    slot_map = SlotMap.build(slot_bytes, n_shards).rebalance(slot_bytes, 0.001)
    if map_path:
        slot_map.save(docs.sparkSession, map_path)
        slot_map = SlotMap.load(docs.sparkSession, map_path)
    offset, filled = [0] * n_slots, [0] * n_shards
    for slot, s in enumerate(slot_map.shard_of):
        offset[slot] = filled[s]
        filled[s] += slot_rows[slot]
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    placed = records.withColumn("slot", F.element_at(literal(offset, "bigint"), F.col("virtual_slot") + 1) + place - 1)
    return placed.withColumn("shard", slot_map.column(F.col("virtual_slot"))), slot_map
