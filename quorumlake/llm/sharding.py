"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Records hash into SLOTS slots for good. What moves when shards are added or grow uneven is the map
from slots to shards, edited slot by slot and stored under a new version each time.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import scratch_path, stored, utf8

#: Slots are fixed when a corpus is first sharded; a slot holds 1/SLOTS of the records.
SLOTS = 4096
#: Equal rows are made again from their count in runs of this many, each in a task of its own.
RUN = 4096
_MAP = "version long, shards int, virtual_slot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard, bytes and rows of each slot (lists of ``slots`` entries)."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    @staticmethod
    def balanced(bytes_of: list[int], rows_of: list[int], shards: int) -> SlotMap:
        """Version 1: the largest slot goes to the emptiest shard, again and again."""
        heap = [(0, s) for s in range(shards)]
        shard_of = [0] * len(bytes_of)
        for slot in sorted(range(len(bytes_of)), key=lambda i: (-bytes_of[i], i)):
            load, s = heapq.heappop(heap)
            shard_of[slot] = s
            heapq.heappush(heap, (load + bytes_of[slot], s))
        return SlotMap(1, shards, tuple(shard_of), tuple(bytes_of), tuple(rows_of))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard_of, self.bytes_of):
            out[s] += b
        return out

    def rebalanced(self, bytes_of: list[int], rows_of: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version for new slot sizes and, if given, another number of shards.

        Only as many slots move as it takes to bring every shard within ``tolerance`` of the mean:
        slots leave shards that are over it (or no longer exist) for the emptiest shard.
        """
        shards = shards or self.shards
        mean = sum(bytes_of) / shards
        own: list[list[int]] = [[] for _ in range(shards)]
        loads, moving = [0] * shards, []
        for slot, s in enumerate(self.shard_of):
            if s < shards:
                own[s].append(slot)
                loads[s] += bytes_of[slot]
            else:
                moving.append(slot)
        for s in range(shards):
            own[s].sort(key=lambda i: bytes_of[i])
            while own[s] and loads[s] > mean * (1 + tolerance):
                over = loads[s] - mean
                fits = [i for i in own[s] if bytes_of[i] <= over]
                if not fits:
                    break
                moving.append(fits[-1])
                own[s].remove(fits[-1])
                loads[s] -= bytes_of[fits[-1]]
        shard_of = list(self.shard_of)
        heap = [(loads[s], s) for s in range(shards)]
        heapq.heapify(heap)
        for slot in sorted(moving, key=lambda i: (-bytes_of[i], i)):
            load, s = heapq.heappop(heap)
            shard_of[slot] = s
            heapq.heappush(heap, (load + bytes_of[slot], s))
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(shard_of), bytes_of=tuple(bytes_of), rows_of=tuple(rows_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table of SLOTS rows, with each slot's first place in its shard."""
        nxt, first = [0] * self.shards, []
        for s, n in zip(self.shard_of, self.rows_of):
            first.append(nxt[s])
            nxt[s] += n
        return spark.createDataFrame(
            [(i, self.shard_of[i], first[i]) for i in range(len(self.shard_of))], "virtual_slot int, shard int, first long"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of versions at ``path``; a version that is there stays as it is."""
        before = SlotMap.latest(spark, path)
        if before is not None and before.version >= self.version:
            raise ValueError(f"version {self.version} of the slot map at {path} is there")
        rows = [(self.version, self.shards, i, self.shard_of[i], self.bytes_of[i], self.rows_of[i]) for i in range(len(self.shard_of))]
        spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version; the latest if none is named."""
        table = spark.read.schema(_MAP).parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
        if not rows:
            raise ValueError(f"no version {version} of the slot map at {path}")
        return SlotMap(version, rows[0]["shards"], *(tuple(r[c] for r in rows) for c in ("shard", "bytes", "rows")))

    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The latest version at ``path``, or None if nothing is stored there."""
        try:
            return SlotMap.load(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None


def hashed_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row.

    Rows with the same id and text differ in nothing here, so they are counted and made again from
    their count: the first copy's slot is by id and text, that of each other one by its number too.
    """
    crc = F.crc32(utf8(text_col).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(utf8(text_col)).cast("long") + 1).alias("size"), crc.alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    few = counted.where(F.col("n") <= RUN).withColumn("from", zero)
    many = counted.where(F.col("n") > RUN).withColumn("from", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(RUN).cast("long"))))
    many = many.repartition("doc_id", "text_crc32", "from")
    copies = few.unionByName(many).withColumn("copy", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + RUN) - 1)))
    own = F.when(F.col("copy") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "copy"))
    return copies.select("doc_id", "size", "text_crc32", F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(hashed: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most ``slots`` rows reach the driver."""
    bytes_of, rows_of = [0] * slots, [0] * slots
    for r in hashed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        bytes_of[r["virtual_slot"]], rows_of[r["virtual_slot"]] = r["b"], r["n"]
    return bytes_of, rows_of


def assigned(hashed: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Shard and place in the shard of each row; places of a shard are gapless from 0.

    The place is the slot's first place plus the row's rank in its slot, so no shard is sorted whole.
    """
    spark = hashed.sparkSession
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        hashed.withColumn("rank", rank)
        .join(F.broadcast(slot_map.frame(spark)), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put all rows into ``shards`` shards of near-equal bytes; the map is stored at ``map_path``.

    If a map is stored there, its latest version is rebalanced for these rows and stored as the next one,
    so most slots stay where they are. Without ``map_path`` the map is new.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, law ("bytes"), shard,
    slot (place in the shard, gapless from 0), grown_shard (null: the law is not "key") and
    virtual_slot. Null ids hash by their text; repeated rows are dealt over slots and take places of
    their own; ties are placed by id, then text. A very long text is one row, never split; other columns,
    whatever their names, are not read. An empty table gives no rows and an even, empty map.
    """
    spark = docs.sparkSession
    hashed = stored(hashed_slots(docs, id_col, text_col, slots), "slots")
    sizes = slot_sizes(hashed, slots)
    before = SlotMap.latest(spark, map_path) if map_path else None
    if before and len(before.shard_of) != slots:
        raise ValueError(f"the slot map at {map_path} has {len(before.shard_of)} slots, not {slots}")
    slot_map = before.rebalanced(*sizes, shards) if before else SlotMap.balanced(*sizes, shards)
    slot_map.save(spark, map_path or scratch_path(spark, "slot-map"))
    return assigned(hashed, slot_map)
