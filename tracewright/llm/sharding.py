"""Sharding by fixed virtual slots (native: DataFrame functions only).

A record's virtual slot is a hash of its id; there are ``SLOTS`` of them,
whatever the data.  Bytes are added up for each slot, and a versioned map says
which shard a slot belongs to.  Rebalancing edits the map: whole slots move,
records are never hashed anew.  A slot that holds far more records than others
(many rows of one id, or without one) is split into parts, which have shards of
their own; its records are dealt to them by a hash of their row numbers.

The law that holds is ``bytes``: shards get nearly equal sizes.  Only the slot
table (``SLOTS`` rows and as many parts again, constants) is planned on the driver;
records are hashed, summed, numbered and assigned by Spark.

Defined results: a null text has no bytes (size 16, checksum 0); a null id has
a slot like any other value; equal rows are separate records, and which of them
comes first is left open; an empty table gives no rows; extra columns are ignored,
whatever their names.  ``slot`` numbers the records of a shard from 0 without gaps,
``virtual_slot`` is the hashed slot and ``part`` the part of it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16
Part = tuple[int, int]  # a virtual slot, and the part of it


@dataclass
class SlotMap:
    """Which shard each part of a virtual slot belongs to, as of ``version``."""

    version: int
    n_shards: int
    shard: dict[Part, int]
    log: list[tuple[Part, int, int]] = field(default_factory=list)  # part, from (-1: new), to of the last edit

    @property
    def parts(self) -> dict[int, int]:
        """The number of parts of each slot that has more than one."""
        out: dict[int, int] = {}
        for slot, part in self.shard:
            out[slot] = max(out.get(slot, 1), part + 1)
        return {slot: n for slot, n in out.items() if n > 1}

    @classmethod
    def balanced(cls, part_bytes: dict[Part, int], n_shards: int) -> SlotMap:
        """The first version: parts by falling size, each to the shard with the fewest bytes so far."""
        heap = [(0, 0, s) for s in range(n_shards)]
        shard = {}
        for part in sorted(part_bytes, key=lambda x: (-part_bytes[x], x)):
            size, count, to = heapq.heappop(heap)
            shard[part] = to
            heapq.heappush(heap, (size + part_bytes[part], count + 1, to))
        return cls(1, n_shards, shard)

    def rebalanced(self, part_bytes: dict[Part, int], n_shards: int) -> SlotMap:
        """The next version, for ``n_shards``: parts leave shards above the mean for those furthest below it; new parts go to the emptiest."""
        shard, log = dict(self.shard), []
        total = [0] * max(n_shards, self.n_shards)
        own: dict[int, list[Part]] = {s: [] for s in range(len(total))}
        for part, s in shard.items():
            total[s] += part_bytes.get(part, 0)
            own[s].append(part)
        mean = sum(part_bytes.values()) / n_shards
        low = [(total[s], s) for s in range(n_shards)]
        heapq.heapify(low)

        def emptiest() -> int:
            while low[0][0] != total[low[0][1]]:
                heapq.heapreplace(low, (total[low[0][1]], low[0][1]))
            return low[0][1]

        def move(part: Part, s: int, to: int) -> None:
            size = part_bytes.get(part, 0)
            if s >= 0:
                total[s] -= size
            total[to] += size
            heapq.heapreplace(low, (total[to], to))
            shard[part] = to
            log.append((part, s, to))

        for part in sorted(part_bytes.keys() - shard.keys(), key=lambda x: (-part_bytes[x], x)):
            move(part, -1, emptiest())
        for s in sorted(own, key=lambda s: -total[s]):
            for part in sorted(own[s], key=lambda x: (-part_bytes.get(x, 0), x)):
                size, gone = part_bytes.get(part, 0), s >= n_shards
                if not gone and total[s] - size < mean:
                    continue
                to = emptiest()
                if to == s or (not gone and total[to] + size > mean and total[to] + size >= total[s]):
                    continue
                move(part, s, to)
        return SlotMap(self.version + 1, n_shards, shard, log)

    def frame(self, spark: SparkSession, counts: dict[Part, int] | None = None) -> DataFrame:
        """version, n_shards, virtual_slot, part, shard and the number of records before the part within its shard."""
        rows, seen = [], [0] * max(self.n_shards, max(self.shard.values(), default=0) + 1)
        for (slot, part), s in sorted(self.shard.items()):
            rows.append(f"{slot}:{part}:{s}:{seen[s]}")
            seen[s] += (counts or {}).get((slot, part), 0)
        one = spark.range(1, numPartitions=1).select(F.explode(F.split(F.lit(",".join(rows)), ",")).alias("x"))
        at = lambda k, kind: F.split_part("x", F.lit(":"), F.lit(k)).cast(kind)
        return one.select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), at(1, "int").alias("virtual_slot"), at(2, "int").alias("part"), at(3, "int").alias("shard"), at(4, "long").alias("before"))

    def store(self, spark: SparkSession, path: str, counts: dict[Part, int] | None = None) -> DataFrame:
        """Write this version below ``path``, beside earlier ones, and give it as read back."""
        where = f"{path}/v{self.version:09d}"
        frame = self.frame(spark, counts)
        frame.write.parquet(where)
        return spark.read.schema(frame.schema).parquet(where)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The stored map of ``version``, or the latest one; None if there is none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        found = sorted(x.getPath().getName() for x in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
        found = [x for x in found if version is None or int(x[1:]) == version]
        if not found:
            return None
        rows = spark.read.parquet(f"{path}/{found[-1]}").collect()  # the slot table
        return cls(rows[0].version, rows[0].n_shards, {(r.virtual_slot, r.part): r.shard for r in rows})


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a row number of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )


def sums(rows: DataFrame, *keys: str) -> dict[tuple, tuple[int, int]]:
    """Bytes and records by slot, or by slot and part (rows that the number of slots bounds)."""
    return {tuple(r[k] for k in keys): (r.bytes, r.n) for r in rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}


def heavy(slot_rows: dict[int, int], slots: int) -> dict[int, int]:
    """The slots with far more records than the mean, and how many parts each needs to come down to it."""
    usual = max(1, math.ceil(sum(slot_rows.values()) / slots))
    return {slot: -(-n // usual) for slot, n in slot_rows.items() if n > 4 * usual + OVERHEAD}


def assign(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its place in it, and the map that was used.

    With ``path``, the latest map stored there is rebalanced for what ``docs`` holds
    now and stored as the next version; without, the first version of a new map.
    """
    spark = docs.sparkSession
    # written once: from here on a row has a fixed number
    rows = materialize(records(docs, slots), "shard-records")
    before = SlotMap.load(spark, path) if path else None
    parts = heavy({slot: n for (slot,), (_, n) in sums(rows, "virtual_slot").items()}, slots)
    for slot, n in (before.parts if before else {}).items():
        parts[slot] = max(n, parts.get(slot, 1))
    part = F.lit(0)
    if parts:
        many = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv])
        part = F.pmod(F.xxhash64("row"), F.coalesce(many[F.col("virtual_slot")], F.lit(1))).cast("int")
    rows = rows.withColumn("part", part)
    found = sums(rows, "virtual_slot", "part")
    size = {(s, p): 0 for s in range(slots) for p in range(parts.get(s, 1))} | {k: b for k, (b, _) in found.items()}
    slot_map = before.rebalanced(size, n_shards) if before else SlotMap.balanced(size, n_shards)
    stored = slot_map.store(spark, path or scratch_path(spark, "slot-map"), {k: n for k, (_, n) in found.items()})
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(stored), ["virtual_slot", "part"])
    return (
        out.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part", F.col("version").alias("map_version"),
        ),
        slot_map,
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))[0]
