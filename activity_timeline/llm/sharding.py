"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Bytes are summed per
slot, and a versioned table maps slots to shards. Rebalancing writes the next
version: a shard keeps its largest slots as long as they fit the mean, the
others go, largest first, to the shard with the fewest bytes. Adding a shard is
the same edit with one more, empty, shard. Records never move between slots.

A map is kept: a later session opens it by its path and edits its newest whole
version. A version without the success marker of Spark's file committer does not
count and is written anew.

The map has `slots` rows whatever the corpus holds, so it is broadcast, and one
fold over it (an SQL aggregate over an array of that length) deals out the
released slots.

A null text has no bytes (size 8, CRC 0). Rows without doc_id are hashed by
their text. Repeated rows are rows like others. An empty table gives no rows.
Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from activity_timeline.llm.common import matching, stored, text_or_empty

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row."""
    text = text_or_empty()
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64(text))), F.lit(slots))
        .cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"),
                                            F.count("*").alias("n_rows"))


class SlotMap:
    """Versions of the slot-to-shard map below `path`: version, virtual_slot, shard."""

    def __init__(self, spark: SparkSession, path: str, shards: int, slots: int = SLOTS):
        """Begin a map with slots dealt out in turn (version 0); `open` takes up one that exists."""
        if self._versions(spark, path):
            raise ValueError(f"{path} holds a slot map; open it")
        self.spark, self.path, self.slots, self.version = spark, path, slots, 0
        self._write(spark.range(slots).select(
            F.col("id").cast("int").alias("virtual_slot"),
            (F.col("id") % shards).cast("int").alias("shard")))

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        return sorted(int(mark.rsplit("/", 2)[-2].removeprefix("version="))
                      for mark in matching(spark, f"{path}/version=*/_SUCCESS"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SlotMap:
        """The map that another job left below `path`, at its newest version."""
        versions = cls._versions(spark, path)
        if not versions:
            raise ValueError(f"{path} holds no slot map")
        found = cls.__new__(cls)
        found.spark, found.path, found.version = spark, path, versions[-1]
        found.slots = found.read().count()
        return found

    def _write(self, rows: DataFrame) -> None:
        # what stands there already is a version that was never finished
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={self.version}")

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def rebalance(self, sizes: DataFrame, shards: int) -> int:
        """Write the next version for `shards` shards, given bytes per slot; its number."""
        loads = (self.read().join(sizes, "virtual_slot", "left")
                 .select("virtual_slot", "shard",
                         F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")))
        order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
        mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(float(shards))
        placed = loads.select(
            "*", (F.sum("bytes").over(order) <= mean).alias("stays"))
        # one row: the slots that stay as loads per shard, the released ones as a list
        state = placed.agg(
            F.array_sort(F.collect_list(F.when(
                ~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))
            ).alias("released"),
            F.array(*[F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))
                            .otherwise(0)) for s in range(shards)]).alias("loads"))
        dealt = state.select(F.explode(_deal(F.col("released"), F.col("loads"))).alias("to"))
        moved = dealt.select("to.virtual_slot", F.col("to.shard").alias("to_shard"))
        after = (placed.join(moved, "virtual_slot", "left")
                 .select("virtual_slot",
                         F.coalesce("to_shard", "shard").cast("int").alias("shard")))
        self.version += 1
        self._write(after)
        return self.version


def _deal(released: Column, loads: Column) -> Column:
    """Fold over released slots, largest first: each goes to the shard with the fewest bytes."""
    start = F.struct(
        loads.alias("loads"),
        F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("out"))

    def step(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda load, i: F.when(
                i == at - 1, load - slot["less"]).otherwise(load)).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(
                slot["virtual_slot"].alias("virtual_slot"), (at - 1).alias("shard")))).alias("out"))

    return F.aggregate(released, start, step)["out"]


def place(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each record with its shard and a dense position (from 0) in the shard.

    Positions are numbered inside virtual slots, which spread evenly, and
    shifted by the sizes of the slots before; no task sees a whole shard.
    """
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"))
    before = (Window.partitionBy("shard").orderBy("virtual_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = mapping.join(counts, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    # one row per virtual slot, whatever the corpus holds
    return (rows.withColumn("place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), "virtual_slot")
            .withColumn("slot", (F.col("first") + F.col("place")).cast("bigint"))
            .drop("first", "place"))


def shard(docs: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Documents dealt to shards of near equal bytes: one pass over the texts."""
    rows = stored(records(docs, slots), "records")
    slot_map = SlotMap(docs.sparkSession, path, shards, slots)
    slot_map.rebalance(slot_bytes(rows), shards)
    return place(rows, slot_map.read())
