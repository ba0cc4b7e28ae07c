"""Ordered work on groups of any size.

Window functions put a whole group into one task. That is right for groups up
to GROUP_ROWS rows. If any group is larger, the operators cut every group into
slices of `block` positions, work inside the slices, and pass only one row per
slice along the group. `block=None` means: no group needs slices.
"""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole

GROUP_ROWS = 4_000_000    # rows of one group that a single task may order (some 170 MB shuffled)
BLOCK = 131_072           # positions per slice
BROADCAST_ROWS = 100_000  # rows of a dimension that may be broadcast
RANGE_STEP = 65_536       # numbers that one row may turn into at once


def choose_block(df: DataFrame, keys: list[str], *, per: int = 1,
                 limit: int = GROUP_ROWS, block: int = BLOCK) -> int | None:
    """None if every group of `df` has at most `limit` rows (times `per`), else `block`.

    A table that is small as a whole needs no look at its groups. Only a count
    and a maximum reach the driver.
    """
    if df.count() <= limit * per:
        return None
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return block if largest > limit * per else None


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names. Only on a single machine one is made if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/activity_timeline/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def explode_range(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per whole number from `low` to `high`; no row holds more than RANGE_STEP of them."""
    steps = df.withColumn("_high", high).withColumn(
        "_step", F.explode(F.sequence(low, F.greatest(low, F.col("_high")),
                                      F.lit(RANGE_STEP).cast("bigint"))))
    last = F.least(F.col("_step") + (RANGE_STEP - 1), F.col("_high"))
    return (steps.where(F.col("_step") <= F.col("_high"))
            .withColumn(name, F.explode(F.sequence("_step", last))).drop("_high", "_step"))


def scan(df: DataFrame, keys: list[str], pos: str, block: int | None = None, *,
         previous: dict[str, Column] | None = None,
         following: dict[str, Column] | None = None,
         sums: dict[str, Column] | None = None,
         whole_max: dict[str, Column] | None = None) -> DataFrame:
    """Add to each row what lies around it in its group, ordered by `pos`.

    previous / following: value on the row just before / after (null if none);
    sums: sum over all earlier rows (0 if none); whole_max: maximum of the group.
    """
    previous, following = previous or {}, following or {}
    sums, whole_max = sums or {}, whole_max or {}
    if block is None:
        line = Window.partitionBy(*keys).orderBy(pos)
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        # ordered like the others, so that all share one pass
        group = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            "*",
            *[F.lag(c).over(line).alias(n) for n, c in previous.items()],
            *[F.lead(c).over(line).alias(n) for n, c in following.items()],
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in sums.items()],
            *[F.max(c).over(group).alias(n) for n, c in whole_max.items()],
        )

    kept = df.columns
    df = settle(df).withColumn("_slice", whole(F.col(pos), block))
    slice_keys = [*keys, "_slice"]
    before = F.struct(*[c.alias(n) for n, c in previous.items()]) if previous else F.lit(None)
    after = F.struct(*[c.alias(n) for n, c in following.items()]) if following else F.lit(None)

    # one row per slice: its edges and totals
    edges = df.groupBy(*slice_keys).agg(
        F.max_by(before, pos).alias("_last"), F.min_by(after, pos).alias("_first"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in whole_max.items()])
    along = Window.partitionBy(*keys).orderBy("_slice")
    carry = edges.select(
        *slice_keys,
        F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(along.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_max_{n}").over(Window.partitionBy(*keys)).alias(n) for n in whole_max])

    line = Window.partitionBy(*slice_keys).orderBy(pos)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*", F.lag(before).over(line).alias("_prev"), F.lead(after).over(line).alias("_next"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_local_{n}")
          for n, c in sums.items()])
    joined = local.join(carry, slice_keys)
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    next_ = F.coalesce(F.col("_next"), F.col("_after"))
    return joined.select(
        *kept,
        *[prev[n].alias(n) for n in previous],
        *[next_[n].alias(n) for n in following],
        *[(F.col(f"_local_{n}") + F.col(f"_carry_{n}")).alias(n) for n in sums],
        *[F.col(n) for n in whole_max])


def attach(df: DataFrame, dimension: DataFrame, on: list[str], spread_by: list[str], *,
           limit: int = BROADCAST_ROWS, hot_rows: int | None = None) -> DataFrame:
    """Left join with a dimension that is unique on `on`.

    Up to `limit` rows it is broadcast. A larger one is shuffled. Then each key
    with more than `hot_rows` rows in `df` is split into that many task loads by
    `spread_by`, and its dimension row is repeated for each; None says that no
    key of `df` is that large.
    """
    if dimension.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(dimension), on, "left")
    if hot_rows is None:
        return df.join(dimension, on, "left")
    # at most one key per hot_rows rows of df: small enough to broadcast
    hot = F.broadcast(
        df.groupBy(*on).count().where(F.col("count") > hot_rows)
        .select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_loads")))
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_loads")).cast("int")
    salted = df.join(hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = dimension.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_loads", F.lit(1)) - 1)))
    return (salted.drop("_loads").join(copies.drop("_loads"), [*on, "_salt"], "left")
            .drop("_salt"))


def number_in_order(df: DataFrame, keys: list[str], order: list[str], name: str,
                    block: int | None = None, *, rows: int = GROUP_ROWS) -> DataFrame:
    """Add the dense position (from 0) of each row in its group.

    `order` must be unique within a group. With slices the rows are range
    partitioned, written once to the checkpoint folder with their place in the
    partition, and shifted by the counts of the partitions before.
    """
    if block is None:
        line = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(line) - 1).cast("bigint"))

    spark = df.sparkSession
    default_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default_parts, ceil(df.count() / rows))
    path = scratch_path(spark, "ordered")
    (df.repartitionByRange(parts, *keys, *order)
       .sortWithinPartitions(*keys, *order)
       .withColumn("_place", F.monotonically_increasing_id())
       .write.parquet(path))
    # the id keeps the partition above bit 33 and the row number below it
    ranged = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))

    counts = ranged.groupBy(*keys, "_range").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *keys, "_range",
        (F.coalesce(F.sum("_rows").over(along), F.lit(0)) - F.col("_first")).alias("_shift"))
    shift_path = scratch_path(spark, "shifts")
    shifts.write.parquet(shift_path)
    shifts = spark.read.parquet(shift_path)
    if shifts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    return (ranged.join(shifts, [*keys, "_range"])
            .withColumn(name, F.col("_place") + F.col("_shift"))
            .drop("_place", "_range", "_shift"))
