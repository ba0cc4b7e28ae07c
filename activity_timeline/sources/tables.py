"""Tracks from tables: one row per sample, or one row per array of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_timeline.operators.slices import attach, number_in_order, scan
from activity_timeline.schemas import TRACK_KEYS


def samples_from(df: DataFrame, session: Column, track: Column, order_by: list[str],
                 value: Column, block: int | None = None) -> DataFrame:
    """Samples from rows that are ordered by `order_by` within their track."""
    order = [f"_order{i}" for i in range(len(order_by))]
    picked = df.select(
        session.cast("bigint").alias("session_id"), track.cast("int").alias("track"),
        *[F.col(c).alias(o) for c, o in zip(order_by, order)],
        value.cast("double").alias("x"))
    if block is None:
        # by session, not by track: every later step finds its rows in place
        picked = picked.repartition("session_id")
    return number_in_order(picked, TRACK_KEYS, order, "idx", block).select(*TRACK_KEYS, "idx", "x")


def samples_from_arrays(df: DataFrame, session: Column, track: Column, chunk: Column,
                        values: Column, block: int | None = None,
                        chunk_size: int | None = None) -> DataFrame:
    """Samples from tracks that are stored as arrays, `chunk` giving their order.

    If all chunks but the last of a track hold `chunk_size` samples and are
    numbered from 0, nothing is shuffled. Otherwise only their sizes are put in
    order; the arrays meet the result by their own key.
    """
    chunks = df.select(
        session.cast("bigint").alias("session_id"), track.cast("int").alias("track"),
        chunk.cast("bigint").alias("chunk"), values.cast("array<double>").alias("values"))
    if chunk_size is not None:
        placed = chunks.withColumn("first", F.col("chunk") * chunk_size)
    else:
        keys = [*TRACK_KEYS, "chunk"]
        sizes = chunks.select(*keys, F.size("values").cast("bigint").alias("n"))
        firsts = scan(sizes, TRACK_KEYS, "chunk", block, sums={"first": F.col("n")}).drop("n")
        placed = attach(chunks, firsts, keys, keys)
    return (placed.select(*TRACK_KEYS, "first", F.posexplode("values").alias("place", "x"))
            .select(*TRACK_KEYS, (F.col("first") + F.col("place")).alias("idx"), "x"))
