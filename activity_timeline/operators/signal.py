"""Preparation of samples: mixdown, resampling, padding, duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole
from activity_timeline.operators.slices import explode_range
from activity_timeline.schemas import SESSION, TRACK_KEYS

PAD_CHUNK = 65_536


def mono(channels: Column) -> Column:
    """Mean over the channels of one instant."""
    total = F.aggregate(channels, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(channels)


def mono_mixdown(samples: DataFrame) -> DataFrame:
    """Mean over channels when each channel has its own row."""
    return samples.groupBy(*TRACK_KEYS, "idx").agg(F.avg("x").alias("x"))


def track_lengths(samples: DataFrame) -> DataFrame:
    """Samples per track. Positions are dense, so counting rows need not number them first."""
    return samples.groupBy(*TRACK_KEYS).agg(F.count("*").alias("n"))


def session_duration(samples: DataFrame, sample_rate: int) -> DataFrame:
    """Seconds of the longest track of each session."""
    return track_lengths(samples).groupBy(SESSION).agg(
        (F.max("n") / F.lit(float(sample_rate))).alias("total_duration_s"))


def align_pad(samples: DataFrame, tracks: DataFrame | None = None,
              chunk: int = PAD_CHUNK) -> DataFrame:
    """Zeros after the end of every track that is shorter than its session.

    `tracks` names tracks that must exist even if they hold no sample. The
    zeros are made chunk by chunk, so no row ever expands without bound.
    """
    lengths = track_lengths(samples)
    if tracks is not None:
        lengths = (tracks.select(*TRACK_KEYS).join(lengths, TRACK_KEYS, "full")
                   .select(*TRACK_KEYS, F.coalesce("n", F.lit(0)).alias("n")))
    longest = lengths.withColumn("longest", F.max("n").over(Window.partitionBy(SESSION)))
    short = longest.where(F.col("n") < F.col("longest"))
    pieces = (explode_range(short, whole(F.col("n"), chunk), whole(F.col("longest") - 1, chunk),
                            "piece")
              .repartition(*TRACK_KEYS, "piece"))
    first = F.greatest(F.col("n"), F.col("piece") * chunk)
    last = F.least(F.col("longest"), (F.col("piece") + 1) * chunk) - 1
    zeros = pieces.select(*TRACK_KEYS, F.explode(F.sequence(first, last)).alias("idx"),
                          F.lit(0.0).alias("x"))
    return samples.select(*TRACK_KEYS, "idx", "x").unionByName(zeros)


def resample(samples: DataFrame, from_rate: int | Column, to_rate: int,
             block: int | None = None) -> DataFrame:
    """Linear interpolation to another rate; the last value is held at the end.

    `from_rate` may be a column with one value per track; tracks that have the
    rate already stay as they are.

    Each source sample writes the output samples that fall between it and the
    next one, so nothing is joined but the length of the track.
    """
    if not isinstance(from_rate, Column):
        if from_rate == to_rate:
            return samples
        from_rate = F.lit(from_rate)
    samples = samples.select(*TRACK_KEYS, "idx", "x", from_rate.cast("double").alias("_rate"))
    if block is None:
        line = Window.partitionBy(*TRACK_KEYS).orderBy("idx")
        track = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ready = samples.select(*TRACK_KEYS, "idx", "x", "_rate", F.count("*").over(track).alias("n"),
                               F.lead("x").over(line).alias("next_x"))
    else:
        slice_keys = [*TRACK_KEYS, "_slice"]
        own = whole(F.col("idx"), block)
        # the first sample of a slice is also the neighbour of the slice before
        edge = (F.col("idx") % block == 0) & (F.col("idx") > 0)
        spread = samples.withColumn("_slice", F.explode(
            F.when(edge, F.array(own, own - 1)).otherwise(F.array(own))))
        lengths = explode_range(track_lengths(samples), F.lit(0).cast("bigint"),
                                whole(F.col("n") - 1, block), "_slice")
        line = Window.partitionBy(*slice_keys).orderBy("idx")
        ready = (spread.withColumn("next_x", F.lead("x").over(line))
                 .where(own == F.col("_slice")).join(lengths, slice_keys))
    # a decimal product cannot overflow on tracks that need slices
    wide = "bigint" if block is None else "decimal(19,0)"
    n, idx = F.col("n"), F.col("idx")
    made = ready.withColumn("n_out", F.when(F.col("_rate") == to_rate, n).otherwise(
        (n / F.col("_rate") * F.lit(to_rate)).cast("bigint")))

    def first_output(i: Column) -> Column:
        product = i.cast(wide) * F.col("n_out").cast(wide)
        return whole(product + (n - 1).cast(wide), n.cast(wide))

    low = first_output(idx)
    high = F.least(first_output(idx + 1), F.col("n_out")) - 1
    at = (F.col("j").cast(wide) * n.cast(wide)).cast("double") / F.col("n_out") - idx
    next_x = F.coalesce("next_x", "x")
    return (made.withColumn("_low", low).withColumn("_high", high)
            .where(F.col("_low") <= F.col("_high"))
            .withColumn("j", F.explode(F.sequence("_low", "_high")))
            .select(*TRACK_KEYS, F.col("j").alias("idx"),
                    (F.col("x") + at * (next_x - F.col("x"))).alias("x")))
