"""Frames to joint states: hysteresis with hangover, then both tracks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole
from activity_timeline.operators.frames import known_track, own_frames
from activity_timeline.params import Params
from activity_timeline.schemas import BOTH, SESSION, SILENCE, SPEAKER_A, SPEAKER_B


def activity_flags(frames: DataFrame, keys: list[str], suffixes: list[str], params: Params,
                   block: int | None = None) -> DataFrame:
    """Add is_active per frame (one column per suffix).

    A frame is active if some frame up to it was above the speech threshold,
    and no frame after that one was below the release threshold early enough
    for the hangover to be over. Both facts are running maxima of frame numbers.
    A release threshold above the speech threshold has rules of its own (`_crossed_flags`).
    """
    if params.release_threshold_db > params.speech_threshold_db:
        return _crossed_flags(frames, keys, suffixes, params, block)
    late = params.grid.hangover + 1
    marks = frames.select(
        "*",
        *[F.when(F.col(f"envelope_db{s}") > params.speech_threshold_db, F.col("frame"))
          .alias(f"_high{s}") for s in suffixes],
        *[F.when(F.col(f"envelope_db{s}") < params.release_threshold_db, F.col("frame"))
          .alias(f"_low{s}") for s in suffixes])
    group = keys if block is None else [*keys, "slice"]
    order = [c for c in ("span", "frame") if c in frames.columns]
    line = Window.partitionBy(*group).orderBy(*order)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    ended = line.rowsBetween(Window.unboundedPreceding, -late)
    seen = marks.select(
        *frames.columns,
        *[F.max(f"_high{s}").over(so_far).alias(f"_high{s}") for s in suffixes],
        *[F.max(f"_low{s}").over(ended).alias(f"_low{s}") for s in suffixes])

    def active(high: Column, low: Column) -> Column:
        return F.coalesce(high.isNotNull() & (low.isNull() | (low < high)), F.lit(False))

    if block is None:
        return seen.select(
            *frames.columns,
            *[active(F.col(f"_high{s}"), F.col(f"_low{s}")).alias(f"is_active{s}")
              for s in suffixes])

    # what earlier slices pass on: a high counts from its own frame, a low from
    # the frame at which its hangover is over
    totals = (own_frames(marks, block)
              .withColumn("_late", whole(F.col("frame") + late, block))
              .groupBy(*group, "_late")
              .agg(*[F.max(f"_{m}{s}").alias(f"_{m}{s}") for m in ("high", "low")
                     for s in suffixes]))
    parts = F.array(
        F.struct(F.col("slice").alias("slice"),
                 *[F.col(f"_high{s}").alias(f"_high{s}") for s in suffixes],
                 *[F.lit(None).cast("bigint").alias(f"_low{s}") for s in suffixes]),
        F.struct(F.col("_late").alias("slice"),
                 *[F.lit(None).cast("bigint").alias(f"_high{s}") for s in suffixes],
                 *[F.col(f"_low{s}").alias(f"_low{s}") for s in suffixes]))
    names = [f"_{m}{s}" for m in ("high", "low") for s in suffixes]
    per_slice = (totals.select(*keys, F.inline(parts)).groupBy(*group)
                 .agg(*[F.max(n).alias(n) for n in names]))
    earlier = (Window.partitionBy(*keys).orderBy("slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_slice.select(*group, *[F.max(n).over(earlier).alias(f"_carry{n}") for n in names])
    # inner: each slice with frames has a row here, and both sides then share one shuffle
    joined = own_frames(seen, block).join(carry, group)
    return joined.select(
        *frames.columns,
        *[active(F.greatest(F.col(f"_high{s}"), F.col(f"_carry_high{s}")),
                 F.greatest(F.col(f"_low{s}"), F.col(f"_carry_low{s}"))).alias(f"is_active{s}")
          for s in suffixes])


def _latest(frames: DataFrame, keys: list[str], marks: dict[str, Column],
            block: int | None) -> DataFrame:
    """Add the largest mark of each kind up to a frame; one row per slice is passed along."""
    group = keys if block is None else [*keys, "slice"]
    order = [c for c in ("span", "frame") if c in frames.columns]
    line = (Window.partitionBy(*group).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0))
    seen = frames.select("*", *[F.max(m).over(line).alias(n) for n, m in marks.items()])
    if block is None:
        return seen
    totals = frames.groupBy(*group).agg(*[F.max(m).alias(n) for n, m in marks.items()])
    earlier = (Window.partitionBy(*keys).orderBy("slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*group, *[F.max(n).over(earlier).alias(f"_carry{n}") for n in marks])
    return seen.join(carry, group).select(
        *frames.columns, *[F.greatest(n, f"_carry{n}").alias(n) for n in marks])


def _crossed_flags(frames: DataFrame, keys: list[str], suffixes: list[str], params: Params,
                   block: int | None) -> DataFrame:
    """Activity when release lies above speech.

    A level between the two is loud and quiet at once: it starts speech, in speech it starts
    the hangover, and in the hangover it ends that again. In a row of such frames the state
    changes with each, so it is known from the frame before the row (its last settled one) and
    from whether their distance is even. A frame that is quiet only stays active for the
    hangover after the last loud one, and a frame longer if that one was not in the hangover.
    Both facts are running maxima of 2 * frame plus one bit.
    """
    frame, columns = F.col("frame"), frames.columns
    loud = {s: F.col(f"envelope_db{s}") > params.speech_threshold_db for s in suffixes}
    quiet = {s: F.col(f"envelope_db{s}") < params.release_threshold_db for s in suffixes}
    if block is not None:
        frames = own_frames(frames, block)
    settled = _latest(frames, keys, {
        f"_settled{s}": F.when(~(loud[s] & quiet[s]), frame * 2 + loud[s].cast("int"))
        for s in suffixes}, block)

    def speaking(s: str) -> Column:
        """Whether a loud frame is in speech and not in the hangover; a track begins silent."""
        last = F.coalesce(F.col(f"_settled{s}"), F.lit(-2))
        even = (frame - F.shiftright(last, 1)) % 2 == 0
        return even == (last % 2 == 1)

    heard = _latest(settled, keys, {
        f"_heard{s}": F.when(loud[s], frame * 2 + speaking(s).cast("int"))
        for s in suffixes}, block)

    def active(s: str) -> Column:
        last = F.col(f"_heard{s}")
        since = frame - F.shiftright(last, 1)
        return F.coalesce(since <= params.grid.hangover + last % 2, F.lit(False))

    return heard.select(*columns, *[active(s).alias(f"is_active{s}") for s in suffixes])


def joint_state(a: Column, b: Column) -> Column:
    return (F.when(a & b, F.lit(BOTH)).when(a, F.lit(SPEAKER_A))
            .when(b, F.lit(SPEAKER_B)).otherwise(F.lit(SILENCE)))


def combine_tracks(frames: DataFrame) -> DataFrame:
    """State per frame from one row per track; stops where the shorter track stops."""
    lane = known_track()

    def of(track: int) -> Column:
        return F.max(F.when(lane == track, F.col("is_active")))

    pairs = frames.groupBy(SESSION, "frame").agg(of(0).alias("a"), of(1).alias("b"))
    return (pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .select(SESSION, "frame", joint_state(F.col("a"), F.col("b")).alias("speaker_state")))
