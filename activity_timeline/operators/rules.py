"""Cameras, labels and gain events by the state of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_timeline.operators.slices import GROUP_ROWS, attach
from activity_timeline.params import Params
from activity_timeline.schemas import BOTH, SESSION, SPEAKER_A, SPEAKER_B

# Cameras of the two speakers when their tracks are not described.
CAMERA_A, CAMERA_B = 1, 2


def _speakers(tracks: DataFrame) -> DataFrame:
    """One row per session with what is known about its two tracks."""
    def of(track: int, column: str) -> Column:
        return F.max(F.when(F.col("track") == track, F.col(column)))

    return tracks.groupBy(SESSION).agg(
        of(0, "camera_index").alias("_camera_a"), of(1, "camera_index").alias("_camera_b"),
        of(0, "speaker_label").alias("_label_a"), of(1, "speaker_label").alias("_label_b"))


def assign_cameras(segments: DataFrame, tracks: DataFrame | None, params: Params,
                   block: int | None = None) -> DataFrame:
    """camera_index and speaker_label per segment; other columns stay."""
    if tracks is None:
        known = segments.select("*", *[
            F.lit(None).cast(t).alias(n) for n, t in (
                ("_camera_a", "int"), ("_camera_b", "int"),
                ("_label_a", "string"), ("_label_b", "string"))])
    else:
        known = attach(segments, _speakers(tracks), [SESSION], ["pos"],
                       hot_rows=None if block is None else GROUP_ROWS)
    state = F.col("speaker_state")
    camera = (F.when(state == SPEAKER_A, F.coalesce("_camera_a", F.lit(CAMERA_A)))
              .when(state == SPEAKER_B, F.coalesce("_camera_b", F.lit(CAMERA_B)))
              .when(state == BOTH, F.lit(params.both_speaking_camera))
              .otherwise(F.lit(params.default_camera)))
    label = (F.when(state == SPEAKER_A, F.coalesce("_label_a", F.lit(SPEAKER_A)))
             .when(state == SPEAKER_B, F.coalesce("_label_b", F.lit(SPEAKER_B))))
    columns = {"camera_index": camera.cast("int"), "speaker_label": label}
    return known.select(*[columns.get(c, F.col(c)).alias(c) for c in segments.columns])


def segment_gains(start_s: Column, state: Column, params: Params) -> Column:
    """The two gain events of one segment: the track that is not speaking is lowered."""
    full, low = F.lit(0.0), F.lit(float(params.ducking_db))

    def event(track: int, other: str) -> Column:
        return F.struct(start_s.alias("time_s"),
                        F.when(state == other, low).otherwise(full).alias("target_db"),
                        F.lit(track).alias("track_index"))

    return F.array(event(0, SPEAKER_B), event(1, SPEAKER_A))


def gain_events(segments: DataFrame, params: Params) -> DataFrame:
    """Gain events of numbered segments; no rows when ducking is off."""
    if not params.ducking_enabled:
        segments = segments.where(F.lit(False))
    return segments.select(SESSION, "seg_idx", F.inline(
        segment_gains(F.col("start_s"), F.col("speaker_state"), params)))
