"""Clip lists of a timeline: video clips, audio clips, volume keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import linear_gain, seconds_to_frames
from activity_timeline.functions.paths import file_stem
from activity_timeline.operators.slices import GROUP_ROWS, attach
from activity_timeline.operators.timelines import Timelines, timeline_events, timeline_segments
from activity_timeline.schemas import SESSION


def video_clips(timelines: Timelines, cameras: DataFrame) -> DataFrame:
    """One clip per segment. A camera that the session does not have becomes camera 0.

    `cameras`: session_id, camera_index (dense from 0), path.
    """
    segments = timeline_segments(timelines)
    wide = cameras.where(F.col("camera_index") == 0).select(SESSION, F.col("path").alias("_wide"))
    named = attach(segments, cameras.select(SESSION, "camera_index", "path"),
                   [SESSION, "camera_index"], ["seg_idx"], hot_rows=GROUP_ROWS)
    named = attach(named, wide, [SESSION], ["seg_idx"], hot_rows=GROUP_ROWS)
    fps = F.col("fps")
    index = F.when(F.col("path").isNotNull(), F.col("camera_index"))
    index = F.when(F.col("camera_index") < 0, F.raise_error(F.lit("negative camera index"))
                   .cast("int")).otherwise(F.coalesce(index, F.lit(0)))
    start, end = (seconds_to_frames(F.col(c), fps) for c in ("start_s", "end_s"))
    # formats of names and ids, here and for audio: fixed values
    return (named.withColumn("_index", index)
            .select(SESSION, "seg_idx", "fps",
                    F.format_string("clipitem-v%d", "seg_idx").alias("clip_id"),
                    F.format_string("Cam%d - %s", "_index", "speaker_state").alias("name"),
                    F.col("_index").alias("camera_index"),
                    start.alias("start_frame"), end.alias("end_frame"),
                    (end - start).alias("duration_frames"),
                    F.format_string("file-cam%d", "_index").alias("file_id"),
                    F.coalesce("path", "_wide").alias("path"),
                    seconds_to_frames(F.col("total_duration_s"), fps).alias("file_frames")))


def mark_first_use(clips: DataFrame) -> DataFrame:
    """Add is_definition: the first clip of each file in its session describes the file."""
    first = (clips.groupBy(SESSION, "file_id").agg(F.min("seg_idx").alias("seg_idx"))
             .withColumn("_first", F.lit(True)))
    # seg_idx is part of the key, so even a hot session spreads evenly
    return (clips.join(first, [SESSION, "file_id", "seg_idx"], "left")
            .withColumn("is_definition", F.coalesce("_first", F.lit(False))).drop("_first"))


def microphones(tracks: DataFrame) -> DataFrame:
    """session_id, _mic_0, _mic_1 of the sessions where both tracks have a path."""
    paths = tracks.groupBy(SESSION).agg(*[
        F.max(F.when(F.col("track") == t, F.col("path"))).alias(f"_mic_{t}") for t in (0, 1)])
    return paths.where(F.col("_mic_0").isNotNull() & F.col("_mic_1").isNotNull())


def audio_clips(timelines: Timelines, tracks: DataFrame) -> DataFrame:
    """One clip of full length for either track, for sessions where both have a path."""
    both = F.array(*[F.struct(F.lit(t).alias("track"), F.col(f"_mic_{t}").alias("path"))
                     for t in (0, 1)])
    usable = microphones(tracks).select(SESSION, F.inline(both))
    return (timelines.heads.join(usable, SESSION)
            .select(SESSION, "track", "fps",
                    F.format_string("clipitem-a%d", "track").alias("clip_id"),
                    file_stem(F.col("path")).alias("name"),
                    F.lit(0).cast("bigint").alias("start_frame"),
                    seconds_to_frames(F.col("total_duration_s"), F.col("fps")).alias("end_frame"),
                    F.format_string("file-audio%d", "track").alias("file_id"), "path"))


def keyframes(timelines: Timelines) -> DataFrame:
    """Volume keyframes per track: frame number and linear gain as text."""
    return timeline_events(timelines).select(
        SESSION, "place", F.col("track_index").alias("track"),
        seconds_to_frames(F.col("time_s"), F.col("fps")).alias("frame"),
        F.format_string("%.4f", linear_gain(F.col("target_db"))).alias("gain"))
