"""Readable reports of timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.operators.timelines import Timelines, timeline_segments
from activity_timeline.schemas import SESSION

BAR_WIDTH = 50  # fixed value: characters for the whole session


def timeline_summary(timelines: Timelines) -> DataFrame:
    """Duration, rate, number of segments and of gain events per session, and as text."""
    counts = timelines.heads
    for items, name in ((timelines.segments, "n_segments"),
                        (timelines.events, "n_ducking_events")):
        found = items.groupBy(SESSION).agg(F.count("*").alias(name))
        counts = counts.join(found, SESSION, "left").fillna(0, [name])
    # the lines that are printed: fixed values
    return counts.select(
        "*",
        F.format_string("Duration: %.1fs | FPS: %s | Segments: %d", "total_duration_s",
                        F.col("fps").cast("string"), "n_segments").alias("header"),
        F.when(F.col("n_ducking_events") > 0,
               F.format_string("Ducking events: %d", "n_ducking_events")).alias("footer"))


def segment_report(timelines: Timelines) -> DataFrame:
    """One row per segment: number, label (or state if it has none), bar, printed line."""
    share = (F.col("end_s") - F.col("start_s")) / F.nullif(F.col("total_duration_s"), F.lit(0.0))
    width = F.greatest(F.lit(1), F.coalesce((share * BAR_WIDTH).cast("int"), F.lit(1)))
    label = F.coalesce(F.nullif(F.col("speaker_label"), F.lit("")), F.col("speaker_state"))
    rows = timeline_segments(timelines).select(
        SESSION, (F.col("seg_idx") + 1).alias("number"), "start_s", "end_s", "camera_index",
        label.alias("label"), F.repeat(F.lit("#"), width).alias("bar"))
    return rows.withColumn("line", F.format_string(
        "  %3d  %7.2fs - %7.2fs  [cam%d]  %-12s  %s",
        "number", "start_s", "end_s", "camera_index", "label", "bar"))
