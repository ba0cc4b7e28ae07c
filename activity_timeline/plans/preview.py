"""Timelines to report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from activity_timeline.operators.report import segment_report, timeline_summary
from activity_timeline.operators.timelines import Timelines


def preview(timelines: Timelines) -> tuple[DataFrame, DataFrame]:
    """Summary per session, and one row per segment."""
    return timeline_summary(timelines), segment_report(timelines)
