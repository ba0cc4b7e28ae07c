"""Timelines to interchange documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from activity_timeline.operators.interchange import sequence_documents
from activity_timeline.operators.timelines import Timelines
from activity_timeline.sources.documents import write_documents

SEQUENCE_NAME = "Rough Cut"


def export(timelines: Timelines, cameras: DataFrame, tracks: DataFrame | None = None,
           name: str = SEQUENCE_NAME, width: int = 1920, height: int = 1080,
           block: int | None = None) -> DataFrame:
    """session_id, section, place, text: the texts of a session in order, joined by line breaks.

    There is no audio without `tracks`, nor for sessions where not both tracks
    have a path. `block` as elsewhere: None says that a task can order the rows of
    any session, and all relations are read once and shuffled once. With a block,
    sessions may be of any length; then a document is made from several views of its
    timeline, so where these are costly, write them first and export what is read back.
    """
    return sequence_documents(timelines, cameras, tracks, name, width, height, block)


def save(documents: DataFrame, path: str) -> None:
    write_documents(documents, path)
