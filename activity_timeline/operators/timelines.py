"""Timelines: heads, segments and gain events of sessions as three flat relations.

No row grows with its session, so sessions of any length have the same layout.
A document is a relation, too: pieces of text in the order of (section, place),
to be joined by line breaks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_timeline.operators.rules import gain_events
from activity_timeline.params import Params
from activity_timeline.schemas import DEFAULT_FPS, DOCUMENT, GAIN_EVENT, SEGMENT, SESSION, STATES

LINE_KEYS = [SESSION, "section", "place"]
HEAD, SEGMENTS, BETWEEN, EVENTS, END = range(5)
# The text of a document around its segments and its gain events.
BEFORE_SEGMENTS, BEFORE_EVENTS, CLOSING = ',"segments":[', '],"ducking_events":[', "]}"
_HEAD = T.StructType([DOCUMENT["total_duration_s"], DOCUMENT["fps"]])
_NULLS = {"ignoreNullFields": "false"}
_STRICT = {"mode": "FAILFAST"}


class Timelines(NamedTuple):
    """heads: session_id, total_duration_s, fps. segments: session_id, seg_idx and SEGMENT.
    events: session_id, place (from 0, in order) and GAIN_EVENT."""

    heads: DataFrame
    segments: DataFrame
    events: DataFrame


def assemble(segments: DataFrame, durations: DataFrame, params: Params,
             fps: float | Column = DEFAULT_FPS) -> Timelines:
    """Timelines from numbered segments and one duration per session.

    `fps` may be a column of `durations`. Sessions without segments are kept.
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    place = F.col("seg_idx") * 2 + F.col("track_index")
    return Timelines(
        durations.select(SESSION, "total_duration_s", rate.cast("double").alias("fps")),
        segments.select(SESSION, "seg_idx", *SEGMENT.fieldNames()),
        gain_events(segments, params).select(SESSION, place.cast("bigint").alias("place"),
                                             *GAIN_EVENT.fieldNames()))


def timeline_segments(timelines: Timelines) -> DataFrame:
    """One row per segment, with the values of its session's head."""
    return timelines.segments.join(timelines.heads, SESSION)


def timeline_events(timelines: Timelines) -> DataFrame:
    """One row per gain event, with the values of its session's head."""
    return timelines.events.join(timelines.heads, SESSION)


def to_document(timelines: Timelines) -> DataFrame:
    """JSON documents as session_id, section, place, text; null labels are written."""
    def item(df: DataFrame, section: int, place: str, fields: list[str]) -> DataFrame:
        comma = F.when(F.col(place) > 0, ",").otherwise("")
        return df.select(SESSION, F.lit(section).alias("section"), F.col(place).alias("place"),
                         F.concat(comma, F.to_json(F.struct(*fields), _NULLS)).alias("text"))

    opening = F.to_json(F.struct(*_HEAD.fieldNames()), _NULLS)
    around = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("place"),
                 text.alias("text"))
        for section, text in (
            (HEAD, F.concat(F.rtrim(opening, F.lit("}")), F.lit(BEFORE_SEGMENTS))),
            (BETWEEN, F.lit(BEFORE_EVENTS)), (END, F.lit(CLOSING)))])
    return (timelines.heads.select(SESSION, F.inline(around))
            .unionByName(item(timelines.segments, SEGMENTS, "seg_idx", SEGMENT.fieldNames()))
            .unionByName(item(timelines.events, EVENTS, "place", GAIN_EVENT.fieldNames())))


def _require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _present(names: list[str]) -> Column:
    return F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 0


def check_timelines(timelines: Timelines) -> Timelines:
    """Fill the default rate, and fail on values that are missing or unknown.

    Rows that have a section are judged only in their own one: filters may be
    merged and run in any order.
    """
    known = F.coalesce(F.col("speaker_state").isin(STATES), F.lit(False))
    rules = {
        "heads": (HEAD, F.col("total_duration_s").isNotNull(), "total_duration_s is missing"),
        "segments": (SEGMENTS, _present(["start_s", "end_s", "camera_index"]) & known,
                     "a segment is incomplete or has an unknown state"),
        "events": (EVENTS, _present(GAIN_EVENT.fieldNames()), "a gain event is incomplete")}
    checked = {}
    for name, (section, ok, message) in rules.items():
        df = getattr(timelines, name)
        if "section" in df.columns:
            ok = (F.col("section") != section) | ok
        checked[name] = _require(df, ok, message).drop("section")
    heads = checked.pop("heads").withColumn("fps", F.coalesce("fps", F.lit(DEFAULT_FPS)))
    return Timelines(heads, **checked)


def from_document(lines: DataFrame) -> Timelines:
    """Timelines from the pieces that to_document makes."""
    def read(section: int, place: str, text: Column, schema: T.StructType) -> DataFrame:
        # null for other sections; a filter on the section may run after the parsing, and one
        # by equality would also remove this condition
        mine = F.when(F.col("section") == section, text)
        return (lines.where(F.col("section").between(section, section))
                .select(SESSION, "section", F.col("place").alias(place),
                        F.from_json(mine, schema, _STRICT).alias("_d"))
                .where(F.col("_d").isNotNull())
                .select(SESSION, "section", place, "_d.*"))

    opening = F.concat(F.expr(f"left(text, length(text) - {len(BEFORE_SEGMENTS)})"), F.lit("}"))
    item = F.ltrim(F.col("text"), F.lit(","))
    return check_timelines(Timelines(read(HEAD, "place", opening, _HEAD).drop("place"),
                                     read(SEGMENTS, "seg_idx", item, SEGMENT),
                                     read(EVENTS, "place", item, GAIN_EVENT)))


def from_whole_documents(documents: DataFrame) -> Timelines:
    """Timelines from session_id, json: the text of one whole document per row.

    More than one root in a text, or two texts of one session, is an error.
    """
    # as a list: what follows the first root would be passed over otherwise
    roots = F.from_json(F.concat(F.lit("["), "json", F.lit("]")), T.ArrayType(DOCUMENT), _STRICT)
    read = documents.select(SESSION, roots.alias("_roots"))
    read = _require(read, F.coalesce(F.size("_roots") == 1, F.lit(False)),
                    "a document does not hold exactly one root")
    read = read.select(SESSION, F.get("_roots", F.lit(0)).alias("_d")).select(SESSION, "_d.*")
    read = _require(read, F.col("segments").isNotNull(), "segments are missing")
    single = read.groupBy(SESSION).agg(
        F.max("total_duration_s").alias("total_duration_s"), F.max("fps").alias("fps"),
        F.count("*").alias("_n"))
    heads = _require(single, F.col("_n") == 1, "two documents of one session").drop("_n")

    def items(column: str, place: str) -> DataFrame:
        found = read.select(SESSION, F.posexplode(column).alias(place, "_i"))
        return found.select(SESSION, F.col(place).cast("bigint").alias(place), "_i.*")

    return check_timelines(Timelines(heads, items("segments", "seg_idx"),
                                     items("ducking_events", "place")))
