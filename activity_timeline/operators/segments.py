"""States to segments: runs, absorption of short segments, merging.

Inside this module a segment list is a list of cuts: one row per segment with
its own start, the end of the segment before it, and the end of the session.
Absorbing and merging then only drop cuts, so the chain keeps its order and
needs one sort. The end of a segment is read from the next cut that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole
from activity_timeline.operators.segment_slices import clean_in_slices
from activity_timeline.operators.slices import GROUP_ROWS, choose_block, scan
from activity_timeline.params import Params
from activity_timeline.schemas import SEGMENTS, SESSION

KEYS = [SESSION]
CUT = [SESSION, "pos", "start_s", "before_end_s", "last_end_s",
       "camera_index", "speaker_state", "speaker_label"]


def _next_end() -> dict[str, Column]:
    return {"_next_end": F.col("before_end_s")}


def _end() -> Column:
    return F.coalesce("_next_end", "last_end_s")


def _cuts_of_states(states: DataFrame, hop_s: float, block: int | None) -> DataFrame:
    group = KEYS
    if block is not None:
        if "slice" not in states.columns:
            states = states.withColumn("slice", whole(F.col("frame"), block))
        group = [SESSION, "slice"]
    order = [c for c in ("span", "frame") if c in states.columns]
    line = Window.partitionBy(*group).orderBy(*order)
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("speaker_state"))
    hop = F.lit(hop_s)
    cuts = (states.select(
                "*", F.lag("speaker_state").over(line).alias("_before"),
                # ordered like the lag, so that both share one pass
                F.max("frame").over(line.rowsBetween(
                    Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
            .where(changed)
            .select(SESSION, F.col("frame").alias("pos"), (F.col("frame") * hop).alias("start_s"),
                    F.when(F.col("frame") > 0, F.col("frame") * hop).alias("before_end_s"),
                    ((F.col("_last") + 1) * hop).alias("last_end_s"),
                    F.lit(0).alias("camera_index"), "speaker_state",
                    F.lit(None).cast("string").alias("speaker_label")))
    if block is None:
        return cuts
    # the first frame of a slice looked like a change: drop it if it was none
    looked = scan(cuts, KEYS, "pos", block, previous={"_before": F.col("speaker_state")},
                  whole_max={"_last_end": F.col("last_end_s")})
    return (looked.where(changed).withColumn("last_end_s", F.col("_last_end"))
            .select(*CUT))


def _open(segments: DataFrame, block: int | None) -> DataFrame:
    looked = scan(segments, KEYS, "pos", block, previous={"before_end_s": F.col("end_s")},
                  whole_max={"last_end_s": F.col("end_s")})
    return looked.select(*CUT)


def _close(cuts: DataFrame, block: int | None, numbered: bool = False) -> DataFrame:
    sums = {"seg_idx": F.lit(1).cast("bigint")} if numbered else {}
    return (scan(cuts, KEYS, "pos", block, following=_next_end(), sums=sums)
            .select(SESSION, "pos", "start_s", _end().alias("end_s"),
                    "camera_index", "speaker_state", "speaker_label", *sums))


def _drop_short(cuts: DataFrame, min_s: float, block: int | None) -> DataFrame:
    looked = scan(cuts, KEYS, "pos", block, following=_next_end())
    first = F.col("before_end_s").isNull()
    return looked.where(first | ~(_end() - F.col("start_s") < F.lit(min_s))).select(*CUT)


def _drop_equal(cuts: DataFrame, block: int | None) -> DataFrame:
    looked = scan(cuts, KEYS, "pos", block, previous={"_before": F.col("speaker_state")})
    kept = F.col("before_end_s").isNull() | (F.col("_before") != F.col("speaker_state"))
    return looked.where(kept).select(*CUT)


def run_lengths(states: DataFrame, hop_s: float, block: int | None = None) -> DataFrame:
    """One segment per run of equal states."""
    return _close(_cuts_of_states(states, hop_s, block), block)


def absorb_short(segments: DataFrame, min_s: float, block: int | None = None) -> DataFrame:
    """Each segment shorter than `min_s` joins the kept one before it; the first stays."""
    return _close(_drop_short(_open(segments, block), min_s, block), block)


def merge_adjacent(segments: DataFrame, block: int | None = None) -> DataFrame:
    """Neighbours with the same state become one, with the first one's attributes."""
    return _close(_drop_equal(_open(segments, block), block), block)


def _clean(cuts: DataFrame, params: Params, block: int | None) -> DataFrame:
    if block is not None:
        return clean_in_slices(cuts, params.grid.debounce_s, params.grid.min_segment_s, block)
    for min_s in (params.grid.debounce_s, params.grid.min_segment_s):
        cuts = _drop_short(cuts, min_s, block)
    return _close(_drop_equal(cuts, block), block, numbered=True)


def clean_segments(segments: DataFrame, params: Params, block: int | None = None) -> DataFrame:
    """Debounce, minimum length and merging of a given segment list; numbers the result."""
    return _clean(_open(segments, block), params, block)


def segment_states(states: DataFrame, params: Params, block: int | None = None,
                   limit: int = GROUP_ROWS) -> DataFrame:
    """Runs, debounce, minimum length and merging, in this order; numbers the result.

    A session with too many frames for one task mostly has far fewer runs: the
    later steps need slices only if some session has more than `limit` runs.
    """
    cuts = _cuts_of_states(states, params.grid.hop_s, block)
    if block is not None:
        block = choose_block(cuts, KEYS, limit=limit, block=block)
    return _clean(cuts, params, block)


def duration_s() -> Column:
    return F.col("end_s") - F.col("start_s")


def number_segments(segments: DataFrame, block: int | None = None) -> DataFrame:
    """Add seg_idx, the place of a segment in its session, from 0."""
    return scan(segments, KEYS, "pos", block, sums={"seg_idx": F.lit(1).cast("bigint")})


def as_segments(df: DataFrame) -> DataFrame:
    """Columns of a segment list in their declared types; missing ones get defaults."""
    defaults = {"camera_index": F.lit(0), "speaker_label": F.lit(None)}
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else defaults[f.name])
        .cast(f.dataType).alias(f.name) for f in SEGMENTS.fields])
