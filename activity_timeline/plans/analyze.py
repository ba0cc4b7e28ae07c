"""Samples of all sessions to timelines, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_timeline.operators.activity import activity_flags, joint_state
from activity_timeline.operators.frames import (
    frame_block, frame_table, ordered_rows, own_frames, paired_durations, paired_energy)
from activity_timeline.operators.rules import assign_cameras
from activity_timeline.operators.segments import segment_states
from activity_timeline.operators.slices import GROUP_ROWS, choose_block
from activity_timeline.operators.timelines import Timelines, assemble
from activity_timeline.params import Params
from activity_timeline.schemas import DEFAULT_FPS, SESSION

PAIR = {"energy_0": "_0", "energy_1": "_1"}
CHOOSE = "choose"


def _chosen(samples: DataFrame, params: Params, block: int | None | str) -> int | None:
    if "sample_rate" in samples.columns:
        raise ValueError("samples still have the rates of their files; ingest() brings them to one")
    if block == CHOOSE:
        block = choose_block(samples, [SESSION], per=ordered_rows(params))
    return frame_block(params, block)


def paired_frames(samples: DataFrame, params: Params,
                  block: int | None | str = CHOOSE) -> DataFrame:
    """Frames with the levels and flags of both tracks side by side.

    The shorter track of a session is silent after its end.
    """
    block = _chosen(samples, params, block)
    return _frames_of(paired_energy(samples, params, block), params, block)


def _frames_of(panes: DataFrame, params: Params, block: int | None) -> DataFrame:
    frames = frame_table(panes, [SESSION], PAIR, params, block)
    return own_frames(activity_flags(frames, [SESSION], list(PAIR.values()), params, block), block)


def _states_of(panes: DataFrame, params: Params, block: int | None) -> DataFrame:
    frames = _frames_of(panes, params, block)
    helpers = [c for c in ("slice", "span") if c in frames.columns]
    return frames.select(SESSION, *helpers, "frame", joint_state(
        F.col("is_active_0"), F.col("is_active_1")).alias("speaker_state"))


def joint_states(samples: DataFrame, params: Params,
                 block: int | None | str = CHOOSE) -> DataFrame:
    """State per frame: session_id, frame, speaker_state (and the sort helpers)."""
    block = _chosen(samples, params, block)
    return _states_of(paired_energy(samples, params, block), params, block)


def segments(samples: DataFrame, params: Params, block: int | None | str = CHOOSE,
             limit: int = GROUP_ROWS) -> DataFrame:
    """Clean numbered segments of each session."""
    block = _chosen(samples, params, block)
    return segment_states(joint_states(samples, params, block), params, block, limit)


def analyze(samples: DataFrame, tracks: DataFrame | None, params: Params,
            fps: float | Column = DEFAULT_FPS, block: int | None | str = CHOOSE,
            store: str | None = None) -> Timelines:
    """Timelines of all sessions. `samples`: session_id, track (0 or 1), idx, x.

    Heads, segments and events come from the same panes, so a query over all of them
    reads and shuffles the samples once. Actions of their own would each read them again:
    with `store` the panes (one or two rows per hop) are written to that folder first, and
    the three relations read nothing else. The folder must not exist; it stays.
    """
    block = _chosen(samples, params, block)
    panes = paired_energy(samples, params, block)
    if store is not None:
        panes.write.parquet(store)
        panes = samples.sparkSession.read.parquet(store)
    states = _states_of(panes, params, block)
    placed = assign_cameras(segment_states(states, params, block), tracks, params, block)
    return assemble(placed, paired_durations(panes, params, block), params, fps)
