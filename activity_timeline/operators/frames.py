"""Samples to frames: windowed level in dB, smoothed level, frame table.

Frame i covers samples [i*hop, i*hop+window). Samples are first added up in
panes: a hop is one pane if the window holds whole hops, else it is cut in two
where the window ends inside it. A frame is the sum of neighbouring panes, and
a second of sound is two panes per hop at most, whatever the two sizes are. In the paired layout the two tracks of a session are columns of one row
(names end in _0 and _1), which also pads the shorter track with silence.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import level_db, whole
from activity_timeline.params import Params, smoothing_span
from activity_timeline.schemas import SESSION, TRACK_KEYS

# From this mean size on panes are worth adding up before the shuffle.
PREAGGREGATE_PANE = 4


def pane_number(params: Params) -> Column:
    """The pane that a sample falls into."""
    hop, part, idx = params.grid.hop, params.grid.part, F.col("idx")
    if hop == 1:
        return idx
    number = whole(idx, hop)
    return number * 2 + (idx % hop >= part).cast("int") if part else number


def pane_energy(samples: DataFrame, params: Params) -> DataFrame:
    """Energy per track and pane: session_id, track, pane, n, energy."""
    if params.grid.hop == 1:
        return samples.select(*TRACK_KEYS, F.col("idx").alias("pane"), F.lit(1).alias("n"),
                              (F.col("x") * F.col("x")).alias("energy"))
    return samples.groupBy(*TRACK_KEYS, pane_number(params).alias("pane")).agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy"))


def known_track() -> Column:
    """The track of a row; any but 0 and 1 is an error."""
    return F.when(F.col("track").isin(0, 1), F.col("track")).otherwise(
        F.raise_error(F.lit("tracks other than 0 and 1 cannot be paired")).cast("int"))


def paired_energy(samples: DataFrame, params: Params, block: int | None = None) -> DataFrame:
    """Energy of both tracks per pane: session_id, [slice], pane, n, energy_0, energy_1.

    Small panes would not shrink the data much, so their samples go straight
    to the session or slice where the frames are made.
    """
    samples = samples.withColumn("pane", pane_number(params))
    keys = [SESSION, "pane"]
    if ordered_rows(params) == 1:
        if block is None:
            samples = samples.repartition(SESSION)
        else:
            samples = _in_slices(samples, params, block)
            keys = [SESSION, "slice", "pane"]
    square = F.col("x") * F.col("x")

    lane = known_track()

    def of(track: int, value):
        return F.when(lane == track, value)

    return samples.groupBy(*keys).agg(
        F.greatest(F.count(of(0, 1)), F.count(of(1, 1))).alias("n"),
        *[F.coalesce(F.sum(of(t, square)), F.lit(0.0)).alias(f"energy_{t}") for t in (0, 1)])


def paired_durations(panes: DataFrame, params: Params, block: int | None = None) -> DataFrame:
    """Seconds of the longest track of each session, from the panes of paired_energy.

    Positions are dense, so the longer track has the larger count in every pane. Energies
    are never negative: the condition keeps every pane, and makes this read the columns that
    the frames read, so that one query over both shuffles the samples once.
    """
    if "slice" in panes.columns:
        size = block * params.grid.panes_per_hop
        panes = panes.where(whole(F.col("pane"), size) == F.col("slice"))
    return (panes.where((F.col("energy_0") >= 0) & (F.col("energy_1") >= 0))
            .groupBy(SESSION).agg((F.sum("n") / F.lit(float(params.sample_rate)))
                                  .alias("total_duration_s")))


def ordered_rows(params: Params) -> int:
    """Samples for each row that the task of a session puts in order."""
    pane = params.grid.hop // params.grid.panes_per_hop
    return pane if pane >= PREAGGREGATE_PANE else 1


def frame_block(params: Params, block: int | None) -> int | None:
    """`block` rounded up so that a slice holds its run-in and whole spans."""
    if block is None:
        return None
    grid = params.grid
    reach = ceil(grid.panes_per_window / grid.panes_per_hop)
    return grid.span * ceil(max(block, grid.run_in, reach) / grid.span)


def _in_slices(panes: DataFrame, params: Params, block: int) -> DataFrame:
    """Panes with a slice number; panes near an edge go to the neighbour as well."""
    h, m = params.grid.panes_per_hop, params.grid.panes_per_window
    size, lead = block * h, params.grid.run_in
    pane = F.col("pane")
    own = whole(pane, size)
    place = pane % size
    targets = F.array(
        own,
        F.when(place >= size - lead * h, own + 1),
        F.when((place <= m - 1 - h) & (own > 0), own - 1))
    return (panes.withColumn("slice", F.explode(F.array_compact(targets)))
            .repartition(SESSION, "slice"))


def frame_levels(panes: DataFrame, keys: list[str], energies: dict[str, str], params: Params,
                 block: int | None = None, span: int | None = None) -> DataFrame:
    """Level per complete frame: keys, [slice], [span], frame and one column per energy.

    `energies` maps an energy column to the level column made from it. `span`
    puts frames into runs of that many, so that later steps find them sorted.
    """
    window = params.grid.window
    h, m = params.grid.panes_per_hop, params.grid.panes_per_window
    if block is not None:
        if "slice" not in panes.columns:
            panes = _in_slices(panes, params, block)
        keys = [*keys, "slice"]
    frames = panes.withColumn("frame", whole(F.col("pane"), h))
    order = ["frame"]
    if span is not None:
        frames = frames.withColumn("span", whole(F.col("frame"), span))
        order = ["span", *order]
    kept = [*keys, *order]
    if h > 1:
        frames = frames.withColumn("step", F.col("pane") % h)
        order = [*order, "step"]
    if m > 1:
        cover = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, m - 1)
        frames = frames.select(*kept, *order[len(kept) - len(keys):],
                               F.sum("n").over(cover).alias("n"),
                               *[F.sum(e).over(cover).alias(e) for e in energies])
    if h > 1:
        frames = frames.where(F.col("step") == 0)
    return (frames.where(F.col("n") == window)
            .select(*kept, *[level_db(F.col(e), window).alias(name)
                             for e, name in energies.items()]))


def smooth(frames: DataFrame, keys: list[str], levels: dict[str, str], kernel: int) -> DataFrame:
    """Exponential moving average, seeded with the first level.

    Inside a span the recurrence is a prefix sum with weights q^-k; of all
    earlier spans only the last value of the one before still has weight.
    """
    alpha = 2.0 / (kernel + 1)
    q = 1.0 - alpha
    if q == 0.0:
        return frames.select("*", *[F.col(a).alias(b) for a, b in levels.items()])
    size = smoothing_span(kernel)
    columns = frames.columns
    if "span" not in columns:
        frames = frames.withColumn("span", whole(F.col("frame"), size))
    if "slice" in columns:
        keys = [*keys, "slice"]
    inside = (Window.partitionBy(*keys, "span").orderBy("frame")
              .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(*keys).orderBy("span", "frame")
              .rowsBetween(Window.unboundedPreceding, -1))
    k = (F.col("frame") % size).cast("double")

    def weighted(level: str):
        seed = F.when(F.col("frame") == 0, F.col(level)).otherwise(F.lit(alpha) * F.col(level))
        return F.sum(seed * F.pow(F.lit(q), -k)).over(inside) * F.pow(F.lit(q), k)

    local = frames.select("*", *[weighted(a).alias(f"_local_{b}") for a, b in levels.items()])

    def carried(name: str):
        closing = F.when(F.col("frame") % size == size - 1, F.col(f"_local_{name}"))
        return F.coalesce(F.last(closing, ignorenulls=True).over(before), F.lit(0.0))

    return local.select(
        *frames.columns,
        *[(F.col(f"_local_{b}") + F.pow(F.lit(q), k + 1) * carried(b)).alias(b)
          for b in levels.values()])


def frame_table(panes: DataFrame, keys: list[str], tracks: dict[str, str], params: Params,
                block: int | None = None) -> DataFrame:
    """Frames with time, level and smoothed level.

    `tracks` maps an energy column to the suffix of its level columns ("" for
    one track per row). With slices the frames of the run-in are still there.
    """
    levels = {e: f"rms_db{s}" for e, s in tracks.items()}
    smoothed = {f"rms_db{s}": f"envelope_db{s}" for s in tracks.values()}
    frames = frame_levels(panes, keys, levels, params, block, params.grid.span)
    return (smooth(frames, keys, smoothed, params.grid.kernel)
            .withColumn("time_s", F.col("frame") * F.lit(params.grid.hop_s)))


def own_frames(frames: DataFrame, block: int | None) -> DataFrame:
    """Frames without the run-in copies of other slices."""
    if block is None:
        return frames
    return frames.where(whole(F.col("frame"), block) == F.col("slice"))
