import numpy as np
import pytest
from brute import ema, flags, rms_db
from fixtures import as_samples, bursts, noisy_sessions, tone
from pyspark.sql import functions as F

from activity_timeline import Params
from activity_timeline.operators.activity import activity_flags, combine_tracks
from activity_timeline.operators.frames import (
    frame_block, frame_levels, frame_table, own_frames, pane_energy, smooth)
from activity_timeline.schemas import TRACK_KEYS


def per_track(df, *names):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.track, r.frame)):
        out.setdefault((r.session_id, r.track), []).append(
            (r.frame, *[r[n] for n in names]))
    return out


@pytest.mark.parametrize("window, hop", [(480, 160), (30, 20), (661, 220), (7, 3), (4, 6), (10, 10), (3, 1),
                                         (1, 1)])
@pytest.mark.parametrize("sliced", [False, True])
def test_levels_of_all_complete_windows(spark, window, hop, sliced):
    # one sample per millisecond
    p = Params(sample_rate=1000, window_ms=window, hop_ms=hop, smoothing_ms=1, hangover_ms=1)
    size = 40 * hop + window
    tracks = noisy_sessions(1, {(0, 0): size + hop - 1, (0, 1): window, (1, 0): window - 1,
                                (2, 0): size})
    block = frame_block(p, 5) if sliced else None
    got = per_track(own_frames(frame_levels(
        pane_energy(as_samples(spark, tracks), p), TRACK_KEYS, {"energy": "rms_db"}, p, block),
        block), "rms_db")
    for key, x in tracks.items():
        want = rms_db(x, window, hop)
        line = got.get(key, [])
        assert [f for f, _ in line] == list(range(len(want)))
        assert np.allclose([v for _, v in line], want, atol=1e-9)


def test_level_of_a_tone_and_of_silence(spark):
    p = Params()
    tracks = {(0, 0): tone(0.5), (0, 1): [0.0] * 8000}
    got = per_track(frame_levels(pane_energy(as_samples(spark, tracks), p), TRACK_KEYS,
                                 {"energy": "rms_db"}, p), "rms_db")
    loud = [v for _, v in got[(0, 0)]]
    assert len(loud) == 48 and abs(np.mean(loud) + 3.0121) < 1e-3
    assert {round(v, 9) for _, v in got[(0, 1)]} == {-200.0}


@pytest.mark.parametrize("kernel", [1, 2, 5, 15, 100])
def test_smoothing_equals_the_recurrence(spark, kernel):
    levels = list(np.random.default_rng(4).uniform(-60, 0, 1500))
    df = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(levels)],
                               "session_id long, track int, frame long, rms_db double")
    got = per_track(smooth(df, TRACK_KEYS, {"rms_db": "envelope_db"}, kernel), "envelope_db")
    assert np.allclose([v for _, v in got[(0, 0)]], ema(levels, kernel), atol=1e-10)


def test_smoothing_of_a_step_lags(spark):
    levels = [-40.0] * 50 + [-10.0] * 50
    df = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(levels)],
                               "session_id long, track int, frame long, rms_db double")
    got = [v for _, v in per_track(smooth(df, TRACK_KEYS, {"rms_db": "e"}, 10), "e")[(0, 0)]]
    assert got[0] == -40.0 and -40 < got[52] < -10 and abs(got[-1] + 10) < 0.1


def spans(p, pattern, total_s, spark):
    x = bursts(pattern, total_s)
    frames = frame_table(pane_energy(as_samples(spark, {(0, 0): x}), p), TRACK_KEYS,
                         {"energy": ""}, p)
    line = per_track(activity_flags(frames, TRACK_KEYS, [""], p), "is_active")[(0, 0)]
    on = [f for f, a in line if a]
    edges = [(a, b) for a, b in zip([None, *on], [*on, None]) if a is None or b is None or b != a + 1]
    starts = [b for _, b in edges if b is not None]
    ends = [a + 1 for a, _ in edges if a is not None]
    return len(line), list(zip(starts, ends))


@pytest.mark.parametrize("pattern, total, frames, active", [
    ([(0.5, 4.5, -10)], 5, 498, [(66, 498)]),
    ([(0.5, 1.5, -10), (1.9, 2.9, -10)], 4, 398, [(66, 351)]),
    ([(0.5, 1.5, -10), (3, 4, -10)], 5, 498, [(66, 211), (316, 461)]),
    ([(0.5, 4.5, -50)], 5, 498, []),
])
def test_pauses_are_bridged_or_not(spark, pattern, total, frames, active):
    assert spans(Params(), pattern, total, spark) == (frames, active)


@pytest.mark.parametrize("kernel_ms, hangover_ms", [(10, 10), (10, 70), (20, 30), (30, 20)])
@pytest.mark.parametrize("sliced", [False, True])
def test_flags_equal_the_state_machine(spark, kernel_ms, hangover_ms, sliced):
    p = Params(sample_rate=100, smoothing_ms=kernel_ms, hangover_ms=hangover_ms)
    tracks = noisy_sessions(kernel_ms + hangover_ms, {
        (0, 0): 1500, (0, 1): 800, (1, 0): 2, (1, 1): 300, (2, 0): 3})
    block = frame_block(p, 4) if sliced else None
    panes = pane_energy(as_samples(spark, tracks), p)
    frames = frame_table(panes, TRACK_KEYS, {"energy": ""}, p, block)
    got = per_track(own_frames(activity_flags(frames, TRACK_KEYS, [""], p, block), block),
                    "is_active", "envelope_db", "time_s")
    for key, x in tracks.items():
        envelope = ema(rms_db(x, p.grid.window, p.grid.hop), p.grid.kernel)
        want = flags(envelope, p.speech_threshold_db, p.release_threshold_db, p.grid.hangover)
        line = got.get(key, [])
        assert [a for _, a, _, _ in line] == want
        assert np.allclose([e for _, _, e, _ in line], envelope, atol=1e-9)
        assert [t for *_, t in line] == [i * p.grid.hop_s for i in range(len(want))]


@pytest.mark.parametrize("block", [None, 12])
@pytest.mark.parametrize("up, down", [(-28.0, -33.0), (-33.0, -28.0), (-30.0, -30.0)])
def test_flags_of_many_random_envelopes(spark, block, up, down):
    """The release threshold may lie below, at or above the speech threshold."""
    p = Params(sample_rate=100, smoothing_ms=10, hangover_ms=30, speech_threshold_db=up,
               release_threshold_db=down)
    rnd = np.random.default_rng(8)
    # on, between, at and around both thresholds
    levels = [-60.0, -34.0, -33.0, -32.5, -30.0, -28.0, -27.9, -10.0]
    lines = {i: [levels[k] for k in rnd.integers(0, len(levels), rnd.integers(1, 70))]
             for i in range(400)}
    rows = [(i, 0, f, v) for i, line in lines.items() for f, v in enumerate(line)]
    df = spark.createDataFrame(rows, "session_id long, track int, frame long, envelope_db double")
    if block is not None:
        # copies of the frames that a slice needs before its own first one
        lead = p.grid.hangover + 1
        df = (df.withColumn("slice", F.expr(f"frame div {block}"))
              .unionByName(df.where(f"frame % {block} >= {block - lead}")
                           .withColumn("slice", F.expr(f"frame div {block} + 1"))))
    got = per_track(activity_flags(df, TRACK_KEYS, [""], p, block), "is_active")
    for i, line in lines.items():
        assert [a for _, a in got[(i, 0)]] == flags(line, up, down, p.grid.hangover)


@pytest.mark.parametrize("sliced", [False, True])
def test_crossed_thresholds_from_samples(spark, sliced):
    p = Params(sample_rate=100, smoothing_ms=20, hangover_ms=30, speech_threshold_db=-40.0,
               release_threshold_db=-20.0)
    tracks = noisy_sessions(5, {(0, 0): 1500, (0, 1): 800, (1, 0): 2, (2, 0): 3})
    block = frame_block(p, 4) if sliced else None
    frames = frame_table(pane_energy(as_samples(spark, tracks), p), TRACK_KEYS, {"energy": ""},
                         p, block)
    got = per_track(activity_flags(frames, TRACK_KEYS, [""], p, block), "is_active")
    for key, x in tracks.items():
        envelope = ema(rms_db(x, p.grid.window, p.grid.hop), p.grid.kernel)
        want = flags(envelope, -40.0, -20.0, p.grid.hangover)
        assert [a for _, a in got.get(key, [])] == want
    assert {a for line in got.values() for _, a in line} == {True, False}


def test_equality_with_a_threshold_switches_nothing(spark):
    p = Params(sample_rate=100, smoothing_ms=10, hangover_ms=10)
    levels = [-28.0, -27.9, -33.0, -33.0, -33.0, -33.1, -33.0, -33.0, -28.0]
    df = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(levels)],
                               "session_id long, track int, frame long, envelope_db double")
    line = per_track(activity_flags(df, TRACK_KEYS, [""], p), "is_active")[(0, 0)]
    assert [a for _, a in line] == [False, True, True, True, True, True, True, False, False]


def test_a_slice_holds_its_run_in():
    p = Params()
    assert p.grid.span == 432 and p.grid.run_in == 864
    assert frame_block(p, 100) == 864 and frame_block(p, 900) == 1296
    assert frame_block(p, None) is None


def test_combining_stops_at_the_shorter_track(spark):
    rows = [(0, 0, f, a) for f, a in enumerate([True, True, False, False, True])]
    rows += [(0, 1, f, a) for f, a in enumerate([True, False, True, False])]
    rows += [(1, 0, 0, True)]
    df = spark.createDataFrame(rows, "session_id long, track int, frame long, is_active boolean")
    got = sorted(tuple(r) for r in combine_tracks(df).collect())
    assert got == [(0, 0, "both"), (0, 1, "speaker_a"), (0, 2, "speaker_b"), (0, 3, "silence")]
