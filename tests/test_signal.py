import numpy as np
import pytest
from fixtures import as_samples, noisy_sessions
from pyspark.sql import functions as F

from activity_timeline.operators import signal
from activity_timeline.sources.tables import samples_from, samples_from_arrays

SIZES = {(0, 0): 441, (0, 1): 30, (1, 0): 1, (2, 1): 97}


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.track, r.idx)):
        out.setdefault((r.session_id, r.track), []).append((r.idx, r.x))
    return out


@pytest.mark.parametrize("block", [None, 10, 64])
@pytest.mark.parametrize("rates", [(44100, 16000), (16000, 44100), (8, 7), (100, 100)])
def test_resample_equals_interpolation_on_two_grids(spark, rates, block):
    source, target = rates
    tracks = noisy_sessions(5, SIZES)
    got = collected(signal.resample(as_samples(spark, tracks), source, target, block))
    for key, x in tracks.items():
        seconds = len(x) / source
        size = int(seconds * target)
        want = x if source == target else np.interp(
            np.linspace(0, seconds, size, endpoint=False),
            np.linspace(0, seconds, len(x), endpoint=False), x)
        line = got.get(key, [])
        assert [i for i, _ in line] == list(range(len(want)))
        assert np.allclose([v for _, v in line], want, atol=1e-12)


@pytest.mark.parametrize("chunk", [4, 1000])
def test_pad_fills_short_and_missing_tracks(spark, chunk):
    tracks = noisy_sessions(6, SIZES)
    named = spark.createDataFrame([(s, t) for s in (0, 1, 2, 9) for t in (0, 1)],
                                  "session_id long, track int")
    got = collected(signal.align_pad(as_samples(spark, tracks), named, chunk))
    longest = {0: 441, 1: 1, 2: 97}
    assert set(got) == {(s, t) for s in longest for t in (0, 1)}
    for (s, t), line in got.items():
        x = tracks.get((s, t), [])
        assert [i for i, _ in line] == list(range(longest[s]))
        assert [v for _, v in line] == x + [0.0] * (longest[s] - len(x))


def test_pad_without_a_track_list_keeps_to_tracks_that_exist(spark):
    got = collected(signal.align_pad(as_samples(spark, noisy_sessions(6, SIZES))))
    assert set(got) == set(SIZES) and len(got[(0, 1)]) == 441


def test_duration_is_that_of_the_longest_track(spark):
    got = signal.session_duration(as_samples(spark, noisy_sessions(6, SIZES)), 100)
    assert {r.session_id: r.total_duration_s for r in got.collect()} == {0: 4.41, 1: 0.01, 2: 0.97}


def test_mono_is_the_mean_over_channels(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([-1.0],)], "c array<double>")
    assert [r[0] for r in df.select(signal.mono(F.col("c"))).collect()] == [3.0, -1.0]


@pytest.mark.parametrize("block, size", [(None, None), (2, None), (None, 3)])
def test_array_chunks_follow_one_another(spark, block, size):
    rows = [(0, 0, 0, [1.0, 2.0, 3.0]), (0, 0, 1, [4.0, 5.0, 6.0]), (0, 0, 2, [7.0]),
            (0, 1, 0, [8.0]), (0, 0, 3, [])]
    df = spark.createDataFrame(rows, "s long, t int, c long, v array<double>")
    got = collected(samples_from_arrays(df, F.col("s"), F.col("t"), F.col("c"), F.col("v"),
                                        block, size))
    assert got == {(0, 0): list(enumerate([1.0, 2, 3, 4, 5, 6, 7])), (0, 1): [(0, 8.0)]}


@pytest.mark.parametrize("block", [None, 3])
def test_samples_are_numbered_in_their_order(spark, block):
    rows = [(1, i % 2, 50 - i, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "s long, t int, at long, v double")
    got = collected(samples_from(df, F.col("s"), F.col("t"), ["at"], F.col("v"), block))
    assert got[(1, 0)] == list(enumerate(float(v) for v in range(48, -1, -2)))
    assert got[(1, 1)] == list(enumerate(float(v) for v in range(49, 0, -2)))
