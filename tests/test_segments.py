import random

import pytest
from brute import absorb, clean, merge, runs, session_segments
from fixtures import as_samples, as_segments, bursts, listed, noisy_sessions

from activity_timeline import Params
from activity_timeline.operators import segments
from activity_timeline.plans import analyze as chain

A, B, S, X = "speaker_a", "speaker_b", "silence", "both"
P = Params()


def states_of(spark, lists):
    rows = [(s, f, state) for s, items in lists.items() for f, state in enumerate(items)]
    return spark.createDataFrame(rows, "session_id long, frame long, speaker_state string")


@pytest.mark.parametrize("block", [None, 2])
@pytest.mark.parametrize("source, min_s, want", [
    ([(0, 1, A), (1, 1.1, B), (1.1, 3, A)], 0.3, [(0, 1.1, A), (1.1, 3, A)]),
    ([(0, 3, A), (3, 3.5, B), (3.5, 6, A)], 2.0, [(0, 3.5, A), (3.5, 6, A)]),
    ([(0, 0.1, A), (0.1, 3, B)], 2.0, [(0, 0.1, A), (0.1, 3, B)]),
    ([(0, 0.1, A)], 2.0, [(0, 0.1, A)]),
    ([(0, 0.1, A), (0.1, 0.2, B), (0.2, 0.3, S)], 2.0, [(0, 0.3, A)]),
    ([(0, 2, A), (5, 5.5, B), (9, 12, A)], 2.0, [(0, 5.5, A), (9, 12, A)]),
])
def test_short_segments_join_the_one_before(spark, source, min_s, want, block):
    assert listed(segments.absorb_short(as_segments(spark, {1: source}), min_s, block)) == {1: want}


@pytest.mark.parametrize("block", [None, 2])
def test_equal_neighbours_merge(spark, block):
    source = {1: [(0, 1, A), (1, 2, A), (2, 3, B)], 2: [(0, 1, A)], 3: [(0, 1, S)] * 0}
    assert listed(segments.merge_adjacent(as_segments(spark, source), block)) == {
        1: [(0, 2, A), (2, 3, B)], 2: [(0, 1, A)]}


def test_merged_segments_keep_the_first_attributes(spark):
    rows = [(1, 0, 0.0, 1.0, 4, A, "first"), (1, 1, 1.0, 2.0, 5, A, "second")]
    df = spark.createDataFrame(rows, segments.SEGMENTS)
    assert [tuple(r) for r in segments.merge_adjacent(df).collect()] == [
        (1, 0, 0.0, 2.0, 4, A, "first")]


def test_order_of_the_steps_matters(spark):
    source = [(0, 5, X), (5, 6.5, A), (6.5, 6.6, B), (6.6, 8.1, A)]
    assert listed(segments.clean_segments(as_segments(spark, {1: source}), P)) == {1: [(0, 8.1, X)]}


def test_a_brief_interruption_vanishes(spark):
    p = Params(debounce_ms=100, min_segment_ms=500)
    states = states_of(spark, {1: [A] * 300 + [B] * 5 + [A] * 300})
    assert listed(segments.segment_states(states, p)) == {1: [(0, 6.05, A)]}


def test_durations_at_the_limit_are_judged_as_doubles(spark):
    # 30 frames are sometimes a little less than 0.3 s, depending on where they start
    rnd = random.Random(5)
    lists = {s: [x for _ in range(40) for x in [rnd.choice([A, B, S, X])] * rnd.choice(
        [29, 30, 30, 30, 31, 200])] for s in range(30)}
    p = Params(debounce_ms=300, min_segment_ms=2000)
    want = {s: clean(runs(v, p.grid.hop_s), p) for s, v in lists.items()}
    assert listed(segments.segment_states(states_of(spark, lists), p)) == want
    debounced = segments.absorb_short(segments.run_lengths(states_of(spark, lists), p.grid.hop_s), 0.3)
    assert listed(debounced) == {s: absorb(runs(v, p.grid.hop_s), 0.3) for s, v in lists.items()}


def test_runs_and_empty_input(spark):
    states = states_of(spark, {1: [A] * 50 + [B] * 50 + [S] * 50, 2: [A] * 100})
    assert listed(segments.run_lengths(states, 0.01)) == {
        1: [(0, 0.5, A), (0.5, 1.0, B), (1.0, 1.5, S)], 2: [(0, 1.0, A)]}
    assert segments.segment_states(states.limit(0), P).count() == 0


@pytest.mark.parametrize("block", [None, 3, 16])
def test_random_states_equal_the_folds(spark, block):
    rnd = random.Random(11)
    p = Params(debounce_ms=20, min_segment_ms=40)
    lists = {}
    for s, size in ((0, 900), (1, 1), (2, 64), (3, 200)):
        line = []
        while len(line) < size:
            line += [rnd.choice([A, B, S, X])] * rnd.choice([1, 1, 2, 3, 5, 30])
        lists[s] = line[:size]
    states = states_of(spark, lists)
    found = segments.run_lengths(states, p.grid.hop_s, block)
    assert listed(found) == {s: runs(v, p.grid.hop_s) for s, v in lists.items()}
    assert listed(segments.segment_states(states, p, block, limit=0)) == {
        s: clean(runs(v, p.grid.hop_s), p) for s, v in lists.items()}
    once = segments.absorb_short(found, p.grid.debounce_s, block)
    assert listed(once) == {s: absorb(runs(v, p.grid.hop_s), p.grid.debounce_s) for s, v in lists.items()}
    assert listed(segments.merge_adjacent(once, block)) == {
        s: merge(absorb(runs(v, p.grid.hop_s), p.grid.debounce_s)) for s, v in lists.items()}


@pytest.mark.parametrize("block", [1, 2, 5, 40, 1000])
@pytest.mark.parametrize("debounce_ms, min_segment_ms", [(20, 40), (50, 0), (0, 70), (300, 3000)])
def test_one_pass_over_slices_equals_the_folds(spark, block, debounce_ms, min_segment_ms):
    """Tails that the next slices decide, slices whose cuts all go, sessions of one cut."""
    rnd = random.Random(block + debounce_ms)
    p = Params(debounce_ms=debounce_ms, min_segment_ms=min_segment_ms)
    lists = {s: [x for _ in range(cuts) for x in [rnd.choice([A, B, S])] * rnd.choice(longs)]
             for s, (cuts, longs) in enumerate([
                 (150, [1, 1, 2, 3, 5]), (60, [4, 5, 6, 60]), (1, [3]), (2, [1]),
                 (90, [1]), (40, [1, 90])])}
    source = {s: runs(v, p.grid.hop_s) for s, v in lists.items()}
    got = segments.clean_segments(as_segments(spark, source), p, block)
    assert listed(got) == {s: clean(v, p) for s, v in source.items()}
    numbers = {}
    for r in got.orderBy("session_id", "start_s").collect():
        numbers.setdefault(r.session_id, []).append(r.seg_idx)
    assert all(n == list(range(len(n))) for n in numbers.values())


@pytest.mark.parametrize("block", [None, 2])
def test_numbers_are_dense(spark, block):
    source = {1: [(i, i + 1, A) for i in range(7)], 2: [(0, 1, B)]}
    got = segments.number_segments(as_segments(spark, source), block)
    assert sorted((r.session_id, r.start_s, r.seg_idx) for r in got.collect()) == [
        *[(1, float(i), i) for i in range(7)], (2, 0.0, 0)]


@pytest.mark.parametrize("params, want", [
    (Params(debounce_ms=100, min_segment_ms=500),
     [(0, 1.16, S), (1.16, 4.61, A), (4.61, 5.16, S), (5.16, 9.98, B)]),
    (Params(), [(0, 1.16, S), (1.16, 5.16, A), (5.16, 9.98, B)])])
def test_two_speakers_in_turn(spark, params, want):
    tracks = {(7, 0): bursts([(1, 4, -10)], 10), (7, 1): bursts([(5, 9, -10)], 10)}
    got = listed(chain.segments(as_samples(spark, tracks), params))[7]
    assert [(round(a, 9), round(b, 9), s) for a, b, s in got] == want


def test_two_speakers_at_once(spark):
    x = bursts([(0.5, 4, -10)], 5)
    got = listed(chain.segments(as_samples(spark, {(7, 0): x, (7, 1): x}),
                                Params(debounce_ms=100, min_segment_ms=500)))[7]
    assert [(round(a, 9), round(b, 9), s) for a, b, s in got] == [(0, 0.66, S), (0.66, 4.98, X)]


@pytest.mark.parametrize("rate, window, hop", [(100, 30, 10), (1000, 30, 10), (1000, 30, 20)])
@pytest.mark.parametrize("block, limit", [(None, 1), (1, 1_000_000), (1, 0)])
def test_the_chain_equals_the_definitions_with_a_hot_session(spark, rate, window, hop, block,
                                                             limit):
    p = Params(sample_rate=rate, window_ms=window, hop_ms=hop, smoothing_ms=2 * hop,
               hangover_ms=3 * hop, debounce_ms=2 * hop, min_segment_ms=4 * hop)
    step = p.grid.hop
    tracks = noisy_sessions(rate + hop, {
        (0, 0): 900 * step, (0, 1): 850 * step + 1, (1, 0): 120 * step, (2, 1): 90 * step,
        (3, 0): 2, (4, 0): 200 * step, (4, 1): 3 * step, (5, 0): 130 * step, (5, 1): 230 * step})
    got = listed(chain.segments(as_samples(spark, tracks), p, block, limit))
    want = {}
    for s in range(6):
        found = session_segments(tracks.get((s, 0), []), tracks.get((s, 1), []), p)
        if found:
            want[s] = found
    assert got == want
    for line in got.values():
        assert line[0][0] == 0
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(line, line[1:]))
