import pytest

from activity_timeline import Params, build_params
from activity_timeline.operators.frames import ordered_rows


def test_defaults_and_derived_sizes():
    p = Params()
    assert (p.grid.window, p.grid.hop, p.grid.kernel, p.grid.hangover) == (480, 160, 15, 60)
    assert (p.grid.hop_s, p.grid.debounce_s, p.grid.min_segment_s) == (0.01, 0.3, 2.0)


def test_sizes_never_fall_below_one():
    p = Params(smoothing_ms=1.0, hangover_ms=1.0)
    assert (p.grid.kernel, p.grid.hangover) == (1, 1)


def test_build_ignores_none_and_unknown():
    p = build_params(camera_wide=4, debounce_ms=None, colour="red", ducking_enabled=True)
    assert (p.default_camera, p.both_speaking_camera, p.debounce_ms) == (4, 4, 300.0)
    assert p.ducking_enabled


@pytest.mark.parametrize("bad", [dict(hop_ms=0.0), dict(window_ms=0.01), dict(default_camera=-1),
                                 dict(both_speaking_camera=-1)])
def test_impossible_settings_are_refused(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_the_slicing_limit_is_in_rows_that_are_put_in_order():
    assert ordered_rows(Params()) == 160          # panes of 160 samples
    assert ordered_rows(Params(sample_rate=22050)) == 110  # 661 and 220: panes of 1 and 219
    assert ordered_rows(Params(sample_rate=100)) == 1      # 3 and 1: samples by themselves


@pytest.mark.parametrize("window, hop, panes", [(480, 160, (0, 1, 3)), (661, 220, (1, 2, 7)),
                                                (30, 20, (10, 2, 3)), (4, 6, (4, 2, 1))])
def test_a_hop_is_two_panes_at_most(window, hop, panes):
    grid = Params(sample_rate=1000, window_ms=window, hop_ms=hop).grid
    assert (grid.part, grid.panes_per_hop, grid.panes_per_window) == panes
