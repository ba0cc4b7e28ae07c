import json
import random

import pytest
from fixtures import as_samples, bursts, noisy_sessions
from pyspark.sql import functions as F

from activity_timeline import Params, analyze, preview
from activity_timeline.operators import rules, timelines
from activity_timeline.operators.segments import number_segments
from activity_timeline.schemas import SEGMENTS, TRACKS
from activity_timeline.sources import documents

A, B, S, X = "speaker_a", "speaker_b", "silence", "both"
P = Params(default_camera=0, both_speaking_camera=3)
DUCK = Params(ducking_enabled=True)


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([(1, 0, "host", 1, "/a.wav"), (1, 1, "guest", 2, "/b.wav"),
                                  (2, 0, "solo", 7, None)], TRACKS)


def numbered(spark, lists):
    rows = [(s, i * 2, float(i), float(i + 1), 0, state, None)
            for s, states in lists.items() for i, state in enumerate(states)]
    return number_segments(spark.createDataFrame(rows, SEGMENTS))


def durations(spark, seconds):
    return spark.createDataFrame(list(seconds.items()), "session_id long, total_duration_s double")


def test_cameras_and_labels_follow_the_state(spark, tracks):
    df = numbered(spark, {s: [A, B, X, S] for s in (1, 2, 3)})
    got = {(r.session_id, r.speaker_state): (r.camera_index, r.speaker_label)
           for r in rules.assign_cameras(df, tracks, P).collect()}
    rest = {X: (3, None), S: (0, None)}
    want = {1: {A: (1, "host"), B: (2, "guest"), **rest},
            2: {A: (7, "solo"), B: (2, "speaker_b"), **rest},
            3: {A: (1, "speaker_a"), B: (2, "speaker_b"), **rest}}
    assert got == {(s, k): v for s, d in want.items() for k, v in d.items()}
    plain = rules.assign_cameras(df, None, P).where("session_id = 1").collect()
    assert {(r.speaker_state, r.camera_index, r.speaker_label) for r in plain} == {
        (k, *v) for k, v in want[3].items()}


@pytest.mark.parametrize("state, levels", [(A, (0.0, -12.0)), (B, (-12.0, 0.0)),
                                           (X, (0.0, 0.0)), (S, (0.0, 0.0))])
def test_the_silent_track_is_lowered(spark, state, levels):
    got = rules.gain_events(numbered(spark, {1: [state]}), DUCK).collect()
    assert [(r.time_s, r.target_db, r.track_index) for r in got] == [
        (0.0, levels[0], 0), (0.0, levels[1], 1)]


def test_no_gain_events_when_ducking_is_off(spark):
    assert rules.gain_events(numbered(spark, {1: [A]}), Params()).count() == 0


def listed(relation):
    return sorted(tuple(r) for r in relation.select(sorted(relation.columns)).collect())


def same(a, b):
    return all(listed(x) == listed(y) for x, y in zip(a, b))


def document_texts(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.session_id, r.section, r.place)):
        out.setdefault(r.session_id, []).append(r.text)
    return {s: "\n".join(texts) for s, texts in out.items()}


def test_timelines_hold_every_segment_once(spark):
    states = {1: [random.Random(2).choice([A, B, S]) for _ in range(11)], 2: [A], 3: [A] * 4}
    made = timelines.assemble(numbered(spark, states), durations(spark, {1: 11.5, 2: 1.0, 3: 4.0,
                                                                         9: 0.5}), DUCK, 25.0)
    assert {tuple(r) for r in made.heads.collect()} == {
        (1, 11.5, 25.0), (2, 1.0, 25.0), (3, 4.0, 25.0), (9, 0.5, 25.0)}
    places = sorted((r.session_id, r.place) for r in made.events.collect())
    assert places == sorted((s, i) for s, line in states.items() for i in range(2 * len(line)))
    flat = timelines.timeline_segments(made).collect()
    assert {(r.session_id, r.seg_idx, r.speaker_state) for r in flat} == {
        (s, i, v) for s, line in states.items() for i, v in enumerate(line)}


def test_document_text_and_back(spark, tracks):
    placed = rules.assign_cameras(numbered(spark, {1: [A, S]}), tracks, DUCK)
    made = timelines.assemble(placed, durations(spark, {1: 2.5}), DUCK)
    text = timelines.to_document(made)
    document = json.loads(document_texts(text)[1])
    assert list(document) == ["total_duration_s", "fps", "segments", "ducking_events"]
    assert document["fps"] == 29.97
    assert document["segments"] == [
        {"start_s": 0.0, "end_s": 1.0, "camera_index": 1, "speaker_state": A,
         "speaker_label": "host"},
        {"start_s": 1.0, "end_s": 2.0, "camera_index": 0, "speaker_state": S,
         "speaker_label": None}]
    assert document["ducking_events"][1] == {"time_s": 0.0, "target_db": -12.0, "track_index": 1}
    assert same(timelines.from_document(text), made)


def test_a_session_of_any_length_is_one_document(spark, tmp_path):
    rows = spark.range(25_000).select(
        (F.col("id") % 5 > 0).cast("bigint").alias("session_id"), "id")
    segs = rows.select(
        "session_id", F.col("id").alias("pos"), F.col("id").cast("double").alias("start_s"),
        (F.col("id") + 1.0).alias("end_s"), F.lit(0).alias("camera_index"),
        F.when(F.col("id") % 2 == 0, A).otherwise(S).alias("speaker_state"),
        F.lit(None).cast("string").alias("speaker_label"))
    made = timelines.assemble(number_segments(segs), durations(spark, {0: 1.0, 1: 2.0, 2: 0.0}), DUCK)
    path = str(tmp_path / "out")
    documents.write_document_files(timelines.to_document(made), path)
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out").rglob("*.txt")}
    assert {s: (len(d["segments"]), len(d["ducking_events"])) for s, d in found.items()} == {
        "session_id=0": (5_000, 10_000), "session_id=1": (20_000, 40_000), "session_id=2": (0, 0)}
    starts = [s["start_s"] for s in found["session_id=1"]["segments"]]
    assert starts == sorted(starts)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"session_id=(\d+)", 1)
    assert same(documents.read_timeline_files(spark, path, number), made)


def test_files_of_many_sessions_are_dealt_over_folders(spark, tmp_path):
    """Neither writing nor listing is left to one task."""
    made = timelines.assemble(numbered(spark, {n: [A, S] for n in range(400)}),
                              durations(spark, {n: 2.0 for n in range(400)}), DUCK)
    path = str(tmp_path / "out")
    documents.write_document_files(timelines.to_document(made).coalesce(1), path)
    files = list((tmp_path / "out").rglob("*.txt"))
    assert {p.parent.name for p in files} == {f"session_id={n}" for n in range(400)}
    assert len(files) == 400 and len({p.parent.parent for p in files}) > 32
    assert all(p.parent.parent.parent == tmp_path / "out" for p in files)
    assert (tmp_path / "out" / "_SUCCESS").exists()
    number = F.regexp_extract(F.col("_metadata.file_path"), r"session_id=(\d+)", 1)
    assert same(documents.read_timeline_files(spark, path, number), made)
    with pytest.raises(Exception, match="exists"):
        documents.write_document_files(timelines.to_document(made), path)


def read(spark, document):
    text = spark.createDataFrame([(5, json.dumps(document))], "session_id long, json string")
    return [relation.collect() for relation in timelines.from_whole_documents(text)]


SEGMENT = {"start_s": 0, "end_s": 2.5, "camera_index": 1, "speaker_state": A}


def test_missing_values_get_their_defaults(spark):
    heads, segments, events = read(spark, {"total_duration_s": 3.0, "segments": [SEGMENT]})
    assert [tuple(r) for r in heads] == [(5, 3.0, 29.97)] and events == []
    assert [tuple(r) for r in segments] == [(5, 0, 0.0, 2.5, 1, A, None)]


@pytest.mark.parametrize("document", [
    {"segments": []}, {"total_duration_s": 1.0},
    {"total_duration_s": 1.0, "segments": [{**SEGMENT, "speaker_state": "shouting"}]},
    {"total_duration_s": 1.0, "segments": [{k: v for k, v in SEGMENT.items() if k != "end_s"}]},
    {"total_duration_s": 1.0, "segments": [{k: v for k, v in SEGMENT.items()
                                            if k != "speaker_state"}]},
    {"total_duration_s": 1.0, "segments": [], "ducking_events": [{"time_s": 1.0}]},
])
def test_incomplete_documents_fail(spark, document):
    with pytest.raises(Exception):
        read(spark, document)


def test_indented_files_are_read(spark, tmp_path):
    for number, label in ((12, "Zoë"), (13, None)):
        (tmp_path / f"session-{number}.json").write_text(json.dumps(
            {"total_duration_s": 2.5, "segments": [{**SEGMENT, "speaker_label": label}]},
            indent=2, ensure_ascii=False))
    got = timelines.timeline_segments(documents.read_timeline_files(spark, str(tmp_path))).collect()
    assert {(r.session_id, r.speaker_label, r.fps) for r in got} == {
        (12, "Zoë", 29.97), (13, None, 29.97)}


@pytest.mark.parametrize("files, message", [
    ({"1.json": 2}, "(?i)malformed|root"), ({"a1.json": 1, "b1.json": 1}, "two documents of one session"),
    ({"take.json": 1}, "no session number")])
def test_files_that_are_not_one_document_of_one_session_fail(spark, tmp_path, files, message):
    for name, roots in files.items():
        (tmp_path / name).write_text(
            json.dumps({"total_duration_s": 2.5, "segments": [SEGMENT]}, indent=2) * roots)
    with pytest.raises(Exception, match=message):
        documents.read_timeline_files(spark, str(tmp_path)).heads.collect()


def test_written_timelines_are_read_back(spark, tmp_path):
    made = timelines.assemble(numbered(spark, {1: [A, B] * 5, 2: [S]}),
                              durations(spark, {1: 10.0, 2: 1.0}), DUCK)
    path = str(tmp_path / "out")
    documents.write_timelines(made, path)
    line = json.loads(next((tmp_path / "out" / "segments").rglob("*.json")).read_text().splitlines()[0])
    assert line["speaker_label"] is None and line["seg_idx"] == 0
    assert same(documents.read_timelines(spark, path), made)


def test_preview_lines(spark):
    rows = [(1, 0, 0.0, 7.5, 1, A, "host"), (1, 1, 7.5, 10.0, 0, S, None),
            (1, 2, 10.0, 10.001, 2, B, "")]
    made = timelines.assemble(number_segments(spark.createDataFrame(rows, SEGMENTS)),
                              durations(spark, {1: 10.0}), DUCK)
    summary, report = preview(made)
    assert tuple(summary.first()) == (
        1, 10.0, 29.97, 3, 6, "Duration: 10.0s | FPS: 29.97 | Segments: 3", "Ducking events: 6")
    assert [r.line for r in report.orderBy("number").collect()] == [
        "    1     0.00s -    7.50s  [cam1]  host          " + "#" * 37,
        "    2     7.50s -   10.00s  [cam0]  silence       " + "#" * 12,
        "    3    10.00s -   10.00s  [cam2]  speaker_b     #"]


def test_a_report_without_duration_has_bars_of_one(spark):
    made = timelines.assemble(numbered(spark, {1: [A]}), durations(spark, {1: 0.0}), DUCK)
    assert preview(made)[1].first().bar == "#"


@pytest.mark.parametrize("block", [None, 1])
def test_analyze_from_samples_to_timelines(spark, tracks, block):
    samples = as_samples(spark, {(1, 0): bursts([(1, 4, -10)], 10),
                                 (1, 1): bursts([(5, 9, -10)], 9.5), (2, 0): [0.1] * 10})
    made = analyze(samples, tracks, DUCK, 25.0, block)
    assert {tuple(r) for r in made.heads.collect()} == {(1, 10.0, 25.0), (2, 10 / 16000, 25.0)}
    assert [(s.session_id, s.speaker_state, s.camera_index, s.speaker_label)
            for s in made.segments.orderBy("session_id", "seg_idx").collect()] == [
        (1, S, 0, None), (1, A, 1, "host"), (1, B, 2, "guest")]
    assert made.events.count() == 6


@pytest.mark.parametrize("rate, window, hop", [(100, 30, 10), (1000, 30, 10), (1000, 50, 20)])
@pytest.mark.parametrize("block", [None, 1])
@pytest.mark.parametrize("stored", [False, True])
def test_durations_from_panes_equal_counted_samples(spark, tmp_path, rate, window, hop, block,
                                                    stored):
    """Also for sessions with one track, and for those too short for a frame."""
    p = Params(sample_rate=rate, window_ms=window, hop_ms=hop, smoothing_ms=2 * hop)
    sizes = {(0, 0): 1203, (0, 1): 1100, (1, 1): 431, (2, 0): 1, (3, 0): 5, (3, 1): 9}
    samples = as_samples(spark, noisy_sessions(rate, sizes))
    store = f"{tmp_path}/panes" if stored else None
    made = analyze(samples, None, p, block=block, store=store)
    assert {(h.session_id, h.total_duration_s) for h in made.heads.collect()} == {
        (s, max(n for (t, _), n in sizes.items() if t == s) / rate) for s in range(4)}
    plain = analyze(samples, None, p, block=block)
    assert sorted(map(tuple, made.segments.collect())) == sorted(map(tuple, plain.segments.collect()))


def test_tracks_other_than_two_are_refused(spark):
    samples = as_samples(spark, {(1, 0): [0.1] * 800, (1, 2): [0.1] * 800})
    with pytest.raises(Exception, match="other than 0 and 1"):
        analyze(samples, None, DUCK, block=None).segments.collect()


def test_samples_at_their_own_rates_are_refused(spark):
    samples = as_samples(spark, {(1, 0): [0.1] * 800}).withColumn("sample_rate", F.lit(8000))
    with pytest.raises(ValueError, match="ingest"):
        analyze(samples, None, DUCK)


def test_long_session_goes_by_pieces(spark, sf_dir, monkeypatch):
    """No task writes or reads the whole document of the long session."""
    import catalog
    from activity_timeline.sources import documents

    def refuse(*_):
        raise AssertionError("one file for the whole session")

    monkeypatch.setattr(documents, "write_document_files", refuse)
    monkeypatch.setattr(documents, "read_timeline_files", refuse)
    assert catalog.long_session_json(spark, sf_dir).count() > 0
