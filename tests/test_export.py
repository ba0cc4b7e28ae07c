import io
import xml.etree.ElementTree as ET
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from activity_timeline import Params, export
from activity_timeline.functions import numbers, paths
from activity_timeline.operators import clips, timelines
from activity_timeline.operators.segments import number_segments
from activity_timeline.operators.slices import BLOCK
from activity_timeline.schemas import CAMERAS, SEGMENTS, TRACKS

A, B, S, X = "speaker_a", "speaker_b", "silence", "both"
DUCK = Params(ducking_enabled=True)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("seconds, fps, frame", [
    (1.0, 30.0, 30), (0.5, 29.97, 15), (0.0, 29.97, 0), (0.5, 25.0, 12), (1.5, 1.0, 2),
    (2.5, 1.0, 2), (3600.0, 23.976, 86314), (3600.0, 59.94, 215784)])
def test_frame_numbers_round_half_to_even(spark, seconds, fps, frame):
    assert one(spark, numbers.seconds_to_frames(F.lit(seconds), F.lit(fps))) == frame


@pytest.mark.parametrize("fps, base, ntsc, start", [
    (29.97, 30, "TRUE", 107892), (30.0, 30, "TRUE", 108000), (23.976, 24, "TRUE", 86314),
    (24.0, 24, "TRUE", 86400), (25.0, 25, "FALSE", 90000), (59.94, 60, "FALSE", 215784)])
def test_rate_classes(spark, fps, base, ntsc, start):
    rate = F.lit(fps)
    assert tuple(spark.range(1).select(numbers.timebase(rate), numbers.ntsc(rate),
                                       numbers.start_frame(rate)).first()) == (base, ntsc, start)


@pytest.mark.parametrize("path", [
    "/cam/wide.mp4", "/a b/~x*y/é+&=?#%/n.tar.gz", "/dir//sub/./file", "/end/", "/.hidden",
    "/a/name.", "/a/..b", "/日本/語.wav", "//host/a//b", "///a/b"])
def test_paths_equal_the_standard_library(spark, path):
    pure = PurePosixPath(path)
    col = F.lit(path)
    assert tuple(spark.range(1).select(paths.file_uri(col), paths.file_name(col)).first()) == (
        pure.as_uri(), pure.name)
    if pure.name != "..b" and pure.name != "name.":
        assert one(spark, paths.file_stem(col)) == pure.stem


def test_relative_paths_are_refused(spark):
    with pytest.raises(Exception, match="not an absolute path"):
        one(spark, paths.file_uri(F.lit("a/b.mp4")))


@pytest.fixture(scope="module")
def parts(spark):
    states = [A, B, X, A, S, B, A]
    rows = [(1, i, float(i) * 5, float(i + 1) * 5, {A: 1, B: 2}.get(v, 0), v, None)
            for i, v in enumerate(states)]
    rows += [(2, 0, 0.0, 1.0, 9, A, None)]
    segs = number_segments(spark.createDataFrame(rows, SEGMENTS))
    seconds = spark.createDataFrame([(1, 35.02), (2, 1.0), (3, 2.0)],
                                    "session_id long, total_duration_s double")

    def made(params=DUCK):
        return timelines.assemble(segs, seconds, params, 29.97)

    cameras = spark.createDataFrame(
        [(s, i, f"/cam/{n}.mp4") for s in (1, 2, 3)
         for i, n in enumerate(("wide & all", "host", "guest"))], CAMERAS)
    mics = spark.createDataFrame([(1, 0, "h", 1, "/mic/h<o>st.take.wav"),
                                  (1, 1, "g", 2, "/mic/guest.wav"),
                                  (2, 0, "h", 1, "/mic/x.wav"), (2, 1, "g", 2, None)], TRACKS)
    return made, cameras, mics


def texts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.section, r.place)):
        out.setdefault(r.session_id, []).append(r.text)
    return {s: "\n".join(lines) for s, lines in out.items()}


def test_documents_have_all_elements(parts):
    made, cameras, mics = parts
    found = texts(export(made(), cameras, mics, name="Cut & <paste>"))
    root = ET.fromstring(found[1].encode())
    assert root.tag == "xmeml" and root.get("version") == "5"
    seq = root.find("sequence")
    assert [e.tag for e in seq] == ["name", "duration", "rate", "timecode", "media"]
    assert seq.findtext("name") == "Cut & <paste>" and seq.findtext("duration") == "1050"
    assert (seq.findtext("rate/timebase"), seq.findtext("rate/ntsc")) == ("30", "TRUE")
    assert [e.text for e in seq.find("timecode")][1:] == ["01:00:00:00", "107892", "NDF"]
    shape = seq.find("media/video/format/samplecharacteristics")
    assert [e.text for e in shape][:3] == ["1920", "1080", "Square"]
    video = seq.findall("media/video/track/clipitem")
    assert [c.get("id") for c in video] == [f"clipitem-v{i}" for i in range(7)]
    assert video[0].findtext("name") == "Cam1 - speaker_a"
    assert [[c.findtext(t) for t in ("start", "end", "in", "out", "duration")]
            for c in video][1] == ["150", "300", "150", "300", "150"]
    assert [(c.find("file").get("id"), len(c.find("file")) > 0) for c in video] == [
        ("file-cam1", True), ("file-cam2", True), ("file-cam0", True), ("file-cam1", False),
        ("file-cam0", False), ("file-cam2", False), ("file-cam1", False)]
    wide = video[2].find("file")
    assert [e.tag for e in wide] == ["name", "pathurl", "rate", "duration", "media"]
    assert wide.findtext("name") == "wide & all.mp4"
    assert wide.findtext("pathurl") == "file:///cam/wide%20%26%20all.mp4"
    assert wide.findtext("duration") == wide.findtext("media/video/duration") == "1050"
    audio = seq.find("media/audio")
    assert [e.tag for e in audio] == ["format", "outputs", "track", "track"]
    assert [e.text for e in audio.find("format/samplecharacteristics")] == ["16", "48000"]
    group = audio.find("outputs/group")
    assert [group.findtext(t) for t in ("index", "numchannels", "downmix", "channel/index")] == [
        "1", "2", "0", "1"]
    clip = audio.find("track/clipitem")
    assert clip.get("id") == "clipitem-a0" and clip.findtext("name") == "h<o>st.take"
    assert clip.find("file").get("id") == "file-audio0"
    assert [clip.findtext(t) for t in ("start", "end", "in", "out", "duration")] == [
        "0", "1050", "0", "1050", "1050"]
    keys = clip.findall("filter/effect/parameter/keyframe")
    assert [(k.findtext("when"), k.findtext("value")) for k in keys] == [
        (str(round(i * 5 * 29.97)), v) for i, v in enumerate(
            ["1.0000", "0.2512", "1.0000", "1.0000", "1.0000", "0.2512", "1.0000"])]
    effect = clip.find("filter/effect")
    assert [effect.findtext(t) for t in ("name", "effectid", "effecttype", "parameter/parameterid",
                                         "parameter/name")] == [
        "Audio Levels", "audiolevels", "audio", "level", "Level"]


def test_text_is_laid_out_as_the_standard_writer_does(parts):
    made, cameras, mics = parts
    for text in texts(export(made(), cameras, mics, name="")).values():
        tree = ET.ElementTree(ET.fromstring(text.encode()))
        for e in tree.iter():
            if e.text is not None and not e.text.strip():
                e.text = None
            e.tail = None
        ET.indent(tree, space="  ")
        out = io.BytesIO()
        tree.write(out, encoding="utf-8", xml_declaration=True)
        assert out.getvalue().decode() == text


def test_audio_needs_both_microphones(spark, parts):
    made, cameras, _ = parts
    mics = spark.createDataFrame(
        [(1, 0, "h", 1, "/a.wav"), (2, 1, "g", 2, "/b.wav"),
         *[(3, t, "x", t, f"/{t}.wav") for t in (0, 1, 2)]], TRACKS)
    found = texts(export(made(), cameras, mics))
    assert "<audio>" not in found[1] and "<audio>" not in found[2]
    audio = ET.fromstring(found[3].encode()).find("sequence/media/audio")
    assert [c.get("id") for c in audio.iter("clipitem")] == ["clipitem-a0", "clipitem-a1"]


def test_one_pass_and_joins_give_the_same_pieces(spark, parts):
    """Also for events and segments without a head, tracks beyond two, and null labels."""
    made, cameras, mics = parts
    line = made()
    line = line._replace(
        events=line.events.unionByName(line.events.limit(1).selectExpr(
            "session_id", "9000L AS place", "time_s", "target_db", "7 AS track_index")),
        segments=line.segments.unionByName(line.segments.limit(1).selectExpr(
            "77L AS session_id", *line.segments.columns[1:])))
    for tracks in (mics, None, mics.limit(0)):
        once, joined = ({tuple(r) for r in export(line, cameras, tracks, block=block)
                         .select("session_id", "section", "place", "text").collect()}
                        for block in (None, BLOCK))
        assert once == joined and len(once) > 15
    assert {r[0] for r in once} == {1, 2, 3}


def test_places_of_pieces_are_unique(parts):
    made, cameras, mics = parts
    keys = export(made(), cameras, mics).select("session_id", "section", "place")
    assert keys.count() == keys.distinct().count()


def test_audio_needs_all_paths_and_keyframes_need_events(parts):
    made, cameras, mics = parts
    found = texts(export(made(), cameras, mics))
    assert "<audio>" not in found[2] and "<audio>" not in found[3]
    assert "<audio>" not in texts(export(made(), cameras))[1]
    quiet = texts(export(made(Params()), cameras, mics))
    assert "clipitem-a1" in quiet[1] and "keyframe" not in quiet[1]


def test_an_unknown_camera_becomes_the_first(parts):
    made, cameras, mics = parts
    clip = clips.video_clips(made(), cameras).where("session_id = 2").first()
    assert (clip.name, clip.file_id, clip.path) == ("Cam0 - speaker_a", "file-cam0",
                                                    "/cam/wide & all.mp4")
    assert ET.fromstring(texts(export(made(), cameras))[3].encode()).find(
        "sequence/media/video/track/clipitem") is None


def test_negative_cameras_are_refused(spark, parts):
    _, cameras, _ = parts
    segs = number_segments(spark.createDataFrame([(1, 0, 0.0, 1.0, -1, A, None)], SEGMENTS))
    seconds = spark.createDataFrame([(1, 1.0)], "session_id long, total_duration_s double")
    with pytest.raises(Exception, match="negative camera"):
        export(timelines.assemble(segs, seconds, DUCK), cameras).collect()
    with pytest.raises(Exception, match="negative camera"):
        clips.video_clips(timelines.assemble(segs, seconds, DUCK), cameras).collect()
