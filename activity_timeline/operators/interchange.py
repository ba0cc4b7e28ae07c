"""Editing-interchange XML from clip lists.

Clips are turned into text one by one. A document is the pieces of its session
in the order of (section, place), joined by line breaks; it is never held as a
whole, so sessions may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import (
    START_TIMECODE, TIMECODE_FORMAT, linear_gain, ntsc, seconds_to_frames, start_frame, timebase)
from activity_timeline.functions.paths import file_name, file_stem, file_uri, xml_text
from activity_timeline.operators.clips import (
    audio_clips, keyframes, mark_first_use, microphones, video_clips)
from activity_timeline.operators.timelines import Timelines
from activity_timeline.schemas import SESSION

# Order of the sections in a document; track 1 adds TRACK_SECTIONS to those of a track.
HEAD, VIDEO, VIDEO_END, AUDIO_HEAD, CLIP, KEYS_HEAD, KEYS, KEYS_END, CLIP_END = range(9)
TRACK_SECTIONS = 5
AUDIO_END, TAIL = 14, 15

# Kinds of rows, in `_tagged`.
HEAD_ROW, CAMERA_ROW, TRACK_ROW, SEGMENT_ROW, EVENT_ROW = range(5)

# The names and texts of elements below are fixed values of the format.


def _leaf(depth: int, name: str, value) -> list:
    return ["  " * depth + f"<{name}>", value, f"</{name}>\n"]


def _node(depth: int, name: str, *children: list, attributes: tuple = ()) -> list:
    return ["  " * depth + f"<{name}", *attributes, ">\n",
            *[piece for child in children for piece in child], "  " * depth + f"</{name}>\n"]


def _text(pieces: list) -> Column:
    """One string from literal and column pieces."""
    joined: list = []
    for piece in pieces:
        if isinstance(piece, str) and joined and isinstance(joined[-1], str):
            joined[-1] += piece
        else:
            joined.append(piece)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in joined])


def _rate(depth: int, fps: Column) -> list:
    return _node(depth, "rate", _leaf(depth + 1, "timebase", timebase(fps)),
                 _leaf(depth + 1, "ntsc", ntsc(fps)))


def _file(depth: int, media: str, frames: Column, fps: Column, path: Column,
          file_id: str | Column) -> list:
    return _node(
        depth, "file",
        _leaf(depth + 1, "name", xml_text(file_name(path))),
        _leaf(depth + 1, "pathurl", file_uri(path)),
        _rate(depth + 1, fps),
        _leaf(depth + 1, "duration", frames),
        _node(depth + 1, "media",
              _node(depth + 2, media, _leaf(depth + 3, "duration", frames))),
        attributes=(' id="', file_id, '"'))


def _clip_opening(depth: int, frames: Column, start: Column, end: Column, fps: Column,
                  clip_id: str | Column, name: Column) -> list:
    return ["  " * depth + '<clipitem id="', clip_id, '">\n',
            *_leaf(depth + 1, "name", xml_text(name)),
            *_leaf(depth + 1, "duration", frames),
            *_rate(depth + 1, fps),
            *_leaf(depth + 1, "start", start), *_leaf(depth + 1, "end", end),
            *_leaf(depth + 1, "in", start), *_leaf(depth + 1, "out", end)]


def _closing(depth: int, *names: str) -> str:
    """Closing tags from the innermost, at `depth`, outwards."""
    return "".join("  " * (depth - i) + f"</{n}>\n" for i, n in enumerate(names))


def _head(name: str, width: int, height: int, fps: Column, total: Column) -> Column:
    title = (_leaf(2, "name", xml_text(F.lit(name))) if name else ["    <name />\n"])
    return _text([
        "<?xml version='1.0' encoding='utf-8'?>\n<xmeml version=\"5\">\n  <sequence>\n",
        *title,
        *_leaf(2, "duration", seconds_to_frames(total, fps)),
        *_rate(2, fps),
        *_node(2, "timecode", _rate(3, fps), _leaf(3, "string", START_TIMECODE),
               _leaf(3, "frame", start_frame(fps)),
               _leaf(3, "displayformat", TIMECODE_FORMAT)),
        "    <media>\n      <video>\n",
        *_node(4, "format", _node(
            5, "samplecharacteristics", _leaf(6, "width", str(width)),
            _leaf(6, "height", str(height)), _leaf(6, "pixelaspectratio", "Square"),
            _rate(6, fps))),
        "        <track>\n",
        *_leaf(5, "enabled", "TRUE"), *_leaf(5, "locked", "FALSE")])


def _audio_head() -> str:
    pieces = ["      <audio>\n",
              *_node(4, "format", _node(5, "samplecharacteristics", _leaf(6, "depth", "16"),
                                        _leaf(6, "samplerate", "48000"))),
              *_node(4, "outputs", _node(
                  5, "group", _leaf(6, "index", "1"), _leaf(6, "numchannels", "2"),
                  _leaf(6, "downmix", "0"), _node(6, "channel", _leaf(7, "index", "1"))))]
    return "".join(pieces)


def _track_section(track: int | Column, base: int) -> int | Column:
    return track * TRACK_SECTIONS + base


def _video_clip(clip) -> Column:
    """Text of a video clip; `clip` gives the columns of `video_clips` with first uses marked."""
    fps = clip("fps")
    reference = ['            <file id="', clip("file_id"), '" />\n']
    return F.concat(
        _text(_clip_opening(5, clip("duration_frames"), clip("start_frame"), clip("end_frame"),
                            fps, clip("clip_id"), clip("name"))),
        F.when(clip("is_definition"), _text(_file(6, "video", clip("file_frames"), fps,
                                                  clip("path"), clip("file_id"))))
        .otherwise(_text(reference)),
        F.lit(_closing(5, "clipitem")))


def _audio_opening(start: Column, end: Column, fps: Column, path: Column, clip_id: str | Column,
                   name: Column, file_id: str | Column) -> Column:
    track_head = ["        <track>\n", *_leaf(5, "enabled", "TRUE"), *_leaf(5, "locked", "FALSE")]
    return F.concat(_text(track_head),
                    _text(_clip_opening(5, end, start, end, fps, clip_id, name)),
                    _text(_file(6, "audio", end, fps, path, file_id)))


def _filter_head() -> str:
    return ("            <filter>\n              <effect>\n"
            + "".join(_leaf(8, "name", "Audio Levels") + _leaf(8, "effectid", "audiolevels")
                      + _leaf(8, "effecttype", "audio"))
            + "                <parameter>\n"
            + "".join(_leaf(9, "parameterid", "level") + _leaf(9, "name", "Level")))


def _keyframe(frame: Column, gain: Column) -> Column:
    return _text(_node(9, "keyframe", _leaf(10, "when", frame), _leaf(10, "value", gain)))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


_FRAME = ((VIDEO_END, _closing(4, "track", "video")),
          (TAIL, _closing(2, "media") + "  </sequence>\n</xmeml>"))


def sequence_documents(timelines: Timelines, cameras: DataFrame, tracks: DataFrame | None,
                       name: str, width: int = 1920, height: int = 1080,
                       block: int | None = None) -> DataFrame:
    """The text of all documents as pieces: session_id, section, place, text.

    All relations become rows of one, which is shuffled once, by session. Each row finds
    there what it needs of its session's head, cameras, microphones and other segments.
    With a `block` sessions may have more rows than a task can order: then the relations
    are joined, and no task gets a whole session.
    """
    if block is not None:
        return _by_joins(timelines, cameras, tracks, name, width, height)
    rows = _tagged(timelines, cameras, tracks)
    session = Window.partitionBy(SESSION)

    def known(kind: int, value: Column) -> Column:
        return F.max(F.when(F.col("kind") == kind, value)).over(session)

    rows = rows.select(
        "*", known(HEAD_ROW, F.lit(True)).alias("_headed"),
        known(HEAD_ROW, F.col("fps")).alias("_fps"),
        known(HEAD_ROW, F.col("total_duration_s")).alias("_total"),
        known(CAMERA_ROW, F.when(F.col("camera_index") == 0, F.col("path"))).alias("_wide"),
        *[known(TRACK_ROW, F.when(F.col("track") == t, F.col("path"))).alias(f"_mic_{t}")
          for t in (0, 1)],
        *[known(EVENT_ROW, F.col("track") == t).alias(f"_keyed_{t}") for t in (0, 1)])
    # pieces are made of rows whose session has a head; cameras are looked up by their number
    own = F.max(F.when(F.col("kind") == CAMERA_ROW, F.col("path"))).over(
        Window.partitionBy(SESSION, "camera_index"))
    rows = rows.withColumn("_path", own).where(
        F.col("_headed") & ~F.col("kind").isin(CAMERA_ROW, TRACK_ROW))
    index = (F.when(F.col("kind") != SEGMENT_ROW, None)
             .when(F.col("camera_index") < 0,
                   F.raise_error(F.lit("negative camera index")).cast("int"))
             .when(F.col("_path").isNotNull(), F.col("camera_index")).otherwise(F.lit(0)))
    rows = rows.withColumn("_index", index)
    first = F.min(F.when(F.col("kind") == SEGMENT_ROW, F.col("place"))).over(
        Window.partitionBy(SESSION, "_index"))
    rows = rows.withColumn("_first", first)
    return rows.select(SESSION, F.inline(_pieces_of_a_row(name, width, height))).select(
        SESSION, "section", "place", "text")


_TAGGED = {"kind": "int", "place": "bigint", "fps": "double", "total_duration_s": "double",
           "camera_index": "int", "path": "string", "track": "int", "start_s": "double",
           "end_s": "double", "speaker_state": "string", "time_s": "double", "target_db": "double"}


def _tagged(timelines: Timelines, cameras: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """The rows of all relations in one layout."""
    relations = {HEAD_ROW: timelines.heads, CAMERA_ROW: cameras, TRACK_ROW: tracks,
                 SEGMENT_ROW: timelines.segments.withColumnRenamed("seg_idx", "place"),
                 EVENT_ROW: timelines.events.withColumnRenamed("track_index", "track")}
    found = []
    for kind, df in relations.items():
        if df is not None:
            values = {c: F.col(c) for c in df.columns} | {"kind": F.lit(kind)}
            found.append(df.select(SESSION, *[values.get(c, F.lit(None)).cast(t).alias(c)
                                              for c, t in _TAGGED.items()]))
    return reduce(DataFrame.unionByName, found)


def _pieces_of_a_row(name: str, width: int, height: int) -> Column:
    """Array of the pieces (section, place, text) that a tagged row with its session's values gives."""
    def piece(section: int | Column, text: str | Column, place: Column | None = None) -> Column:
        return F.struct(
            (F.lit(section) if isinstance(section, int) else section).cast("int").alias("section"),
            (F.lit(0).cast("bigint") if place is None else place).alias("place"),
            _trimmed(F.lit(text) if isinstance(text, str) else text).alias("text"))

    fps, kind = F.col("_fps"), F.col("kind")
    total = seconds_to_frames(F.col("_total"), fps)
    head = [piece(HEAD, _head(name, width, height, fps, F.col("_total"))), *[piece(*x) for x in _FRAME]]
    audio, keyed = [piece(AUDIO_HEAD, _audio_head()), piece(AUDIO_END, _closing(3, "audio"))], []
    for t in (0, 1):
        mic = F.col(f"_mic_{t}")
        audio += [piece(_track_section(t, CLIP), _audio_opening(
                      F.lit(0).cast("bigint"), total, fps, mic, f"clipitem-a{t}", file_stem(mic),
                      f"file-audio{t}")),
                  piece(_track_section(t, CLIP_END), _closing(5, "clipitem", "track"))]
        keyed.append(F.array(piece(_track_section(t, KEYS_HEAD), _filter_head()),
                             piece(_track_section(t, KEYS_END),
                                   _closing(8, "parameter", "effect", "filter"))))
    both = F.col("_mic_0").isNotNull() & F.col("_mic_1").isNotNull()
    nothing = F.slice(F.array(piece(HEAD, "")), 1, 0)
    whole = F.concat(F.array(*head), F.when(both, F.concat(F.array(*audio), *[
        F.when(F.col(f"_keyed_{t}"), keyed[t]).otherwise(nothing) for t in (0, 1)]))
        .otherwise(nothing))

    start, end = (seconds_to_frames(F.col(c), fps) for c in ("start_s", "end_s"))
    index, place = F.col("_index"), F.col("place")
    clip = {"fps": fps, "duration_frames": end - start, "start_frame": start, "end_frame": end,
            "clip_id": F.format_string("clipitem-v%d", "place"),
            "name": F.format_string("Cam%d - %s", "_index", "speaker_state"),
            "file_id": F.format_string("file-cam%d", "_index"),
            "is_definition": place == F.col("_first"),
            "path": F.coalesce("_path", "_wide"), "file_frames": total}
    video = F.array(piece(VIDEO, _video_clip(clip.__getitem__), place))
    key = F.array(piece(_track_section(F.col("track"), KEYS), _keyframe(
        seconds_to_frames(F.col("time_s"), fps),
        F.format_string("%.4f", linear_gain(F.col("target_db")))), place))
    return (F.when(kind == HEAD_ROW, whole).when(kind == SEGMENT_ROW, video)
            .when((kind == EVENT_ROW) & both & F.col("track").isin(0, 1), key))


def _by_joins(timelines: Timelines, cameras: DataFrame, tracks: DataFrame | None,
              name: str, width: int, height: int) -> DataFrame:
    """The pieces by joins of clip lists, for sessions of any length."""
    def pieces(df: DataFrame, *texts: tuple, place: str | None = None) -> DataFrame:
        """Rows of (section, text) pairs; place counts only in lists of clips or keys."""
        found = df.select(
            SESSION, (F.col(place) if place else F.lit(0)).cast("bigint").alias("place"),
            F.inline(F.array(*[
                F.struct((F.lit(s) if isinstance(s, int) else s).cast("int").alias("section"),
                         (F.lit(t) if isinstance(t, str) else t).alias("text"))
                for s, t in texts])))
        return found.select(SESSION, "section", "place", _trimmed(F.col("text")).alias("text"))

    heads = timelines.heads
    clips = mark_first_use(video_clips(timelines, cameras))
    head = _head(name, width, height, F.col("fps"), F.col("total_duration_s"))
    found = [pieces(heads, (HEAD, head), *_FRAME),
             pieces(clips, (VIDEO, _video_clip(F.col)), place="seg_idx")]
    if tracks is not None:
        audio = audio_clips(timelines, tracks)
        mics = microphones(tracks).select(SESSION)
        # tracks named by any gain event
        keyed = timelines.events.select(SESSION, F.col("track_index").alias("track")).distinct()
        keys = (keyframes(timelines).where(F.col("track").isin(0, 1))
                .join(mics, SESSION, "left_semi"))
        track = F.col("track")
        opening = _audio_opening(F.col("start_frame"), F.col("end_frame"), F.col("fps"),
                                 F.col("path"), F.col("clip_id"), F.col("name"), F.col("file_id"))
        found += [
            pieces(audio, (_track_section(track, CLIP), opening),
                   (_track_section(track, CLIP_END), _closing(5, "clipitem", "track"))),
            pieces(heads.join(mics, SESSION, "left_semi"), (AUDIO_HEAD, _audio_head()),
                   (AUDIO_END, _closing(3, "audio"))),
            pieces(audio.join(keyed, [SESSION, "track"], "left_semi"),
                   (_track_section(track, KEYS_HEAD), _filter_head()),
                   (_track_section(track, KEYS_END), _closing(8, "parameter", "effect", "filter"))),
            pieces(keys, (_track_section(track, KEYS),
                          _keyframe(F.col("frame"), F.col("gain"))), place="place"),
        ]
    return reduce(DataFrame.unionByName, found)
