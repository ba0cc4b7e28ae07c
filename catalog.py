"""Registered queries: every operator of the library on the given tables."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline import Params, analyze, export, ingest, preview
from activity_timeline.functions.numbers import (
    START_TIMECODE, TIMECODE_FORMAT, ntsc, seconds_to_frames, start_frame, timebase)
from activity_timeline.functions.paths import file_name, file_stem, file_uri
from activity_timeline.operators import clips, frames, rules, segments, signal, timelines
from activity_timeline.operators.activity import activity_flags, combine_tracks
from activity_timeline.operators.slices import BLOCK, choose_block, scan, scratch_path
from activity_timeline.plans import analyze as chain
from activity_timeline.schemas import SESSION, TRACK_KEYS
from activity_timeline.sources import documents, tables, wav

# 100 samples a second: window 3, hop 1, kernel 5, hangover 2
EVENT_PARAMS = Params(sample_rate=100, smoothing_ms=50.0, speech_threshold_db=-18.0,
                      release_threshold_db=-20.0, hangover_ms=20.0, debounce_ms=20.0,
                      min_segment_ms=40.0)
# the same sizes, release above speech
CROSSED_PARAMS = replace(EVENT_PARAMS, speech_threshold_db=-20.0, release_threshold_db=-16.0)
# the same sizes, thresholds for l_extendedprice / 105000
LINE_PARAMS = Params(sample_rate=100, smoothing_ms=50.0, speech_threshold_db=-4.0,
                     release_threshold_db=-5.0, hangover_ms=20.0, debounce_ms=20.0,
                     min_segment_ms=40.0)
# window 30, hop 20: panes of 10 samples, two panes per hop
PANE_PARAMS = Params(sample_rate=1000, hop_ms=20.0)
# window 661, hop 220: no common divisor
UNEVEN_PARAMS = Params(sample_rate=22_050)
TURN_PARAMS = Params(sample_rate=15, hop_ms=100.0, window_ms=100.0, debounce_ms=10_000.0,
                     min_segment_ms=20_000.0, ducking_enabled=True)
HOT_SLICE = 852
TURN_STRIDE = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- events: users are sessions, views and clicks are track 0 ----

# Each step returns its rows and the slice size that the size of the largest user asks for.

def _event_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    events = _table(spark, sf_dir, "events")
    block = choose_block(events, ["user_id"])
    track = F.when(F.col("event_type").isin("view", "click"), 0).otherwise(1)
    return tables.samples_from(events, F.col("user_id"), track, ["ts", "event_id"],
                               F.col("value") / F.lit(600.0), block), block


def _event_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    samples, block = _event_samples(spark, sf_dir)
    block = frames.frame_block(EVENT_PARAMS, block)
    panes = frames.pane_energy(samples, EVENT_PARAMS)
    return frames.frame_table(panes, TRACK_KEYS, {"energy": ""}, EVENT_PARAMS, block), block


def _event_flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    made, block = _event_frames(spark, sf_dir)
    flags = activity_flags(made, TRACK_KEYS, [""], EVENT_PARAMS, block)
    return frames.own_frames(flags, block), block


def _event_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    flags, block = _event_flags(spark, sf_dir)
    return combine_tracks(flags), block


def _event_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    states, block = _event_states(spark, sf_dir)
    return segments.run_lengths(states, EVENT_PARAMS.grid.hop_s, block), block


def track_index(spark, sf_dir):
    return _six(_event_samples(spark, sf_dir)[0], "x")


def mono_mixdown_rows(spark, sf_dir):
    """The two tracks of a user as two channels of one recording."""
    one = _event_samples(spark, sf_dir)[0].withColumn("track", F.lit(0))
    return _six(signal.mono_mixdown(one), "x")


def align_pad(spark, sf_dir):
    return _six(signal.align_pad(_event_samples(spark, sf_dir)[0]), "x")


def session_duration(spark, sf_dir):
    return _six(signal.session_duration(_event_samples(spark, sf_dir)[0], 100),
                "total_duration_s")


def frame_rms(spark, sf_dir):
    made, block = _event_frames(spark, sf_dir)
    return _six(frames.own_frames(made, block).select(*TRACK_KEYS, "frame", "rms_db"), "rms_db")


def ema_envelope(spark, sf_dir):
    made, block = _event_frames(spark, sf_dir)
    return _six(frames.own_frames(made, block).select(*TRACK_KEYS, "frame", "envelope_db"),
                "envelope_db")


def frame_table(spark, sf_dir):
    made, block = _event_frames(spark, sf_dir)
    return _six(frames.own_frames(made, block).select(
        *TRACK_KEYS, "frame", "time_s", "rms_db", "envelope_db",
        F.lit(False).alias("is_active")), "time_s", "rms_db", "envelope_db")


def frame_dataset(spark, sf_dir):
    """The frame table as a bucketed dataset, read back."""
    path = scratch_path(spark, "frames")
    documents.write_relation(frame_table(spark, sf_dir), path, 8)
    return spark.read.parquet(path).drop("bucket")


def activity_flag(spark, sf_dir):
    return _event_flags(spark, sf_dir)[0].select(*TRACK_KEYS, "frame", "is_active")


def speaker_states(spark, sf_dir):
    return _event_states(spark, sf_dir)[0]


def activity_flag_crossed(spark, sf_dir):
    """Flags when the release threshold lies above the speech threshold."""
    made, block = _event_frames(spark, sf_dir)
    flags = activity_flags(made, TRACK_KEYS, [""], CROSSED_PARAMS, block)
    return frames.own_frames(flags, block).select(*TRACK_KEYS, "frame", "is_active")


def joint_states(spark, sf_dir):
    """States when the shorter track is padded with silence."""
    samples, block = _event_samples(spark, sf_dir)
    return (chain.joint_states(samples, EVENT_PARAMS, block)
            .select(SESSION, "frame", "speaker_state"))


def _seconds(df: DataFrame) -> DataFrame:
    return _six(df.select(SESSION, "pos", "start_s", "end_s", "speaker_state"),
                "start_s", "end_s")


def runs(spark, sf_dir):
    return _seconds(_event_runs(spark, sf_dir)[0])


def debounced(spark, sf_dir):
    found, block = _event_runs(spark, sf_dir)
    return _seconds(segments.absorb_short(found, EVENT_PARAMS.grid.debounce_s, block))


def min_length(spark, sf_dir):
    found, block = _event_runs(spark, sf_dir)
    short = segments.absorb_short(found, EVENT_PARAMS.grid.debounce_s, block)
    return _seconds(segments.absorb_short(short, EVENT_PARAMS.grid.min_segment_s, block))


def merged(spark, sf_dir):
    """The chain in one go: runs, debounce, minimum length, merging."""
    states, block = _event_states(spark, sf_dir)
    return _seconds(segments.segment_states(states, EVENT_PARAMS, block))


def merge_runs(spark, sf_dir):
    """Merging alone, on all runs after debouncing, which leaves equal neighbours."""
    found, block = _event_runs(spark, sf_dir)
    short = segments.absorb_short(found, EVENT_PARAMS.grid.debounce_s, block)
    return _seconds(segments.merge_adjacent(short, block))


def event_segments(spark, sf_dir):
    samples, block = _event_samples(spark, sf_dir)
    found = chain.segments(samples, EVENT_PARAMS, block)
    return _six(found.select(SESSION, "seg_idx", "start_s", "end_s", "speaker_state"),
                "start_s", "end_s")


# ---- embeddings: two vectors are the two tracks of a session ----

def _vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return tables.samples_from_arrays(
        _table(spark, sf_dir, "embeddings"), F.call_function("div", vec, F.lit(2)), vec % 2,
        F.lit(0), F.col("embedding"), chunk_size=64)


def array_samples(spark, sf_dir):
    return _six(_vector_samples(spark, sf_dir), "x")


def chunked_samples(spark, sf_dir):
    """All vectors of a label as the chunks of one track."""
    vectors = _table(spark, sf_dir, "embeddings")
    block = choose_block(vectors, ["label"])
    return _six(tables.samples_from_arrays(
        vectors, F.col("label"), F.lit(0), F.col("vec_id"), F.col("embedding"), block), "x")


def mono_mixdown(spark, sf_dir):
    """Each vector as one instant with 64 channels."""
    return _six(_table(spark, sf_dir, "embeddings").select(
        "vec_id", signal.mono(F.col("embedding")).alias("x")), "x")


def _resampled(spark: SparkSession, sf_dir: str, from_rate: int, to_rate: int) -> DataFrame:
    samples = _vector_samples(spark, sf_dir)
    block = choose_block(samples, TRACK_KEYS)
    return _six(signal.resample(samples, from_rate, to_rate, block), "x")


def resample_linear(spark, sf_dir):
    return _resampled(spark, sf_dir, 44_100, 16_000)


def resample_up(spark, sf_dir):
    return _resampled(spark, sf_dir, 16_000, 44_100)


RATES = (8_000, 16_000, 44_100)


def _wav_pieces(spark: SparkSession, sf_dir: str, rate, suffix) -> DataFrame:
    """Stereo 16-bit files made from groups of eight vectors, read back in pieces."""
    # the package for the Python workers, as any job would submit it
    spark.sparkContext.addPyFile(_package_archive())
    folder = scratch_path(spark, "wav")
    parts = (_table(spark, sf_dir, "embeddings")
             .groupBy(F.call_function("div", F.col("vec_id"), F.lit(8)).alias("session_id"))
             .agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
             .select("session_id", F.transform(
                 F.flatten(F.transform("v", lambda s: s["embedding"])),
                 lambda x: F.floor(x.cast("double") * 32768.0).cast("int")).alias("values"),
                 rate(F.col("session_id")).alias("rate"),
                 F.concat(F.col("session_id"), suffix(F.col("session_id"))).alias("name")))
    parts.mapInPandas(_wav_writer(folder), "path string").count()
    return wav.read_wav(spark, folder, piece_bytes=510)


def wav_samples(spark, sf_dir):
    pieces = _wav_pieces(spark, sf_dir, lambda n: F.lit(16_000), lambda n: F.lit(".wav"))
    number = F.regexp_extract("path", r"(\d+)\.wav$", 1)
    return _six(wav.wav_samples(pieces, number, F.lit(0)).drop("sample_rate"), "x")


def wav_ingest(spark, sf_dir):
    """Files of three rates, two to a session and half of them .WAV, brought to 16 kHz."""
    pieces = _wav_pieces(
        spark, sf_dir,
        lambda n: F.element_at(F.array(*[F.lit(r) for r in RATES]), (n % 3 + 1).cast("int")),
        lambda n: F.when(n % 2 == 0, ".wav").otherwise(".WAV"))
    number = F.regexp_extract("path", r"(\d+)\.(?i:wav)$", 1).cast("bigint")
    samples = wav.wav_samples(pieces, F.call_function("div", number, F.lit(2)), number % 2)
    return _six(ingest(samples, Params()), "x")


def _wav_writer(folder: str):
    def write(batches):
        import wave

        import numpy as np
        from activity_timeline.sources.wav import locate
        system, root = locate(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, rate, values in zip(batch["name"], batch["rate"], batch["values"]):
                with system.open_output_stream(f"{root}/{name}") as file, \
                        wave.open(file, "wb") as out:
                    out.setnchannels(2)
                    out.setsampwidth(2)
                    out.setframerate(rate)
                    out.setnframes(len(values) // 2)
                    out.writeframesraw(np.asarray(values, "<i2").tobytes())
            yield batch[["name"]].rename(columns={"name": "path"})
    return write


@cache
def _package_archive() -> str:
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "activity_timeline"
    return shutil.make_archive(str(target), "zip", root_dir=root, base_dir="activity_timeline")


# ---- lineitem: suppliers are sessions, the line status is the track ----

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
              "l_quantity"]


def _line_samples(lines: DataFrame, session, block: int | None) -> DataFrame:
    track = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    return tables.samples_from(lines, session, track, LINE_ORDER,
                               F.col("l_extendedprice") / F.lit(105000.0), block)


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    lines = _table(spark, sf_dir, "lineitem")
    block = choose_block(lines, ["l_suppkey"])
    return _line_samples(lines, F.col("l_suppkey"), block), block


def frame_rms_panes(spark, sf_dir):
    """Windows that overlap by half a hop, from panes of ten samples."""
    samples, block = _suppliers(spark, sf_dir)
    block = frames.frame_block(PANE_PARAMS, block)
    levels = frames.frame_levels(frames.pane_energy(samples, PANE_PARAMS), TRACK_KEYS,
                                 {"energy": "rms_db"}, PANE_PARAMS, block)
    return _six(frames.own_frames(levels, block).select(*TRACK_KEYS, "frame", "rms_db"), "rms_db")


def frame_rms_uneven(spark, sf_dir):
    """All lines as three recordings at 22,050 Hz, from two panes per hop."""
    lines = _table(spark, sf_dir, "lineitem").withColumn("recording", F.col("l_suppkey") % 3)
    block = choose_block(lines, ["recording"])
    samples = _line_samples(lines, F.col("recording"), block)
    block = frames.frame_block(UNEVEN_PARAMS, block)
    levels = frames.frame_levels(frames.pane_energy(samples, UNEVEN_PARAMS), TRACK_KEYS,
                                 {"energy": "rms_db"}, UNEVEN_PARAMS, block)
    return _six(frames.own_frames(levels, block).select(*TRACK_KEYS, "frame", "rms_db"), "rms_db")


def segments_lineitem(spark, sf_dir):
    samples, block = _suppliers(spark, sf_dir)
    found = chain.segments(samples, LINE_PARAMS, block)
    return _six(found.select(SESSION, "seg_idx", "start_s", "end_s", "speaker_state"),
                "start_s", "end_s")


def _hot_segments(spark: SparkSession, sf_dir: str, **limit) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    session = F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey"))
    samples = _line_samples(lines, session, HOT_SLICE)
    found = chain.segments(samples, LINE_PARAMS, HOT_SLICE, **limit)
    return _six(found.select(SESSION, "seg_idx", "start_s", "end_s", "speaker_state"),
                "start_s", "end_s")


def segments_hot_session(spark, sf_dir):
    """A third of all rows in one session: samples and frames in slices, the few runs whole."""
    return _hot_segments(spark, sf_dir)


def segments_hot_slices(spark, sf_dir):
    """The same with the runs in slices, too."""
    return _hot_segments(spark, sf_dir, limit=0)


def timelines_lineitem(spark, sf_dir):
    """Samples to timelines in one job, counted per session."""
    samples, block = _suppliers(spark, sf_dir)
    made = analyze(samples, None, LINE_PARAMS, block=block)
    return _six(preview(made)[0].drop("header", "footer"), "total_duration_s")


def timelines_stored_panes(spark, sf_dir):
    """The same with the panes written once: heads and segments read nothing else."""
    samples, block = _suppliers(spark, sf_dir)
    made = analyze(samples, None, LINE_PARAMS, block=block, store=scratch_path(spark, "panes"))
    return _six(preview(made)[0].drop("header", "footer"), "total_duration_s")


# ---- conversations: turns are segments, 15 characters take a second ----

def _turns(spark: SparkSession, sf_dir: str, table=_table) -> tuple[DataFrame, int | None]:
    read = table(spark, sf_dir, "conversations")
    block = choose_block(read, ["conv_id"])
    spoken = read.select(
        F.col("conv_id").alias(SESSION), F.col("turn").alias("pos"),
        F.when(F.col("role") == "user", "speaker_a")
        .when(F.col("role") == "assistant", "speaker_b").otherwise("silence")
        .alias("speaker_state"), F.length("text").cast("bigint").alias("chars"))
    # whole characters are added up, so the times are the same in any order of adding
    placed = scan(spoken, [SESSION], "pos", block, sums={"before": F.col("chars")})
    rate = F.lit(15.0)
    return segments.as_segments(placed.select(
        SESSION, "pos", (F.col("before") / rate).alias("start_s"),
        ((F.col("before") + F.col("chars")) / rate).alias("end_s"), "speaker_state")), block


def _turn_segments(spark: SparkSession, sf_dir: str,
                   table=_table) -> tuple[DataFrame, int | None]:
    raw, block = _turns(spark, sf_dir, table)
    return segments.clean_segments(raw, TURN_PARAMS, block), block


def _tracks(spark: SparkSession, sf_dir: str, table=_table) -> DataFrame:
    """Two tracks per conversation; every fifth has none, every seventh an empty label."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias(SESSION)).distinct()
    number = F.col(SESSION)
    rows = F.array(
        F.struct(F.lit(0).alias("track"),
                 F.when(number % 7 == 0, "").otherwise(F.concat(F.lit("host & "), number))
                 .alias("speaker_label"), F.lit(1).alias("camera_index"),
                 F.concat(F.lit("/mic/"), number, F.lit("/host ~*é.take.wav")).alias("path")),
        F.struct(F.lit(1).alias("track"), F.lit("guest").alias("speaker_label"),
                 F.lit(2).alias("camera_index"),
                 F.concat(F.lit("/mic//"), number, F.lit("/./<guest>")).alias("path")))
    return ids.where(number % 5 != 0).select(SESSION, F.inline(rows))


def _cameras(spark: SparkSession, sf_dir: str, table=_table) -> DataFrame:
    """Three cameras per conversation; every fourth has only two."""
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias(SESSION)).distinct()
    number = F.col(SESSION)
    rows = F.array(*[F.struct(F.lit(i).alias("camera_index"), F.concat(
        F.lit("/cam/"), number, F.lit(f"/{name}.mp4")).alias("path"))
        for i, name in enumerate(("wide & all", "host", "guest"))])
    return (ids.select(SESSION, F.inline(rows))
            .where((F.col("camera_index") < 2) | (number % 4 != 0)))


FPS = (23.976, 24.0, 25.0, 29.97, 30.0, 59.94)


def _fps(number):
    return F.element_at(F.array(*[F.lit(f) for f in FPS]), (number % len(FPS) + 1).cast("int"))


def _durations(spark: SparkSession, sf_dir: str, table=_table) -> DataFrame:
    return (table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias(SESSION))
            .agg((F.sum(F.length("text")) / F.lit(15.0)).alias("total_duration_s")))


def _timelines(spark: SparkSession, sf_dir: str, table=_table) -> timelines.Timelines:
    found, block = _turn_segments(spark, sf_dir, table)
    placed = rules.assign_cameras(found, _tracks(spark, sf_dir, table), TURN_PARAMS, block)
    return timelines.assemble(placed, _durations(spark, sf_dir, table), TURN_PARAMS,
                              _fps(F.col(SESSION)))


def _one_conversation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All turns of all conversations, one after the other, as a single conversation."""
    return _table(spark, sf_dir, name).select(
        F.lit(1).cast("bigint").alias("conv_id"),
        (F.col("conv_id") * TURN_STRIDE + F.col("turn")).alias("turn"), "role", "text")


def turn_segments(spark, sf_dir):
    return _seconds(_turn_segments(spark, sf_dir)[0])


def segment_durations(spark, sf_dir):
    return _six(_turns(spark, sf_dir)[0].select(
        SESSION, "pos", segments.duration_s().alias("duration_s")), "duration_s")


def camera_plan(spark, sf_dir):
    found, block = _turn_segments(spark, sf_dir)
    placed = rules.assign_cameras(found, _tracks(spark, sf_dir), TURN_PARAMS, block)
    return _six(placed.select(SESSION, "seg_idx", "start_s", "end_s", "speaker_state",
                              "camera_index", "speaker_label"), "start_s", "end_s")


def gain_events(spark, sf_dir):
    return _six(rules.gain_events(_turn_segments(spark, sf_dir)[0], TURN_PARAMS), "time_s")


def timeline_counts(spark, sf_dir):
    made = _timelines(spark, sf_dir)
    spoken = made.segments.groupBy(SESSION).agg(
        F.count("*").cast("int").alias("n_segments"),
        F.min_by("speaker_state", "seg_idx").alias("first_state"))
    changes = made.events.groupBy(SESSION).agg(F.count("*").cast("int").alias("n_events"))
    return _six(made.heads.join(spoken, SESSION, "left").join(changes, SESSION, "left")
                .fillna(0, ["n_segments", "n_events"]), "total_duration_s")


def frame_numbers(spark, sf_dir):
    fps = _fps(F.col(SESSION))
    return _turns(spark, sf_dir)[0].select(
        SESSION, "pos", seconds_to_frames(F.col("start_s"), fps).alias("start_frame"),
        seconds_to_frames(F.col("end_s"), fps).alias("end_frame"))


def rate_class(spark, sf_dir):
    fps = _fps(F.col(SESSION))
    return _durations(spark, sf_dir).select(SESSION, fps.alias("fps"),
                                            timebase(fps).alias("timebase"), ntsc(fps).alias("ntsc"))


def start_timecode(spark, sf_dir):
    return _durations(spark, sf_dir).select(
        SESSION, F.lit(START_TIMECODE).alias("timecode"),
        start_frame(_fps(F.col(SESSION))).alias("frame"),
        F.lit(TIMECODE_FORMAT).alias("displayformat"))


def file_uris(spark, sf_dir):
    """The addresses of all pages as paths below /media."""
    path = F.concat(F.lit("/media/ü *~/"), F.col("url"))
    return _table(spark, sf_dir, "pages").select(
        "page_id", file_uri(path).alias("uri"), file_name(path).alias("name"),
        file_stem(path).alias("stem"))


def video_clips(spark, sf_dir):
    return clips.video_clips(_timelines(spark, sf_dir), _cameras(spark, sf_dir))


def file_first_use(spark, sf_dir):
    made = clips.video_clips(_timelines(spark, sf_dir), _cameras(spark, sf_dir))
    return clips.mark_first_use(made).select(SESSION, "seg_idx", "file_id", "is_definition")


def audio_clips(spark, sf_dir):
    return clips.audio_clips(_timelines(spark, sf_dir), _tracks(spark, sf_dir))


def keyframes(spark, sf_dir):
    return clips.keyframes(_timelines(spark, sf_dir)).select(SESSION, "track", "frame", "gain")


def _flat(made: timelines.Timelines) -> DataFrame:
    return _six(timelines.timeline_segments(made).select(
        SESSION, "seg_idx", "total_duration_s", "fps", "start_s", "end_s", "camera_index",
        "speaker_state", "speaker_label"), "total_duration_s", "start_s", "end_s")


def timeline_json_roundtrip(spark, sf_dir):
    return _flat(timelines.from_document(timelines.to_document(_timelines(spark, sf_dir))))


def timeline_parts(spark, sf_dir):
    """Timelines as a dataset in three parts, written as JSON lines and read back."""
    path = scratch_path(spark, "timelines")
    documents.write_timelines(_timelines(spark, sf_dir), path)
    return _flat(documents.read_timelines(spark, path))


def _through_files(spark: SparkSession, made: timelines.Timelines) -> DataFrame:
    path = scratch_path(spark, "documents")
    documents.write_document_files(timelines.to_document(made), path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"session_id=(\d+)", 1)
    return _flat(documents.read_timeline_files(spark, path, number))


def timeline_files(spark, sf_dir):
    """One JSON document per session in a folder of its own, read back as whole files."""
    return _through_files(spark, _timelines(spark, sf_dir))


def long_session_json(spark, sf_dir):
    """All turns as one session, through the pieces of its one document."""
    path = scratch_path(spark, "pieces")
    made = _timelines(spark, sf_dir, _one_conversation)
    documents.write_documents(timelines.to_document(made), path)
    return _flat(timelines.from_document(documents.read_documents(spark, path)))


def timeline_event_rows(spark, sf_dir):
    made = timelines.from_document(timelines.to_document(_timelines(spark, sf_dir)))
    return _six(timelines.timeline_events(made).select(
        SESSION, "time_s", "target_db", "track_index"), "time_s")


def timeline_summary(spark, sf_dir):
    return _six(preview(_timelines(spark, sf_dir))[0], "total_duration_s")


def segment_report(spark, sf_dir):
    return _six(preview(_timelines(spark, sf_dir))[1], "start_s", "end_s")


def sequence_xml(spark, sf_dir):
    return export(_timelines(spark, sf_dir), _cameras(spark, sf_dir), _tracks(spark, sf_dir))


def long_session_xml(spark, sf_dir):
    """The document of all turns as one session."""
    return export(_timelines(spark, sf_dir, _one_conversation),
                  _cameras(spark, sf_dir, _one_conversation),
                  _tracks(spark, sf_dir, _one_conversation), block=BLOCK)


def sequence_xml_video(spark, sf_dir):
    """Documents without audio, written as a dataset and read back."""
    path = scratch_path(spark, "xml")
    made = export(_timelines(spark, sf_dir), _cameras(spark, sf_dir), name="A <b> & c")
    documents.write_documents(made, path)
    return documents.read_documents(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        track_index, array_samples, chunked_samples, wav_samples, wav_ingest, mono_mixdown,
        mono_mixdown_rows, resample_linear, resample_up, align_pad, session_duration,
        frame_rms, frame_rms_panes, frame_rms_uneven, ema_envelope, frame_table, frame_dataset,
        activity_flag, activity_flag_crossed,
        speaker_states, joint_states, runs, debounced, min_length, merged, merge_runs,
        event_segments, turn_segments, segment_durations, camera_plan, gain_events,
        timeline_counts, frame_numbers, rate_class, start_timecode, file_uris, video_clips,
        file_first_use, audio_clips, keyframes, timeline_json_roundtrip, timeline_files,
        timeline_parts, timeline_event_rows, timeline_summary, segment_report, sequence_xml,
        sequence_xml_video, long_session_json, long_session_xml, segments_lineitem, segments_hot_session, segments_hot_slices,
        timelines_lineitem, timelines_stored_panes)}
