"""Column layouts of the relations that the operators hand to each other."""

from __future__ import annotations

from pyspark.sql import types as T

SESSION = "session_id"
TRACK_KEYS = ["session_id", "track"]

# The four joint states of two tracks.
SILENCE, SPEAKER_A, SPEAKER_B, BOTH = "silence", "speaker_a", "speaker_b", "both"
STATES = [SILENCE, SPEAKER_A, SPEAKER_B, BOTH]

# Fixed value: frame rate of a timeline that names none.
DEFAULT_FPS = 29.97

SAMPLES = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("track", T.IntegerType()),
    T.StructField("idx", T.LongType()),
    T.StructField("x", T.DoubleType()),
])

TRACKS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("track", T.IntegerType()),
    T.StructField("speaker_label", T.StringType()),
    T.StructField("camera_index", T.IntegerType()),
    T.StructField("path", T.StringType()),
])

CAMERAS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("camera_index", T.IntegerType()),
    T.StructField("path", T.StringType()),
])

# The field names of segments and gain events, which stored documents use.
SEGMENT = T.StructType([
    T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()),
    T.StructField("camera_index", T.IntegerType()),
    T.StructField("speaker_state", T.StringType()),
    T.StructField("speaker_label", T.StringType()),
])

GAIN_EVENT = T.StructType([
    T.StructField("time_s", T.DoubleType()),
    T.StructField("target_db", T.DoubleType()),
    T.StructField("track_index", T.IntegerType()),
])

# A segment list before it is numbered: pos is any increasing integer per session.
SEGMENTS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    *SEGMENT.fields,
])

# The stored document: exactly these four keys, in this order.
DOCUMENT = T.StructType([
    T.StructField("total_duration_s", T.DoubleType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
    T.StructField("ducking_events", T.ArrayType(GAIN_EVENT)),
])
