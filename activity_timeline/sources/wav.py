"""Uncompressed WAV files as array rows.

Files are listed by Spark, their headers are read once, and their data is cut
into byte pieces, so that a long recording is read by many tasks. Each piece
brings the layout of its file, seeks to its place, decodes it, and mixes the
channels down; no task holds more than one piece. Files over 4 GB (RF64 with
64-bit sizes) are read like others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole
from activity_timeline.operators.slices import explode_range
from activity_timeline.schemas import TRACK_KEYS

PIECE_BYTES = 4 << 20
PIECES = ("path string, sample_rate int, channels int, first bigint, values array<double>")
_ARROW = pa.schema([
    ("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()),
    ("first", pa.int64()), ("values", pa.list_(pa.float64()))])

# Fixed values of the file format: codes for whole numbers, floats, extended headers, and the
# size that stands where the 64-bit table has the real one.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
IN_TABLE = 0xFFFFFFFF
LAYOUT = ["code", "channels", "rate", "bits", "start", "size"]
HEADER = "path string, " + ", ".join(f"{name} bigint" for name in LAYOUT)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name for a path as Spark writes it (file:/a, hdfs://h/a, or plain)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@%"))


def _layout(file) -> tuple[int, int, int, int, int, int]:
    """(code, channels, rate, bits, start of data, bytes of data)."""
    total = file.size()
    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, wide = 12, None, {}
    while at + 8 <= total:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if size == IN_TABLE:
            size = wide.get(name, size)
        if name == b"ds64":
            _, data, _, others = struct.unpack("<QQQI", file.read(28))
            wide = dict(struct.unpack("<4sQ", file.read(12)) for _ in range(others))
            wide[b"data"] = data
        elif name == b"fmt ":
            body = file.read(size)
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE:
                code = struct.unpack("<H", body[24:26])[0]
            form = (code, channels, rate, bits)
        elif name == b"data":
            if form is None:
                raise ValueError("WAV data before its format")
            return (*form, at + 8, min(size, total - at - 8))
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def _decode(raw: bytes, code: int, bits: int) -> np.ndarray:
    """Samples as doubles; whole numbers are scaled to [-1, 1)."""
    if code == FLOAT:
        return np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype("f8")
    if code != PCM:
        raise ValueError(f"WAV code {code} is compressed; only PCM and float can be read")
    if bits == 8:
        return (np.frombuffer(raw, "u1").astype("f8") - 128.0) / 128.0
    if bits == 24:
        parts = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
        values = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8
        return (values >> 8).astype("f8") / float(1 << 23)
    return np.frombuffer(raw, f"<i{bits // 8}").astype("f8") / float(1 << (bits - 1))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch["path"].to_pylist():
            system, name = locate(path)
            with system.open_input_file(name) as file:
                found.append(_layout(file))
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(LAYOUT))]
        yield pa.record_batch([batch["path"], *columns], names=["path", *LAYOUT])


def _reader(piece_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, piece = row["path"], row["piece"]
                code, channels, rate, bits, start, size = (row[name] for name in LAYOUT)
                width = channels * bits // 8
                # a frame belongs to the piece that holds its first byte
                first = -(-piece * piece_bytes // width)
                last = min(-(-(piece + 1) * piece_bytes // width), size // width)
                count = last - first
                if count <= 0:
                    continue
                system, name = locate(path)
                with system.open_input_file(name) as file:
                    file.seek(start + first * width)
                    raw = file.read(count * width)
                mono = _decode(raw, code, bits).reshape(-1, channels).mean(axis=1)
                values = pa.ListArray.from_arrays(
                    pa.array([0, len(mono)], pa.int32()), pa.array(mono))
                yield pa.record_batch(
                    [pa.array([path]), pa.array([rate], pa.int32()),
                     pa.array([channels], pa.int32()), pa.array([first], pa.int64()), values],
                    schema=_ARROW)
    return read


def read_wav(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """path, sample_rate, channels, first, values: pieces of mono samples from sample `first`."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]")
             .option("recursiveFileLookup", "true").load(path).select("path"))
    headers = files.repartition("path").mapInArrow(_headers, HEADER)
    last = whole(F.greatest(F.col("size") - 1, F.lit(0)), piece_bytes)
    pieces = (explode_range(headers, F.lit(0).cast("bigint"), last, "piece")
              .repartition("path", "piece"))
    return pieces.mapInArrow(_reader(piece_bytes), PIECES)


def wav_samples(pieces: DataFrame, session: Column, track: Column) -> DataFrame:
    """Samples of WAV pieces at the rates of their files: session_id, track, idx, x, sample_rate.

    `session` and `track` are made from the path. `ingest` brings them to one rate.
    """
    return (pieces.select(session.cast("bigint").alias("session_id"),
                          track.cast("int").alias("track"), "first", "sample_rate",
                          F.posexplode("values").alias("place", "x"))
            .select(*TRACK_KEYS, (F.col("first") + F.col("place")).alias("idx"), "x",
                    "sample_rate"))
