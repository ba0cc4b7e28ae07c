import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from activity_timeline.sources import wav


def write(path, code, bits, channels, data, extra=b"", extensible=False):
    width = channels * bits // 8
    tag = wav.EXTENSIBLE if extensible else code
    fmt = struct.pack("<HHIIHH", tag, channels, 8000, 8000 * width, width, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", code) + b"\0" * 14
    chunks = extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)


def test_every_format_is_read_piece_by_piece(spark, tmp_path):
    rnd = np.random.default_rng(1)
    want = {}

    def keep(number, values, channels):
        want[number] = values.reshape(-1, channels).mean(axis=1)

    raw = rnd.integers(-32768, 32767, 2 * 333).astype("<i2")
    write(tmp_path / "1.wav", wav.PCM, 16, 2, raw.tobytes(),
          extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    keep(1, raw / 32768.0, 2)
    raw = rnd.integers(0, 255, 501).astype("u1")
    write(tmp_path / "2.WAV", wav.PCM, 8, 1, raw.tobytes())
    keep(2, (raw.astype("f8") - 128) / 128, 1)
    raw = rnd.integers(-(1 << 23), (1 << 23) - 1, 3 * 100)
    write(tmp_path / "3.wav", wav.PCM, 24, 3,
          b"".join(int(v).to_bytes(3, "little", signed=True) for v in raw), extensible=True)
    keep(3, raw / float(1 << 23), 3)
    raw = rnd.integers(-(1 << 31), (1 << 31) - 1, 64).astype("<i4")
    write(tmp_path / "4.wav", wav.PCM, 32, 1, raw.tobytes())
    keep(4, raw / float(1 << 31), 1)
    raw = rnd.uniform(-1, 1, 90).astype("<f4")
    write(tmp_path / "5.wav", wav.FLOAT, 32, 1, raw.tobytes())
    keep(5, raw.astype("f8"), 1)
    write(tmp_path / "6.wav", wav.PCM, 16, 1, b"")

    pieces = wav.read_wav(spark, str(tmp_path), piece_bytes=100)
    assert pieces.where("path like '%1.wav'").count() > 5
    number = F.regexp_extract("path", r"(\d+)\.(?i:wav)$", 1)
    got = {}
    for r in wav.wav_samples(pieces, number, F.lit(0)).orderBy("session_id", "idx").collect():
        got.setdefault(r.session_id, []).append((r.idx, r.x))
    assert set(got) == {1, 2, 3, 4, 5}
    for n, line in got.items():
        assert [i for i, _ in line] == list(range(len(want[n])))
        assert np.allclose([x for _, x in line], want[n], atol=1e-15)
    assert {(r.sample_rate,) for r in pieces.select("sample_rate").collect()} == {(8000,)}


def wide_head(code, bits, channels, data_bytes):
    """The head of a file with 64-bit sizes, and a chunk whose size is in the table."""
    width = channels * bits // 8
    fmt = struct.pack("<HHIIHH", code, channels, 8000, 8000 * width, width, bits)
    table = struct.pack("<QQQI", 0, data_bytes, 0, 1) + struct.pack("<4sQ", b"note", 6)
    return (b"RF64" + struct.pack("<I", wav.IN_TABLE) + b"WAVE"
            + b"ds64" + struct.pack("<I", len(table)) + table
            + b"note" + struct.pack("<I", wav.IN_TABLE) + b"abcdef"
            + b"fmt " + struct.pack("<I", len(fmt)) + fmt
            + b"data" + struct.pack("<I", wav.IN_TABLE))


def test_wide_sizes_hold_the_same_samples(spark, tmp_path):
    raw = np.random.default_rng(2).integers(-32768, 32767, 2 * 401).astype("<i2").tobytes()
    for name in "ab":
        (tmp_path / name).mkdir()
    write(tmp_path / "a" / "1.wav", wav.PCM, 16, 2, raw)
    # what follows the data is not part of it
    (tmp_path / "b" / "1.wav").write_bytes(wide_head(wav.PCM, 16, 2, len(raw)) + raw + b"LIST\0\0")
    plain, wide = ([(r["first"], r["values"]) for r in wav.read_wav(
        spark, str(tmp_path / name), piece_bytes=300).orderBy("first").collect()] for name in "ab")
    assert plain == wide and sum(len(v) for _, v in wide) == 401


def test_header_of_five_gigabytes(tmp_path):
    """A sparse file: only its head takes room on the disk."""
    size, head = 5 << 30, wide_head(wav.PCM, 16, 1, 5 << 30)
    with open(tmp_path / "5.wav", "wb") as out:
        out.write(head)
        out.truncate(len(head) + size)
    system, name = wav.locate(str(tmp_path / "5.wav"))
    with system.open_input_file(name) as file:
        assert wav._layout(file) == (wav.PCM, 1, 8000, 16, len(head), size)
    # a piece beyond 4 GB, from its layout alone
    row = dict(zip(wav.LAYOUT, (wav.PCM, 1, 8000, 16, len(head), size)))
    batch = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "5.wav"), "piece": 5000, **row}])
    (made,) = wav._reader(1 << 20)(iter([batch]))
    assert made["first"].to_pylist() == [5000 << 19]
    assert len(made["values"][0]) == 1 << 19 and not any(made["values"][0].values.to_numpy())


def test_names_with_blanks_and_signs(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    write(folder / "50% é#1.wav", wav.PCM, 16, 1, b"\0\x40")
    assert [r["values"] for r in wav.read_wav(spark, str(tmp_path)).collect()] == [[0.5]]


@pytest.mark.parametrize("content", [b"ID3 no wave", b"RIFF\0\0\0\0WAVE"])
def test_other_files_fail(spark, tmp_path, content):
    (tmp_path / "9.wav").write_bytes(content)
    with pytest.raises(Exception, match="WAV"):
        wav.read_wav(spark, str(tmp_path)).collect()
