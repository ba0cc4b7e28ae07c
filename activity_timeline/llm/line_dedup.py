"""Line dedup: lines that many documents share stay only in the last of them.

Lines are hashed (128 bits) and range partitioned by hash and document, with a
secondary sort by document (descending) and position. Each task streams its
rows once: the first document of a run is the one that keeps the line. A hash
that is very frequent covers several partitions; then each of them reports one
row for the run it begins or ends with, and those reports (two per partition at
most) are added up and sent to all tasks. The answer is a compressed keep bitmap
per document, not text.

A null or empty text is one empty line. Rows without doc_id count together as
one document below all others. Repeated rows get the same answer. An empty
table gives no rows. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import SPACES, in_tasks, row_key, ship, stored, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STREAMED = ("kind string, row_key bigint, pos int, h1 bigint, h2 bigint, doc bigint,"
            " n_docs bigint")
_STREAMED = pa.schema([("kind", pa.string()), ("row_key", pa.int64()), ("pos", pa.int32()),
                       ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()),
                       ("n_docs", pa.int64())])


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Long enough lines: hash, document, row, position."""
    doc = F.coalesce(F.col("doc_id"), F.lit(-2**63))
    split = docs.select(doc.alias("doc"), row_key().alias("row_key"),
                        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    keyed = split.withColumn("line", F.translate(F.btrim("line", F.lit(SPACES)), UPPER,
                                                 UPPER.lower()))
    return keyed.where(F.char_length("line") >= min_chars).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
        "doc", "row_key", "pos")


def _stream(min_docs: int):
    def run(batches):
        """Rows sorted by hash, document descending: those to drop, and what is left open.

        Held back is at most the rows of two documents of the run in hand (until
        `min_docs` documents are seen), and of the first run, which may have begun
        in the partition before, every row is passed on as open.
        """
        state = _Runs(min_docs)
        for batch in batches:
            if batch.num_rows:
                yield from state.take(batch)
        yield from state.close()
    return run


class _Runs:
    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.first = True        # in the first run of the partition
        self.key = None          # hash in hand
        self.top = None          # its first document
        self.last = None         # its latest document
        self.n_docs = 0
        self.held: list = []     # its rows that may yet be dropped

    def take(self, batch):
        h1, h2, doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False)
                                 for i in (batch.schema.get_field_index(n)
                                           for n in ("h1", "h2", "doc", "row_key", "pos")))
        new = np.empty(len(h1), bool)
        new[0] = self.key != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        cuts = np.flatnonzero(new)
        bounds = np.unique(np.concatenate([[0], cuts, [len(h1)]]))
        # inside a batch, a run of fewer rows than min_docs has nothing to drop
        long = np.flatnonzero(np.diff(bounds) >= self.min_docs)
        for i in np.unique(np.concatenate([[0], long, [len(bounds) - 2]])):
            a, b = bounds[i], bounds[i + 1]
            if new[a]:
                yield from self._finish(False)
                self.key, self.top, self.last = (h1[a], h2[a]), doc[a], None
                self.n_docs, self.held = 0, []
            d = doc[a:b]
            changes = int((d[1:] != d[:-1]).sum()) + (self.last is None or d[0] != self.last)
            self.n_docs += int(changes)
            self.last = d[-1]
            if self.first:
                # this run may have begun in the partition before, with a larger document
                yield self._rows("open", row[a:b], pos[a:b], d)
                continue
            late = d != self.top
            if late.any():
                self.held.append((row[a:b][late], pos[a:b][late], d[late]))
            if self.n_docs >= self.min_docs:
                yield from self._release("drop")

    def _release(self, kind: str):
        for row, pos, d in self.held:
            yield self._rows(kind, row, pos, d)
        self.held = []

    def _rows(self, kind, row, pos, d):
        n = len(row)
        return pa.record_batch(
            [pa.array([kind] * n), pa.array(row), pa.array(pos.astype(np.int32)),
             pa.array(np.full(n, self.key[0])), pa.array(np.full(n, self.key[1])), pa.array(d),
             pa.nulls(n, pa.int64())], schema=_STREAMED)

    def _finish(self, at_end: bool):
        """The end of a run; the first and the last of a partition are reported."""
        if self.key is None:
            return
        if at_end and not self.first:
            yield from self._release("open")
        if self.first or at_end:
            yield pa.record_batch(
                [pa.array(["run"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                 pa.array([self.key[0]]), pa.array([self.key[1]]), pa.array([self.top]),
                 pa.array([self.n_docs])], schema=_STREAMED)
        self.first = False

    def close(self):
        yield from self._finish(True)


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """row_key, pos of the lines to drop."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (lines(docs, min_chars)
               .repartitionByRange(parts, "h1", "h2", F.desc("doc"))
               .sortWithinPartitions("h1", "h2", F.desc("doc"), "row_key", "pos"))
    streamed = stored(in_tasks(ordered, _stream(min_docs), STREAMED), "lines")
    shared = (streamed.where("kind = 'run'").groupBy("h1", "h2")
              .agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("top"))
              .where(F.col("docs") >= min_docs))
    # at most two rows per partition
    late = (streamed.where("kind = 'open'").select("row_key", "pos", "h1", "h2", "doc")
            .join(F.broadcast(shared), ["h1", "h2"]).where(F.col("doc") < F.col("top")))
    return (streamed.where("kind = 'drop'").select("row_key", "pos")
            .unionByName(late.select("row_key", "pos")))


def pack(dropped: np.ndarray) -> bytes:
    """Compressed keep bits up to the last dropped line; filled up with ones, as later lines stay."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[:len(bits)] = bits.astype(bool)
    return keep


def _bitmaps(batches):
    for batch in batches:
        packed = [pack(np.asarray(x)) for x in batch.column("lost").to_pylist()]
        yield pa.record_batch([batch.column("row_key"), pa.array(packed, pa.binary())],
                              names=["row_key", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """row_key, keep: bitmaps of the documents that lose lines."""
    lost = (dropped_lines(docs, min_chars, min_docs).groupBy("row_key")
            .agg(F.collect_set("pos").alias("lost")))
    return in_tasks(lost, _bitmaps, "row_key bigint, keep binary")


def cut_text(text: str | None, bitmap: bytes | None) -> tuple[str | None, int, int]:
    """The kept lines, the number of lines, the number of dropped ones."""
    if bitmap is None:
        return text, (text or "").count("\n") + 1, 0
    parts = text.split("\n")
    keep = unpack(bitmap, len(parts))
    return "\n".join(p for p, k in zip(parts, keep) if k), len(parts), int((~keep).sum())


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (all columns of the document), row_key, keep."""
    return (docs.select(row_key().alias("row_key"), F.struct("*").alias("row"))
            .join(bitmaps, "row_key", "left"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without the dropped lines, all columns as they were."""
    @F.pandas_udf("string")
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, k)[0] for t, k in zip(text, keep)], dtype=object)

    ship(docs.sparkSession)
    joined = _joined(docs, bitmaps)
    return joined.select(*[(kept("row.text", "keep") if c == "text" else F.col("row")[c]).alias(c)
                           for c in docs.columns])


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    def digest(batches):
        for batch in batches:
            cut = [cut_text(t, k) for t, k in zip(batch.column("text").to_pylist(),
                                                  batch.column("keep").to_pylist())]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([n for _, n, _ in cut], pa.int64()),
                 pa.array([n for _, _, n in cut], pa.int64()),
                 pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t, _, _ in cut],
                          pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select("doc_id", "text")
    return in_tasks(_joined(slim, bitmaps).select("row.doc_id", "row.text", "keep"),
                    digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
