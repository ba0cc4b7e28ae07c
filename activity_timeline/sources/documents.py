"""Datasets of timelines, documents and relations."""

from __future__ import annotations

import uuid
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_timeline.operators.timelines import (
    LINE_KEYS, Timelines, check_timelines, from_whole_documents)
from activity_timeline.schemas import DOCUMENT, GAIN_EVENT, SEGMENT, SESSION
from activity_timeline.sources.wav import locate

_KEY = T.StructField(SESSION, T.LongType())
_LINES = T.StructType([
    _KEY, T.StructField("place", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("section", T.IntegerType())])
LAYOUT = {
    "heads": T.StructType([_KEY, DOCUMENT["total_duration_s"], DOCUMENT["fps"]]),
    "segments": T.StructType([_KEY, T.StructField("seg_idx", T.LongType()), *SEGMENT.fields]),
    "events": T.StructType([_KEY, T.StructField("place", T.LongType()), *GAIN_EVENT.fields]),
}


def read_timeline_files(spark: SparkSession, path: str, session: Column | None = None) -> Timelines:
    """Timelines from JSON files in any layout, one document per file and one file per session.

    The session is a number in the file name unless `session` says otherwise. A
    file is read as one text by one task, so it must be shorter than 2 GB and fit an
    executor: this is for ordinary sessions. Documents of any length are written by
    write_documents, and from_document takes the pieces that are read back.
    """
    if session is None:
        name = F.col("_metadata.file_name")
        session = F.when(name.rlike(r"\d"), F.regexp_extract(name, r"(\d+)", 1)).otherwise(
            F.raise_error(F.concat(F.lit("no session number in the file name "), name)))
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return from_whole_documents(read.select(session.cast("bigint").alias(SESSION),
                                            F.col("value").alias("json")))


def write_timelines(timelines: Timelines, path: str) -> None:
    """The three relations as JSON lines in folders below `path`; nulls are written, too.

    Rows are dealt by ranges of their keys, so a long session takes several files.
    """
    for name, schema in LAYOUT.items():
        df = getattr(timelines, name).select(*schema.fieldNames())
        keys = [c for c in (SESSION, "seg_idx", "place") if c in df.columns]
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
         .write.option("ignoreNullFields", "false").json(f"{path}/{name}"))


def read_timelines(spark: SparkSession, path: str) -> Timelines:
    """Timelines written by write_timelines."""
    return check_timelines(Timelines(**{
        name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
        for name, schema in LAYOUT.items()}))


def write_documents(lines: DataFrame, path: str) -> None:
    """Documents piece by piece, a folder per section; inside, in order across the files.

    Rows are dealt by ranges of their keys, so a long session takes several files. A reader
    of one section (from_document reads three) opens the files of that section alone.
    """
    keys = ["section", SESSION, "place"]
    (lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.partitionBy("section").parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The pieces that write_documents wrote: session_id, section, place, text."""
    return spark.read.schema(_LINES).parquet(path).select(*LINE_KEYS, "text")


def write_document_files(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """One text file per session, in a folder bucket=.../session_id=... of its own.

    A file is written from its start to its end, so the pieces of a session stream
    through one task; sorting them may spill. No task holds a document. Sessions are
    dealt over the buckets, each written by a task and, on reading, listed by a task:
    with a file per session the files are the work, however few bytes they hold, so
    none of it may be left to one task or to the driver (Spark's own writer makes the
    driver move them one by one). A file is written under a hidden name and appears
    whole, and _SUCCESS follows the last one.
    """
    system, root = locate(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    bucket = F.pmod(F.xxhash64(SESSION), F.lit(buckets)).cast("int")
    placed = (lines.withColumn("bucket", bucket).repartition(buckets, "bucket")
              .sortWithinPartitions("bucket", *LINE_KEYS).select("bucket", SESSION, "text"))
    placed.mapInArrow(_file_writer(system, root), "files bigint").agg(F.sum("files")).collect()
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass


def _file_writer(system: fs.FileSystem, root: str):
    """Writes rows in the order of their sessions; a session may go on in the next batch."""
    def publish(hidden: str, name: str) -> None:
        if system.get_file_info(name).type == fs.FileType.NotFound:
            system.move(hidden, name)
        else:  # by another attempt of this task
            system.delete_file(hidden)

    def run(batches):
        current, out, files = None, None, 0
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            for key, pieces in groupby(rows, lambda row: row[:2]):
                if out is None or key != current:
                    if out is not None:
                        out.close()
                        publish(hidden, name)
                    session = "__HIVE_DEFAULT_PARTITION__" if key[1] is None else key[1]
                    folder = f"{root}/bucket={key[0]}/session_id={session}"
                    system.create_dir(folder, recursive=True)
                    name, hidden = f"{folder}/document.txt", f"{folder}/_{uuid.uuid4().hex}"
                    out, current, files = system.open_output_stream(hidden), key, files + 1
                out.write("".join(f"{text or ''}\n" for *_, text in pieces).encode())
        if out is not None:
            out.close()
            publish(hidden, name)
        yield pa.record_batch([pa.array([files], pa.int64())], names=["files"])
    return run


def write_relation(df: DataFrame, path: str, buckets: int = 64, format: str = "parquet",
                   **options: str) -> None:
    """Any relation with a session_id, in bucket folders.

    The rebalance hint lets Spark split a bucket that holds a hot session and
    join small ones, by the sizes it measures.
    """
    (df.withColumn("bucket", F.pmod(F.xxhash64(SESSION), F.lit(buckets)).cast("int"))
       .hint("rebalance", "bucket")
       .write.partitionBy("bucket").format(format).options(**options).save(path))
