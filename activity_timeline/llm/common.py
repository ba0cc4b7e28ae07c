"""What several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline.operators.slices import scratch_path

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000
SPACES = " \t\n\x0b\f\r"
KEY_BITS = 1 << 24      # bits of the filter of row keys (2 MB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _archive() -> str:
    """The package's code as a zip file."""
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "activity_timeline_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    return str(target)


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, as spark-submit --py-files would.

    Rows hold whole texts, so the session's Arrow batches are made smaller if they are larger
    than BATCH_ROWS.
    """
    spark.sparkContext.addPyFile(_archive())
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


_RESIDENT: dict = {}


def resident(name, make):
    """What a worker process keeps between tasks; only the latest operator's things are kept."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def in_tasks(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order of name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(found.getPath().toString() for found in system.globStatus(path) or [])


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row: equal for repeated rows, never null."""
    return F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.col(doc_id).isNull(),
                      text_or_empty(text))


def _key_bits(keys: DataFrame, n_bits: int) -> np.ndarray:
    """A bit for each row_key, which is a hash; at most n_bits / 8 numbers reach the driver."""
    bit = F.col("row_key").bitwiseAND(F.lit(n_bits - 1))
    cells = (keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("cell"))
             .agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS INT)))").alias("bits")))
    out = np.zeros(max(1, n_bits // 8), np.uint8)
    for cell, bits in cells.toLocalIterator():
        out[cell] = bits
    return out


def without_keys(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `keyed` whose row_key is not in `gone`, which is read twice.

    A bitmap of fixed size clears most rows where they are; the others, those of `gone` and
    those that share a bit with one, are all that the exact anti-join shuffles.
    """
    n_bits = KEY_BITS
    bits = _key_bits(gone, n_bits)

    @F.pandas_udf("boolean")
    def listed(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy().astype(np.int64) & (n_bits - 1)
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0)

    marked = keyed.withColumn("_listed", listed("row_key"))
    clear = marked.where(~F.col("_listed")).drop("_listed")
    rest = marked.where("_listed").drop("_listed")
    return clear.unionByName(rest.join(gone, "row_key", "left_anti"))
