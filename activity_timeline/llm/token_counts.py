"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A change row inserts a document, deletes it, or revises its count; it carries
the sign of what it adds. Changes of a batch are summed per source, language
and version, and the sums are written as one commit of that batch. A batch that
is committed already is not taken again, and a half-written one (without its
success marker, which Spark's file committer writes last) does not count and is
overwritten, so a batch may be delivered any number of times. Totals are the
sums of all commits, which have a row per group each, whatever the batch held.
Names of batches are made of letters, digits, `_`, `-` and `.`.

Sums do not depend on the order of rows or batches. Null texts count as empty.
Null sources and languages are groups of their own. Rows without doc_id and
repeated rows count like any rows. An empty batch is a commit of no rows. A
rollup without commits has no totals.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, matching, resident
from activity_timeline.llm.words import slices

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
COMMIT = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint," \
         " n_bytes bigint"
# fixed value: the pattern that goes with the byte-level vocabulary
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _tokenizer(name: str):
    return resident(("ranks", name), lambda: _read_ranks(name))


def _read_ranks(name: str):
    import base64

    import tiktoken
    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, ranks_file: str) -> DataFrame:
    """source, lang, n_tokens, n_bytes of every document."""
    docs.sparkSession.sparkContext.addFile(ranks_file)
    name = ranks_file.rsplit("/", 1)[-1]

    def run(batches):
        encode = _tokenizer(name).encode_ordinary
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
                yield pa.record_batch(
                    [batch.column("source"), batch.column("lang"), pa.array(counts, pa.int64()),
                     batch.column("n_bytes")], names=["source", "lang", "n_tokens", "n_bytes"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return in_tasks(docs.select("source", "lang", "text", size.alias("n_bytes")), run,
                    "source string, lang string, n_tokens bigint, n_bytes bigint")


def estimated(docs: DataFrame) -> DataFrame:
    """A first count without a tokenizer: a token for every four bytes, rounded up."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select("source", "lang", F.ceil(size / 4).cast("bigint").alias("n_tokens"),
                       size.alias("n_bytes"))


def inserts(counts: DataFrame, tokenizer: str) -> DataFrame:
    return _signed(counts, tokenizer, 1)


def deletes(counts: DataFrame, tokenizer: str) -> DataFrame:
    return _signed(counts, tokenizer, -1)


def revisions(old: DataFrame, old_tokenizer: str, new: DataFrame, new_tokenizer: str) -> DataFrame:
    """Counts of the same documents replaced by others."""
    return deletes(old, old_tokenizer).unionByName(inserts(new, new_tokenizer))


def _signed(counts: DataFrame, tokenizer: str, sign: int) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"),
                         F.lit(sign).cast("bigint").alias("n_docs"),
                         *[(F.col(c) * sign).alias(c) for c in SUMS[1:]])


class Rollup:
    """Commits of token counts below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """Names of the batches that are committed."""
        marks = matching(self.spark, f"{self.path}/batch=*/_SUCCESS")
        return [mark.rsplit("/", 2)[-2].removeprefix("batch=") for mark in marks]

    def committed(self, batch: str) -> bool:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"no name for a batch: {batch!r}")
        return bool(matching(self.spark, f"{self.path}/batch={batch}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Take a batch of signed rows; False if it was taken before."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer with documents, tokens and bytes; groups without any are left out."""
        folders = [f"{self.path}/batch={batch}" for batch in self.batches()]
        commits = (self.spark.read.schema(COMMIT).parquet(*folders) if folders
                   else self.spark.createDataFrame([], COMMIT))
        return (commits.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
                .where("n_docs <> 0 OR n_tokens <> 0 OR n_bytes <> 0"))
