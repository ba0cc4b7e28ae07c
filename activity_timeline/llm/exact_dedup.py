"""Exact dedup against a persistent digest index.

The index is a Parquet table of one row per distinct text, bucketed and sorted
by digest. A new delivery is reduced to one row per digest, anti-joined with
the index by sort-merge join (the bucketed side is neither shuffled nor sorted
again), and what is new is appended. Every row then looks its keeper up.

Deliveries must come in ascending order of doc_id if the smallest doc_id of
all shall be the keeper; within a delivery any order will do.

Null texts count as empty. Rows without doc_id take part; they are keepers only
of texts that no row with a doc_id has, and then keep_id is null. A row given
twice counts twice in group_size, and both copies say kept. Further columns of
the documents are left alone. An empty delivery changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline.llm.common import stored, text_or_empty

BUCKETS = 64


def normalized(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select("doc_id", F.sha2(normalized(), 256).alias("digest"))


class DigestIndex:
    """Digests seen so far with their keepers, in `path`, under a name of the catalog."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        """Open the index in `path`, or begin one there."""
        self.spark, self.name = spark, name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT)"
                  f" USING parquet CLUSTERED BY (digest) SORTED BY (digest)"
                  f" INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of `batch` (doc_id, digest) that the index does not have."""
        firsts = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        fresh = firsts.join(self.table().hint("merge"), "digest", "left_anti")
        # rows of a bucket are together already; written sorted, one file for each task and bucket
        fresh.write.insertInto(self.name)

    def keepers(self, batch: DataFrame) -> DataFrame:
        """Every row of `batch` with the keeper of its text and the size of its group in the batch.

        Only groups of more than one row are joined by digest; a digest that a third of the
        rows share is a row of the small side, and the large side can be split by Spark.
        """
        groups = batch.groupBy("digest").agg(F.count("*").alias("group_size"))
        known = groups.join(self.table().hint("merge"), "digest")
        return (batch.join(known, "digest", "left")
                .select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("digest").alias("text_sha256")))


def deliver(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """Take one delivery into the index; its digests (written once) for `keepers`."""
    batch = stored(digests(docs), "digests")
    index.add(batch)
    return batch


def exact_dedup(docs: DataFrame, index: DigestIndex, parts: list[DataFrame]) -> DataFrame:
    """Deliver `parts` in turn, which together are `docs`; one row per document."""
    batches = [deliver(index, part) for part in parts]
    everything = batches[0]
    for batch in batches[1:]:
        everything = everything.unionByName(batch)
    return index.keepers(everything)
