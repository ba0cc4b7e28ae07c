"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; `run` writes
every result to the shared folder as Parquet and hands the reread table on.

1. language_id: documents without a letter, or less like their language than
   its own texts are (see keep_known), go; `lang` becomes the predicted language.
2. line_dedup: lines that three documents or more share stay in one of them; `n_chars` follows.
3. near_duplicates: of documents linked by five-word n-grams (similarity 0.8 or
   more) the one with the smallest doc_id stays, or one of those without.
4. decontaminate: documents that hold a benchmark item go.
5. sentencepiece: token ids, and whether decoding gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_timeline.llm import (
    decontaminate, language_id, line_dedup, ngram_jaccard, sentencepiece_matching)
from activity_timeline.llm.common import stored, table
from activity_timeline.llm.queries import PIECES

NEAR = ngram_jaccard.Similarity(words=5, percent=80)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    if "n_chars" not in docs.columns:
        return kept
    return kept.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c)
                         if c == "n_chars" else c for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs, NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_matching.encode(docs, PIECES)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage),
          ("near_duplicates", near_stage), ("decontaminate", benchmark_stage),
          ("sentencepiece", token_stage)]

# hypervectors and piece matching are not for SQL; tests compare run() with plain code
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
