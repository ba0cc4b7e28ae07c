"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm import (
    decontaminate, exact_dedup, filter_audit, language_id, line_dedup, ngram_jaccard, secrets,
    sentencepiece_matching, sharding, substring_dedup, tensored_minhash, token_counts, whitening)
from activity_timeline.llm.common import table
from activity_timeline.operators.slices import scratch_path

SHARDS = 24
TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs))


def op3_exact_dedup(spark, sf_dir):
    """Two deliveries in order of doc_id into a new index."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    first = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    path = scratch_path(spark, "digest-index")
    index = exact_dedup.DigestIndex(spark, "digests_" + path.rsplit("-", 1)[1], path)
    return exact_dedup.exact_dedup(docs, index, [docs.where(first), docs.where(~first)])


def op4_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shard(docs, scratch_path(spark, "slot-map"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_matching.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents")).drop("row_key")


def op10_token_counts(spark, sf_dir):
    """Estimates of all documents, revised by a tokenizer's counts; the revision is given twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token-counts"))
    rollup.commit("estimates", token_counts.inserts(token_counts.estimated(docs), "bytes-v0"))
    revised = token_counts.revisions(
        token_counts.estimated(docs), "bytes-v0",
        token_counts.counted(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), "byte-bpe-50k-v1")
    for _ in range(2):
        rollup.commit("revision", revised)
    return rollup.totals()


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_minhash_dedup(spark, sf_dir):
    return tensored_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {q.__name__: q for q in (
        op1_decontaminate, op2_line_dedup, op3_exact_dedup, op4_sharding, op5_secrets,
        op6_language_id, op7_sentencepiece, op8_substring_dedup,
        op9_ngram_jaccard, op10_token_counts, op11_filter_audit, op12_minhash_dedup,
        op13_whitening)}
