"""The pipeline's stages against plain definitions on the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests_llm_truth import jaccard_truth, line_truth

from activity_timeline.llm import common
from activity_timeline.llm.common import stored, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        results[name] = docs
    for name in list(results)[:-1]:
        assert results[name].columns == columns
    known = {r["doc_id"]: r["text"] for r in results["language_id"].collect()}
    lines = {r["doc_id"]: r["text"] for r in results["line_dedup"].collect()}
    assert lines.keys() == known.keys()
    want = line_truth(list(known.items()))
    assert all(n - lost == 0 or lines[i].count("\n") + 1 == n - lost for i, n, lost, _ in want)
    near = {r["doc_id"] for r in results["near_duplicates"].collect()}
    truth = jaccard_truth(list(lines.items()), 5, 80)
    assert near == {i for i, _, root in truth if i == root}
    clean = {r["doc_id"]: r["text"] for r in results["decontaminate"].collect()}
    items = [" ".join(r["text"].lower().split())
             for r in table(spark, sf_dir, "benchmark").collect()]
    holds = {i for i in near if any(x in " ".join(lines[i].lower().split()) for x in items)}
    assert clean.keys() == near - holds
    assert {r["doc_id"] for r in docs.collect()} == clean.keys()
    assert docs.where("NOT restored").count() == 0


@pytest.mark.parametrize("n_bits", [8, common.KEY_BITS])
def test_rows_without_the_keys(spark, monkeypatch, n_bits):
    """Also when the bitmap lists nearly every row."""
    monkeypatch.setattr(common, "KEY_BITS", n_bits)
    keyed = spark.range(2_000).select(F.xxhash64("id").alias("row_key"), "id")
    for step in (100, 5_000):
        gone = keyed.where(F.col("id") % step == 1).select("row_key")
        got = [r["id"] for r in common.without_keys(keyed, gone).collect()]
        assert sorted(got) == [i for i in range(2_000) if i % step != 1]
    assert common.without_keys(keyed, keyed.limit(0).select("row_key")).count() == 2_000


def test_kept_documents_are_not_shuffled(spark, sf_dir):
    """Texts that stay go by no exchange, even where no side of a join may be broadcast."""
    docs = table(spark, sf_dir, "documents")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.near_stage, corpus_pipeline.benchmark_stage):
            plan = stage(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
            first = plan.split("Union", 1)[-1].split("SortMergeJoin", 1)[0]
            assert "Union" in plan and "Exchange" not in first and "Scan parquet" in first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
