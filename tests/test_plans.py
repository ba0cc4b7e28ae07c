"""The physical plans the operators are written for."""

import re

import pytest
from pyspark.sql import functions as F

from activity_timeline import Params, export
from activity_timeline.operators.frames import pane_energy
from activity_timeline.operators.segment_slices import clean_in_slices
from activity_timeline.operators.segments import CUT, segment_states
from activity_timeline.operators.signal import session_duration
from activity_timeline.operators.timelines import (
    EVENTS, HEAD, SEGMENTS, Timelines, from_document, to_document)
from activity_timeline.plans import analyze as chain
from activity_timeline.sources.documents import read_documents, write_documents
from activity_timeline.sources.tables import samples_from


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Indexed samples on disk, loud and quiet in turn."""
    path = str(tmp_path_factory.mktemp("samples") / "s")
    loud = F.when(F.col("id") % 200_000 < 100_000, 0.5).otherwise(0.001)
    (spark.range(600_000).select(
        F.lit(0).cast("bigint").alias("session_id"), (F.col("id") % 2).cast("int").alias("track"),
        F.expr("id div 2").alias("idx"), (F.rand(1) * loud).alias("x"), F.lit("u").alias("unused"))
     .write.parquet(path))
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


def test_unindexed_samples_to_segments_take_one_exchange(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = samples_from(events, F.col("user_id"), F.lit(0), ["ts", "event_id"], F.col("value"))
    text = plan(chain.segments(samples, Params(sample_rate=100), None))
    assert text.count("Exchange hashpartitioning") == 1
    # one for numbering, one for frames, one for the few cuts
    assert len(re.findall(r"\bSort \[", text)) == 3
    assert "Python" not in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_stored_samples_are_added_up_before_the_shuffle(stored):
    text = plan(chain.paired_frames(stored, Params(), None))
    assert text.count("Exchange hashpartitioning") == 2
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_sum" in below and "unused" not in below


def test_uneven_sizes_shuffle_two_rows_per_hop(stored):
    """661 and 220 samples at 22,050 Hz have no common divisor."""
    p = Params(sample_rate=22050)
    assert pane_energy(stored, p).count() == 2 * 2 * (300_000 // 220) + 2 * 2
    text = plan(chain.paired_frames(stored, p, None))
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_sum" in below and "REPARTITION" not in text


def test_slices_share_one_shuffle_of_the_frames(stored):
    text = final(chain.paired_frames(stored, Params(), 900))
    assert text.count("ReusedExchange") == 1
    assert text.count("FileScan") == 1


def test_small_panes_go_straight_to_their_slice(stored):
    text = final(chain.paired_frames(stored, Params(sample_rate=100), 900))
    assert text.count("ReusedExchange") == 1
    big = [line for line in text.splitlines() if "Exchange hashpartitioning" in line
           and "slice" in line and "REPARTITION" in line and "Reused" not in line]
    assert len(big) == 1 and "_groupingexpression" not in text


def test_sliced_and_whole_frames_are_the_same(stored):
    def rows(block):
        return sorted((r.frame, r.is_active_0, r.is_active_1, round(r.envelope_db_0, 9))
                      for r in chain.paired_frames(stored, Params(), block).collect())
    whole = rows(None)
    assert whole == rows(900) and len(whole) == 1873
    assert {r[1] for r in whole} == {True, False}


def test_session_filters_reach_the_scan(stored):
    text = plan(chain.segments(stored, Params(), None).where("session_id = 5"))
    assert "EqualTo(session_id,5)" in text


def test_durations_do_not_number_samples(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = samples_from(events, F.col("user_id"), F.lit(0), ["ts", "event_id"], F.col("value"))
    assert "Window" not in plan(session_duration(samples, 100))


@pytest.mark.parametrize("rate", [16000, 100])
def test_timelines_read_the_samples_once(stored, rate):
    """Heads, segments and events of one query share the shuffle of the panes or samples."""
    made = chain.analyze(stored, None, Params(sample_rate=rate, ducking_enabled=True), block=None)
    text = final(to_document(made))
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") >= 2


def test_stored_panes_replace_the_samples(stored, tmp_path):
    p = Params(ducking_enabled=True)
    made = chain.analyze(stored, None, p, block=None, store=f"{tmp_path}/panes")
    for relation in made:
        files = set(relation.inputFiles())
        assert files and all("/panes/" in f for f in files)


def test_segment_chain_sorts_once(spark):
    states = spark.createDataFrame([], "session_id long, frame long, speaker_state string")
    text = plan(segment_states(states.repartition("session_id"), Params()))
    assert len(re.findall(r"\bSort \[", text)) <= 2


def test_cuts_in_slices_are_cleaned_without_a_job(spark, tmp_path):
    """Nothing is written between the steps; the cuts are shuffled once for both branches."""
    spark.range(3000).selectExpr(
        "id % 2 AS session_id", "id div 2 AS pos", "(id div 2) / 10.0D AS start_s",
        "CASE WHEN id > 1 THEN (id div 2) / 10.0D END AS before_end_s", "150.0D AS last_end_s",
        "0 AS camera_index", "CASE WHEN rand(1) < 0.5 THEN 'both' ELSE 'silence' END"
        " AS speaker_state", "'x' AS speaker_label").write.parquet(f"{tmp_path}/cuts")
    cuts = spark.read.parquet(f"{tmp_path}/cuts").select(*CUT)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    df = clean_in_slices(cuts, 0.05, 0.2, 64)
    assert len(tracker.getJobIdsForGroup()) == before
    text = plan(df)
    assert "Scan ExistingRDD" not in text and "rangepartitioning" not in text
    # the cuts for either branch and one row per slice; adaptive execution runs the first two once
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 4
    assert df.count() > 1


def test_each_relation_reads_its_own_section(spark, tmp_path):
    """Only the files of a relation's section are opened; no file holds two sections."""
    made = Timelines(
        spark.range(4).selectExpr("id AS session_id", "60.0D AS total_duration_s", "30.0D AS fps"),
        spark.range(800).selectExpr(
            "id % 4 AS session_id", "id div 4 AS seg_idx", "0.0D AS start_s", "1.0D AS end_s",
            "0 AS camera_index", "'both' AS speaker_state", "'x' AS speaker_label"),
        spark.range(1600).selectExpr("id % 4 AS session_id", "id div 4 AS place", "0.0D AS time_s",
                                     "-3.0D AS target_db", "0 AS track_index"))
    path = f"{tmp_path}/pieces"
    write_documents(to_document(made), path)
    back = from_document(read_documents(spark, path))
    for section, got, want in zip((HEAD, SEGMENTS, EVENTS), back, made):
        columns = sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(
            map(tuple, want.select(columns).collect()))
        text = plan(got)
        assert text.count("FileScan") == 1
        assert re.search(r"PartitionFilters: \[[^]]*section#\d+ >= %d" % section, text)
    pruned = read_documents(spark, path).where(f"section between {SEGMENTS} and {SEGMENTS}")
    assert pruned.select(F.input_file_name().alias("f")).distinct().where(
        f"f NOT LIKE '%section={SEGMENTS}/%'").count() == 0


def test_export_reads_each_relation_once_and_shuffles_once(spark, tmp_path):
    """No job runs while the plan is made."""
    made = {
        "heads": "id AS session_id, 60.0D AS total_duration_s, 30.0D AS fps",
        "segments": "id AS session_id, 0L AS seg_idx, 0.0D AS start_s, 60.0D AS end_s,"
                    " 0 AS camera_index, 'both' AS speaker_state, 'x' AS speaker_label",
        "events": "id AS session_id, 0L AS place, 0.0D AS time_s, -3.0D AS target_db,"
                  " 0 AS track_index",
        "cameras": "id AS session_id, 0 AS camera_index, '/c.mp4' AS path",
        "tracks": "id div 2 AS session_id, cast(id % 2 AS int) AS track, '/m.wav' AS path"}
    for name, columns in made.items():
        spark.range(40).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in made}
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    df = export(Timelines(read["heads"], read["segments"], read["events"]),
                read["cameras"], read["tracks"])
    assert len(tracker.getJobIdsForGroup()) == before
    text = plan(df)
    assert text.count("FileScan") == 5
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert df.count() == 20 * 13 + 20 * 4
