import random

import pytest
from pyspark.sql import functions as F

from activity_timeline.operators.slices import (
    BLOCK, RANGE_STEP, attach, choose_block, explode_range, number_in_order, scan)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for key, size in ((0, 120), (1, 1), (2, 30), (3, 31)):
        pos = 0
        for _ in range(size):
            pos += rnd.choice([1, 1, 2, 9])
            out.append((key, pos, rnd.randint(0, 9)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("block", [None, 1, 7, 50])
def test_scan_equals_a_walk_along_each_group(spark, rows, block):
    df = spark.createDataFrame(rows, "k long, pos long, v int")
    got = scan(df, ["k"], "pos", block, previous={"p": F.col("v"), "q": F.col("pos")},
               following={"n": F.col("v")}, sums={"s": F.col("v")}, whole_max={"m": F.col("v")})
    want = set()
    for key in {r[0] for r in rows}:
        line = sorted(r[1:] for r in rows if r[0] == key)
        for i, (pos, v) in enumerate(line):
            before = line[i - 1] if i else (None, None)
            after = line[i + 1][1] if i + 1 < len(line) else None
            want.add((key, pos, v, before[1], before[0], after, sum(x for _, x in line[:i]),
                      max(x for _, x in line)))
    assert {tuple(r) for r in got.select("k", "pos", "v", "p", "q", "n", "s", "m").collect()} == want


@pytest.mark.parametrize("block", [None, 5])
def test_numbering_with_a_hot_key_and_equal_first_columns(spark, block):
    rows = [(0 if i % 3 else i % 7, i % 4, i, "x") for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, a int, b int, text string")
    got = number_in_order(df, ["k"], ["a", "b"], "n", block, rows=20).collect()
    want = {}
    for k, a, b, _ in sorted(rows):
        want[(k, a, b)] = sum(1 for key in want if key[0] == k)
    assert {(r.k, r.a, r.b): r.n for r in got} == want
    assert len(got) == len(rows) and all(r.text == "x" for r in got)


def test_block_is_chosen_by_the_largest_group(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 9, "k long")
    assert choose_block(df, ["k"], limit=9) is None
    assert choose_block(df, ["k"], limit=8, block=4) == 4
    assert choose_block(df, ["k"], per=3, limit=3) is None
    assert choose_block(df, ["k"], per=2, limit=4, block=4) == 4
    assert choose_block(df.limit(0), ["k"]) is None


def test_ranges_are_whole(spark):
    rows = [(1, 0, 0), (2, 5, 4), (3, 7, 7 + 2 * RANGE_STEP), (4, 3, 2 + RANGE_STEP)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    got = (explode_range(df, F.col("a"), F.col("b"), "n").groupBy("k")
           .agg(F.min("n"), F.max("n"), F.count("*"), F.count_distinct("n")).collect())
    assert {tuple(r) for r in got} == {(k, a, b, b - a + 1, b - a + 1)
                                       for k, a, b in rows if a <= b}


@pytest.mark.parametrize("limit, hot", [(100, None), (0, None), (0, 5), (0, 12), (0, 100)])
def test_attach_gives_one_answer_on_every_way(spark, limit, hot):
    keys = [0] * 34 + [1] * 8 + [2] * 8
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    got = attach(left, right, ["k"], ["i"], limit=limit, hot_rows=hot)
    assert got.columns == ["k", "i", "name"]
    assert {(r.k, r.i, r.name) for r in got.collect()} == {
        (k, i, {0: "a", 1: "b"}.get(k)) for i, k in enumerate(keys)}
    assert got.count() == len(keys)


def test_a_task_orders_no_group_of_six_million_rows(spark):
    """A row of samples is some 40 bytes when it is shuffled: a group is cut long before 1.5 GB."""
    df = spark.range(12_000_000).select((F.col("id") % 2).alias("k"))
    assert choose_block(df, ["k"]) == BLOCK
