"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failed filters are one mask of bits. Counts of masks per part are
additive, and they are all that the outcome of any order needs; no order is run
over the documents.

Four filters look at one text. The fifth, duplicates, is prepared by a counting
Bloom sketch: every task counts the cells of its texts' hashes, blocks of cells
are added up, and a text with a cell that was hit once is certainly unique. Only
texts whose cells were all hit twice or more are shuffled, grouped as whole texts
and given the smallest doc_id of the group. The sketch grows with the number of
rows up to MOST_CELLS (128 MB on the driver and in a worker); beyond about a
hundred million documents it clears fewer texts, and the results stay the same.

Null and empty texts are the same text. Rows without doc_id have no label and are
not smaller than any row; no doc_id is smaller than theirs. Repeated rows count
each, and are no duplicates of each other. Several labels of a document: one with
quality 1 makes it good, one with toxic 1 toxic. A null part is the empty string.
An empty table gives no rows. Further columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, ship, text_or_empty

PROBES = 3              # cells of a text
CELLS_PER_ROW = 16
BLOCK_BITS = 16         # a block has 2^16 cells
MOST_CELLS = 1 << 30
FLUSH = 1 << 20         # hashes that a task counts at once
DUPLICATE = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Letter of a filter and whether a text fails it."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n_words = F.size(words)
    return {
        "A": n_words < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n_words * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells_for(rows: int) -> int:
    """Cells of the sketch: a power of two, one block at least."""
    wanted = max(1 << BLOCK_BITS, rows * CELLS_PER_ROW)
    return min(MOST_CELLS, 1 << (wanted - 1).bit_length())


def probes(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cells of each hash, PROBES for each."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(cells - 1)
                     for i in range(PROBES)], axis=1).astype(np.int64)


def _count(cells: int):
    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        """A row for each block that was hit: its cells hit once, and those hit more often."""
        found, hits = np.unique(probes(np.concatenate(hashes), cells), return_counts=True)
        block = found >> BLOCK_BITS
        inside = (found & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [[], [], []]
        for a, b in zip(first.tolist(), np.append(first[1:], len(block)).tolist()):
            many = hits[a:b] > 1
            rows[0].append(int(block[a]))
            rows[1].append(inside[a:b][~many].tobytes())
            rows[2].append(inside[a:b][many].tobytes())
        return pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()),
                                pa.array(rows[2], pa.binary())], names=["block", "once", "more"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("h").to_numpy())
            n += len(held[-1])
            if n >= FLUSH:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)
    return run


def _merge(table: pa.Table) -> pa.Table:
    """One bit for each cell of a block: whether it was hit twice or more."""
    once, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint16)
                  for c in ("once", "more"))
    hits = np.bincount(once, minlength=1 << BLOCK_BITS)
    hits += 2 * np.bincount(more, minlength=1 << BLOCK_BITS)
    bits = np.packbits(hits > 1, bitorder="little").tobytes()
    return pa.table({"block": table.column("block")[:1], "bits": pa.array([bits], pa.binary())})


def repeated_cells(docs: DataFrame) -> np.ndarray:
    """Bits of the cells that two texts or more have hit."""
    cells = cells_for(docs.count())
    hashes = docs.select(F.xxhash64(text_or_empty()).alias("h"))
    counted = in_tasks(hashes, _count(cells), "block int, once binary, more binary")
    merged = counted.groupBy("block").applyInArrow(_merge, "block int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for block, own in merged.toLocalIterator():
        bits[block * size:(block + 1) * size] = np.frombuffer(own, np.uint8)
    return bits


def possible_repeat(bits: np.ndarray):
    """Column function of a text: whether another row may have the same one."""
    cells = len(bits) * 8

    @F.pandas_udf("boolean")
    def known(hashes: pd.Series) -> pd.Series:
        at = probes(hashes.to_numpy(np.int64), cells)
        return pd.Series(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

    return lambda text: known(F.xxhash64(text))


def first_ids(docs: DataFrame, repeat) -> DataFrame:
    """doc_id, digest: the smallest doc_id of each text that may be repeated."""
    text = text_or_empty()
    same = (docs.where("doc_id IS NOT NULL").select("doc_id", text.alias("text"))
            .where(repeat(F.col("text"))).groupBy("text").agg(F.min("doc_id").alias("doc_id")))
    return same.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def failed_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask of every row; bit i of the mask is the i-th filter in order of letters."""
    ship(docs.sparkSession)
    repeat = possible_repeat(repeated_cells(docs))
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"),
                      text_or_empty().alias("text"))
    own = own.withColumn("repeat", F.col("doc_id").isNotNull() & repeat(text))
    flags = [F.when(failed, 1 << i).otherwise(0)
             for i, failed in enumerate(text_filters(text).values())]
    mask = reduce(Column.__add__, flags)
    cleared = own.where(~F.col("repeat")).select("doc_id", "part", mask.alias("mask"))
    firsts = first_ids(docs, repeat).withColumn("first", F.lit(True))
    looked = (own.where("repeat")
              .select("doc_id", "part", mask.alias("mask"),
                      F.unhex(F.sha2(text, 256)).alias("digest"))
              .join(firsts, ["doc_id", "digest"], "left"))
    duplicate = F.when(F.col("first").isNull(), 1 << len(flags)).otherwise(0)
    return cleared.unionByName(
        looked.select("doc_id", "part", (F.col("mask") + duplicate).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows with the mask, and those of them with a label."""
    marked = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name)
                     for c, name in (("quality", "good"), ("toxic", "toxic"))])
              .where("good + toxic > 0"))
    nothing = F.lit(None).cast("int")
    named = masks.where("doc_id IS NOT NULL").join(marked, "doc_id", "left")
    nameless = masks.where("doc_id IS NULL").select(
        "*", nothing.alias("good"), nothing.alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")])


def outcomes(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from counts per part and mask."""
    orders = factorial(len(letters))
    rules = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            rules.append(f"struct('{''.join(order)}' AS filter_order, {step} AS step,"
                         f" {bit} AS bit, {before} AS before)")
            before |= bit
    whole = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    each = whole.select("part", "counts",
                        F.explode(F.expr(f"array({', '.join(rules)})")).alias("rule"))
    bit, before = F.col("rule.bit"), F.col("rule.before")

    def total(value, chosen) -> Column:
        return F.aggregate(F.filter("counts", chosen), F.lit(0).cast("bigint"),
                           lambda acc, c: acc + value(c))

    def fails(c) -> Column:
        return c["mask"].bitwiseAND(bit) > 0

    def earlier(c) -> Column:
        return c["mask"].bitwiseAND(before) > 0

    def here(c) -> Column:
        return fails(c) & ~earlier(c)

    return each.select(
        "part", "rule.filter_order", "rule.step",
        total(lambda c: c["n"], lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total(lambda c: c["n"], here).alias("removed"),
        total(lambda c: c["n"], lambda c: fails(c) & earlier(c)).alias("redundant"),
        total(lambda c: c["n"], lambda c: c["mask"] == bit).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        # of the orders, that share has this filter before the others that the document fails
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("bigint"), fails)
        .alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of every order and step."""
    letters = "".join(text_filters(F.col("text"))) + DUPLICATE
    return outcomes(mask_counts(failed_masks(docs, part), labels), letters)
