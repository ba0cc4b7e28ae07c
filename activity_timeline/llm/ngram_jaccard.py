"""Links between documents whose sets of word n-grams have a high Jaccard similarity.

Adaptive multi-match prefixes. The n-grams of all sets are put into one order,
rare ones first (by a count over all documents in cells, then by hash). Two sets of the wanted similarity share at least one n-gram of their
prefixes, and at least m of them if both prefixes are m - 1 n-grams longer. Each
set chooses its m by estimated cost: what its prefix must look through, plus the
candidates that are left, of which (by Markov's bound) at most a share of 1/m
has m matches. A pair is a candidate if it shares the smaller m of the two.

Equal sets are one class from the start. Classes that have prefix n-grams in
common would give all pairs of a large group; instead they meet in a frame:

* each n-gram leads to the first class that holds it in its prefix, and a class
  joins the frame of the class that a good part of its own prefix leads to, if
  there is one (otherwise it stands alone);
* a frame has a centre, the n-grams that more than half of its classes hold
  (found from some of them; any centre gives right results). Classes are sent to
  it once and keep only what they and the centre do not share. The distance of
  two sets is the distance of these remainders;
* so sizes alone link most of a group: every class within reach of the one that
  lies closest (`slack`, see frames.py) is linked with it. Only classes out of
  its reach are compared by prefixes of remainders, rarest first.

Pairs from different frames that pass the multi-match test are compared as a
whole. N-grams that would make too many such pairs (many classes outside their
largest frame) put their classes into wide frames instead, where only classes of
different first frames are compared. No link between different sets is lost, and
no pair within reach of a common neighbour is written out. Sets are told apart by
hashes of 64 bits per n-gram and are not read again as words.

Null and empty texts, and texts without words, have empty sets and are linked
with nothing. Fewer words than n make one n-gram. Rows without doc_id take part;
a component of such rows only has a null component_id. Repeated rows are equal
sets. Empty tables give no rows. Further columns are left alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, row_key, stored, without_keys
from activity_timeline.llm.components import components
from activity_timeline.llm.frames import in_frames, similar_sizes, wide_frames
from activity_timeline.llm.words import mix, slices, window_hashes, word_hashes

LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 25   # cells of the count of n-grams (64 MB at most)
CELLS_PER_ROW = 32
BLOCK = 1 << 16         # cells that are added up together
BINS = 256              # groups of tasks whose counts are added up first
LONGEST = 8             # most matches asked for
VERIFY = 20             # cost of a comparison, in n-grams looked through
FEW = 128               # classes outside a token's largest frame that may meet as pairs
SUPPORT = 4             # a class joins a frame that a fourth of its prefix leads to
BITS = 1 << 22          # bits of the filter of rows whose sets are wanted


@dataclass(frozen=True)
class Similarity:
    """Sets of `words`-word n-grams, linked if 100 * intersection >= percent * union."""
    words: int = 3
    percent: int = 90


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    hashes, first = word_hashes(texts, lower=True)
    grams = window_hashes(hashes, words)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            x = np.sort(grams[a:b - words + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            sets.append(mix(window_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def class_key(x: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(x).sum(), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()],
                    np.uint64).tobytes()


SURVEYED = ("row_key bigint, doc_id bigint, n int, cls binary, block int, bin int,"
            " counts binary")


def cells_for(rows: int) -> int:
    """Cells of the count of n-grams: a power of two that grows with the rows."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, rows * CELLS_PER_ROW - 1).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _survey(words: int, n_cells: int):
    def run(batches):
        """A row for each document; then the counts of all n-grams of the task, by blocks of cells."""
        cells = np.zeros(n_cells, np.uint32)
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                at, hits = np.unique((every & np.uint64(n_cells - 1)).astype(np.uint32),
                                     return_counts=True)
                cells[at] += hits.astype(np.uint32)
                rows = len(sets)
                yield pa.record_batch(
                    [batch.column("row_key"), batch.column("doc_id"),
                     pa.array([len(x) for x in sets], pa.int32()),
                     pa.array([class_key(x) if len(x) else None for x in sets], pa.binary()),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()),
                     pa.nulls(rows, pa.binary())], names=names)
        task = TaskContext.get().partitionId() % BINS
        for block in range(n_cells // BLOCK):
            own = cells[block * BLOCK:(block + 1) * BLOCK]
            if own.any():
                yield pa.record_batch(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                     pa.nulls(1, pa.binary()), pa.array([block], pa.int32()),
                     pa.array([task], pa.int32()), pa.array([_packed(own)], pa.binary())],
                    names=names)

    names = [x.split()[0] for x in SURVEYED.split(", ")]
    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint64)
    for counts in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(counts), np.uint32)
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"block": table.column("block")[:1],
                     "counts": pa.array([_packed(total)], pa.binary())})


def frequency_cells(surveyed: DataFrame, n_cells: int) -> np.ndarray:
    """Excess of each cell's count over what chance puts there, between 1 and 65,535.

    Blocks of cells are added up in two steps, the first for some of the tasks each.
    """
    blocks = surveyed.where("block IS NOT NULL").select("block", "bin", "counts")
    for keys in (["block", "bin"], ["block"]):
        blocks = blocks.groupBy(*keys).applyInArrow(_added, "block int, counts binary")
    cells = np.zeros(n_cells, np.int64)
    for block, counts in blocks.toLocalIterator():
        cells[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(zlib.decompress(counts), np.uint32)
    mean = cells.sum() / n_cells
    cells -= np.int64(mean + 4 * np.sqrt(mean))
    return np.clip(cells, 1, np.iinfo(np.uint16).max).astype(np.uint16)


def choose_matches(costs: np.ndarray, base: int) -> int:
    """How many matches to ask for, given the frequencies along a set's order."""
    most = min(LONGEST, len(costs) - base + 1)
    through = np.cumsum(costs[:base + most - 1])[base - 1:]
    asked = np.arange(1, most + 1)
    return int(np.argmin(through + VERIFY * through / asked)) + 1


def _prefixes(words: int, percent: int, excess: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                cls, ns, asked, prefix = [], [], [], []
                for x in shingle_sets(batch.column("text"), words):
                    if not len(x):
                        continue
                    cost = excess[(x & np.uint64(len(excess) - 1)).astype(np.int64)]
                    order = np.argsort(cost, kind="stable")
                    base = len(x) - -(-percent * len(x) // 100) + 1
                    m = choose_matches(cost[order], base)
                    cls.append(class_key(x))
                    ns.append(len(x))
                    asked.append(m)
                    prefix.append(x[order[:base + m - 1]].view(np.int64))
                yield pa.record_batch(
                    [pa.array(cls, pa.binary()), pa.array(ns, pa.int32()),
                     pa.array(asked, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["cls", "n", "asked", "prefix"])
    return run


def prefixes(docs: DataFrame, like: Similarity, excess: np.ndarray) -> DataFrame:
    """cls, n, asked, length, level, token: a row for each n-gram of each class's prefix.

    A token of level v belongs to the prefixes for v matches and more.
    """
    made = in_tasks(docs.select("text").where("text IS NOT NULL"),
                    _prefixes(like.words, like.percent, excess),
                    "cls binary, n int, asked int, prefix array<bigint>")
    one = made.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "asked", "prefix")])
    need = F.ceil(F.col("n") * like.percent / 100).cast("int")
    return one.select("cls", "n", "asked", F.size("prefix").alias("length"),
                      F.posexplode("prefix").alias("place", "token")).select(
        "cls", "n", "asked", "length", "token",
        F.greatest(F.lit(1), F.col("place") - (F.col("n") - need) + 1).alias("level"))


def frames_of(shared: DataFrame) -> DataFrame:
    """cls, frame of the classes that stand in a group.

    Each n-gram leads to the first class that holds it. A class joins the one that most of
    its prefix leads to, if that is a good part of it.
    """
    support = shared.groupBy("cls", "lead").agg(F.count("*").alias("led"),
                                                F.first("length").alias("length"))
    enough = F.least("length", F.greatest(F.lit(2), F.ceil(F.col("length") / SUPPORT)))
    return (support.where(F.col("led") >= enough).groupBy("cls")
            .agg(F.max(F.struct("led", "lead")).alias("top"))
            .select("cls", F.col("top.lead").alias("frame")))


def cross_pairs(shared: DataFrame, framed: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of classes from different frames that share as many n-grams as asked; and
    cls, n, lead, frame of the n-grams that would make too many of them.

    The frame that holds most of a token's classes is not joined with itself. Tokens that one
    frame only holds are left out. Those with more than FEW classes outside their largest
    frame make no pairs: their classes meet in a wide frame.
    """
    rows = shared.drop("length").join(framed, "cls")
    tokens = (rows.groupBy("token", "frame").count().groupBy("token")
              .agg(F.sum("count").alias("classes"), F.max(F.struct("count", "frame")).alias("top"))
              .select("token", F.col("top.frame").alias("large"),
                      (F.col("classes") - F.col("top.count")).alias("others"))
              .where("others > 0"))
    mixed = stored(rows.join(tokens, "token"), "mixed")
    few = mixed.where(F.col("others") <= FEW)
    left, right = few.where("frame <> large").alias("l"), few.alias("r")
    asked = F.least("l.asked", "r.asked")
    found = left.join(right, F.col("l.token") == F.col("r.token")).where(
        (F.col("l.frame") != F.col("r.frame"))
        & ((F.col("r.frame") == F.col("r.large")) | (F.col("l.cls") < F.col("r.cls")))
        & similar_sizes(F.col("l.n"), F.col("r.n"), like.percent)
        & (F.greatest("l.level", "r.level") <= asked))
    pairs = (found.groupBy(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
             .agg(F.count("*").alias("matches"), F.first(asked).alias("asked"))
             .where("matches >= asked").select("a", "b"))
    many = mixed.where(F.col("others") > FEW).select("cls", "n", "lead", "frame")
    return pairs, many


def _wanted_sets(words: int, bits: np.ndarray):
    def run(batches):
        for whole in batches:
            keys = mix(whole.column("row_key").to_numpy().view(np.uint64)) % np.uint64(BITS)
            hit = (bits[(keys >> np.uint64(3)).astype(np.int64)]
                   >> (keys & np.uint64(7)).astype(np.uint8)) & 1
            whole = whole.filter(pa.array(hit.astype(bool)))
            for batch in slices(whole, "text") if whole.num_rows else []:
                sets = shingle_sets(batch.column("text"), words)
                yield pa.record_batch(
                    [batch.column("row_key"),
                     pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                    names=["row_key", "grams"])
    return run


def _bit_cells(batches):
    for batch in batches:
        keys = mix(batch.column("row_key").to_numpy().view(np.uint64)) % np.uint64(BITS)
        yield pa.record_batch(
            [pa.array((keys >> np.uint64(3)).astype(np.int32)),
             pa.array((np.int32(1) << (keys & np.uint64(7)).astype(np.int32)).astype(np.int32))],
            names=["cell", "bit"])


def sets_of(docs: DataFrame, like: Similarity, wanted: DataFrame) -> DataFrame:
    """wanted (row_key, ...) with the sets of these rows.

    A bitmap of fixed size keeps most other rows from being worked out and shuffled.
    """
    bits = np.zeros(BITS // 8, np.uint8)
    cells = in_tasks(wanted.select("row_key"), _bit_cells, "cell int, bit int")
    for cell, value in cells.groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():
        bits[cell] = value
    keyed = docs.select(row_key().alias("row_key"), "text").where("text IS NOT NULL")
    sets = in_tasks(keyed, _wanted_sets(like.words, bits), "row_key bigint, grams array<bigint>")
    return sets.join(wanted, "row_key").dropDuplicates(["row_key"])


def across_frames(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """a, b: those of the pairs that are links."""
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"), F.col("n").alias("na"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"), F.col("n").alias("nb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").where(
        both * 100 >= (F.col("na") + F.col("nb") - both) * like.percent).select("a", "b")


def link_components(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id of every document."""
    return _linked(docs, like).drop("root")


def _linked(docs: DataFrame, like: Similarity) -> DataFrame:
    """The same with `root`, which rows of one component share; null for rows without words."""
    keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
    n_cells = cells_for(docs.count())
    surveyed = stored(in_tasks(keyed, _survey(like.words, n_cells), SURVEYED), "surveyed")
    rows = surveyed.where("block IS NULL")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"))

    tokens = stored(prefixes(docs, like, frequency_cells(surveyed, n_cells)), "prefixes")
    # counted without the classes: most n-grams are in one prefix only, and lead to nobody
    often = tokens.groupBy("token").count().where("count > 1").select("token")
    shared = stored(tokens.join(often, "token"), "often")
    leads = shared.groupBy("token").agg(F.min("cls").alias("lead"))
    shared = stored(shared.join(leads, "token"), "shared")
    framed = shared.select("cls").distinct().join(frames_of(shared), "cls", "left").select(
        "cls", F.coalesce("frame", "cls").alias("frame"))
    framed = stored(framed, "frames")
    pairs, many = cross_pairs(shared, framed, like)
    pairs = stored(pairs, "pairs")
    first = framed.join(framed.groupBy("frame").agg(F.count("*").alias("size"))
                        .where("size > 1"), "frame").select(
        "cls", "frame", F.col("cls").alias("home"), "size")
    frames = stored(first.unionByName(wide_frames(many, like.percent)
                                      .select("cls", "frame", "home", "size")), "all-frames")

    wanted = (pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
              .union(frames.select("cls")).distinct())
    wanted = stored(wanted.join(classes.select("cls", "row_key"), "cls"), "wanted")
    sets = stored(sets_of(docs, like, wanted).withColumn("n", F.size("grams")), "sets")
    links = in_frames(sets, frames, like.percent).unionByName(across_frames(pairs, sets, like))
    found = components(links)
    # the smallest doc_id of each component, then of each class
    roots = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("cls", "root", "component_id")
    return rows.join(named, "cls", "left").select(
        "row_key", "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"), "root")


def one_of_each(docs: DataFrame, like: Similarity) -> DataFrame:
    """One row of each component, all columns as they were.

    It is the one with the smallest doc_id (rows without one come last), then with the
    smallest row_key; of repeated rows, the first by their JSON. Rows without words are
    linked to nothing but their own repetitions.
    """
    # text without words: a component for each row_key
    own = F.coalesce(F.col("root"), F.expr("cast(cast(row_key AS string) AS binary)"))
    found = (_linked(docs, like).select("row_key", "doc_id", own.alias("root"),
                                        F.col("root").isNull().alias("bare"))
             .groupBy("root", "bare", "row_key")
             .agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    found = stored(found, "linked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    stays = found.groupBy("root", "bare").agg(F.min(order)["row_key"].alias("row_key"))
    gone = stored(found.join(stays, "row_key", "left_anti").select("row_key"), "gone")
    kept = without_keys(docs.select(row_key().alias("row_key"), F.struct("*").alias("row")), gone)
    twice = found.join(stays, "row_key", "left_semi").where("copies > 1").select("row_key")
    if not twice.isEmpty():
        one = (kept.join(twice, "row_key", "left_semi").groupBy("row_key")
               .agg(F.min_by("row", F.to_json("row")).alias("row")))
        kept = kept.join(twice, "row_key", "left_anti").unionByName(one)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
