"""MinHash near-dedup with tensored banding.

Two collections of COLLECTION short hashes are made for each set of word n-grams;
a short hash is a pair of minhashes. Table (i, j) has as its key the i-th hash of
the first collection and the j-th of the second one, so that the 144 tables with
keys of four minhashes need 48 minhashes instead of 576. Two sets of similarity s
meet in some table with probability (1 - (1 - s^2)^12)^2, which leaves out one pair
in 100,000 at the threshold of 0.8 (fewer above), and meet in about 60 tables.
Keys are only formed from short hashes that other sets have as well.

Equal sets are one class from the start. Classes with the same key are candidates:

* each key leads to the first of its classes, and a class joins the frame of the
  lead that most of its keys have, if these are enough. A frame is verified as a
  whole on the full sets (`links_inside`): no pair of a large family is written
  out whose link does not matter;
* between frames, a key with few classes outside its largest frame gives pairs,
  of which those in MATCHES tables or more are verified on the full sets. A key
  with more of them (many texts that share a passage, say) puts its classes into
  one wide frame, together with those that other such keys join to them. In a wide
  frame only classes of different first frames are compared, by rare n-grams.

Verification is exact: every link found is one, and no candidate is dropped by a
cap or a sample. Null and empty texts, and texts without words, have empty sets
and are linked with nothing. Fewer words than n make one n-gram. Rows without
doc_id take part; a component of such rows only has a null component_id and keeps
none of them. Repeated rows are equal sets. Empty tables give no rows. Further
columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, row_key, stored
from activity_timeline.llm.components import components
from activity_timeline.llm.frames import in_frames, similar_sizes, wide_frames
from activity_timeline.llm.ngram_jaccard import (
    Similarity, across_frames, class_key, sets_of, shingle_sets)
from activity_timeline.llm.words import mix, slices

COLLECTION = 12        # short hashes of a collection
PAIR = 2               # minhashes of a short hash
MATCHES = 4            # tables that candidates from different frames share
JOINS = 9              # tables a class shares with the lead of its frame, at least
FEW = 16               # classes outside a key's largest frame that may meet as pairs
SEED = 12

SIGNED = "row_key bigint, doc_id bigint, n int, cls binary, hashes array<bigint>"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 2**63, (2, 2 * COLLECTION * PAIR), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def short_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: the short hashes of both collections."""
    odd, flip = _multipliers()
    full = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
    out = np.zeros((len(sets), 2 * COLLECTION), np.uint64)
    if not len(full):
        return out
    grams = np.concatenate([sets[i] for i in full])
    sizes = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(sizes) - sizes
    for place in range(2 * COLLECTION):
        short = np.full(len(full), place, np.uint64)
        for k in range(place * PAIR, (place + 1) * PAIR):
            short = mix(short ^ np.minimum.reduceat((grams ^ flip[k]) * odd[k], starts))
        out[full, place] = short
    return out


def _signed(words: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                hashes = short_hashes(sets).view(np.int64)
                full = np.array([len(x) > 0 for x in sets], bool)
                yield pa.record_batch(
                    [batch.column("row_key"), batch.column("doc_id"),
                     pa.array([len(x) for x in sets], pa.int32()),
                     pa.array([class_key(x) if len(x) else None for x in sets], pa.binary()),
                     pa.array([h if f else None for h, f in zip(hashes, full)],
                              pa.list_(pa.int64()))],
                    names=["row_key", "doc_id", "n", "cls", "hashes"])
    return run


def table_keys(classes: DataFrame) -> DataFrame:
    """cls, n, key: the keys of all tables in which a class might meet another one."""
    halves = classes.select("cls", "n", F.posexplode("hashes").alias("place", "h"))
    common = (halves.groupBy("place", "h").agg(F.count("*").alias("classes"))
              .where("classes > 1").drop("classes"))
    own = (halves.join(common, ["place", "h"]).groupBy("cls", "n")
           .agg(F.collect_list(F.struct("place", "h")).alias("halves")))
    first = F.filter("halves", lambda x: x["place"] < COLLECTION)
    second = F.filter("halves", lambda x: x["place"] >= COLLECTION)
    tensored = own.select("cls", "n", F.explode(first).alias("first"), second.alias("second"))
    return tensored.select("cls", "n", "first", F.explode("second").alias("second")).select(
        "cls", "n", F.xxhash64("first", "second").alias("key"))


def first_frames(shared: DataFrame) -> DataFrame:
    """cls, frame of the classes that share enough tables with the lead of some of their keys."""
    led = shared.groupBy("cls", "lead").agg(F.count("*").alias("tables"))
    return (led.where(F.col("tables") >= JOINS).groupBy("cls")
            .agg(F.max(F.struct("tables", "lead"))["lead"].alias("frame")))


def between_frames(rows: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of classes from different frames; and the rows of keys with too many of them.

    rows: cls, n, key, lead, frame.
    """
    by_frame = rows.groupBy("key", "frame").count()
    keys = (by_frame.groupBy("key")
            .agg(F.sum("count").alias("classes"), F.max(F.struct("count", "frame")).alias("top"))
            .select("key", F.col("top.frame").alias("large"),
                    (F.col("classes") - F.col("top.count")).alias("others"))
            .where("others > 0"))
    mixed = stored(rows.join(keys, "key"), "mixed")
    few = mixed.where(F.col("others") <= FEW)
    left, right = few.where("frame <> large").alias("l"), few.alias("r")
    found = left.join(right, F.col("l.key") == F.col("r.key")).where(
        (F.col("l.frame") != F.col("r.frame"))
        & ((F.col("r.frame") == F.col("r.large")) | (F.col("l.cls") < F.col("r.cls")))
        & similar_sizes(F.col("l.n"), F.col("r.n"), like.percent))
    pairs = (found.groupBy(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b"))
             .agg(F.count("*").alias("tables")).where(F.col("tables") >= MATCHES).select("a", "b"))
    return pairs, mixed.where(F.col("others") > FEW).select("cls", "n", "lead", "frame")


def linked(docs: DataFrame, like: Similarity) -> DataFrame:
    """row_key, doc_id, n, cls, root of every row; rows of one component share the root."""
    keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
    signed = stored(in_tasks(keyed, _signed(like.words), SIGNED), "signed")
    classes = stored(signed.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("row_key").alias("row_key"), F.first("n").alias("n"),
        F.first("hashes").alias("hashes")), "classes")

    keys = stored(table_keys(classes), "keys")
    leads = (keys.groupBy("key").agg(F.count("*").alias("classes"), F.min("cls").alias("lead"))
             .where("classes > 1").drop("classes"))
    shared = stored(keys.join(leads, "key"), "shared")
    framed = stored(shared.select("cls").distinct().join(first_frames(shared), "cls", "left")
                    .select("cls", F.coalesce("frame", "cls").alias("frame")), "frames")
    rows = shared.join(framed, "cls")
    pairs, many = between_frames(rows, like)
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
    found = components(links, "minhash")
    return signed.join(found.withColumnRenamed("node", "cls"), "cls", "left").select(
        "row_key", "doc_id", "n", "cls", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(words=4, percent=80)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows = stored(linked(docs, like), "linked")
    least = (rows.where("root IS NOT NULL").groupBy("root")
             .agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    several = least.where("rows > 1").drop("rows")
    named = rows.join(several, "root", "left")
    component = F.coalesce("component_id", "doc_id")
    return named.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                        component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
