"""Frames: classes (different sets) that are compared with a centre, not with each other.

A frame's centre is the set of n-grams that more than half of its classes hold (found
from some of them; any centre gives right results). Classes are sent to it once and keep
only what they and the centre do not share, their rest. The distance of two sets is the
distance of their rests, so sizes alone link most of a family of near copies.

`cls` and `frame` are binary keys, `n` the size of a set, `grams` the set itself. `home`
names the frame in which classes have been compared before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.llm.common import stored
from activity_timeline.llm.components import components

CENTRE_SAMPLE = 64      # classes that a centre is found from
ROWS_PER_COPY = 2_000   # classes of a frame that one copy of its centre serves


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def wide_frames(many: DataFrame, percent: int) -> DataFrame:
    """cls, frame, home, size: frames of the keys with many classes, joined where they overlap.

    many: cls, n, frame, and the lead (first class) of a key that the class has.

    Linked sets differ in size by a factor of 100 / percent at most. A class goes to the
    frames of its own range of sizes and of the next one, so a link is inside one of them.
    """
    joined = components(many.select(F.col("cls").alias("a"), F.col("lead").alias("b")), "wide")
    step = float(np.log(100 / percent)) or 1.0
    range_ = F.floor(F.log("n") / step).cast("int")
    dealt = (many.select("cls", "n", F.col("frame").alias("home")).distinct()
             .join(joined.withColumnRenamed("node", "cls"), "cls")
             .select("cls", "home", "root", F.explode(F.array(range_, range_ + 1)).alias("range")))
    frame = F.unhex(F.md5(F.concat_ws(":", F.hex("root"), "range")))
    rows = stored(dealt.select("cls", "home", frame.alias("frame")), "wide-frames")
    sizes = (rows.groupBy("frame").agg(F.count("*").alias("size"), F.min("home").alias("low"),
                                       F.max("home").alias("high"))
             .where("low <> high").select("frame", "size"))
    return rows.join(sizes, "frame")


def _centre(pdf):
    grams, counts = np.unique(np.concatenate([np.asarray(x) for x in pdf["grams"]]),
                              return_counts=True)
    return pd.DataFrame({"frame": [pdf["frame"].iloc[0]],
                         "centre": [grams[counts * 2 > len(pdf)]]})


def remainders(sets: DataFrame) -> DataFrame:
    """cls, frame, n, rest: what each class and the centre of its frame do not share.

    sets: cls, frame, size (classes of the frame), n, grams. Centres are copied for frames of
    many classes, so that no task gets them all.
    """
    drawn = sets.where(F.pmod(F.xxhash64("cls"), F.col("size")) < CENTRE_SAMPLE)
    centres = drawn.select("frame", "grams").groupBy("frame").applyInPandas(
        _centre, "frame binary, centre array<bigint>")
    copies = F.ceil(F.col("size") / ROWS_PER_COPY).cast("int")
    sizes = sets.groupBy("frame").agg(F.first("size").alias("size"))
    dealt = sizes.join(centres, "frame", "left").select(
        "frame", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"),
        F.coalesce("centre", F.array().cast("array<bigint>")).alias("centre"))
    salted = sets.withColumn("copy", F.pmod(F.xxhash64("cls", F.lit(1)), copies).cast("int"))
    joined = salted.join(dealt, ["frame", "copy"])
    return joined.select("cls", "frame", "n", F.concat(
        F.array_except("grams", "centre"), F.array_except("centre", "grams")).alias("rest"))


def _copies(size: Column) -> Column:
    return F.ceil(size / ROWS_PER_COPY).cast("int")


def _with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """rows (with frame, size) joined with a row per frame, copied for frames of many rows."""
    copies = summary.withColumn("copy", F.explode(F.sequence(F.lit(0), _copies(F.col("size")) - 1)))
    salted = rows.withColumn("copy", F.pmod(F.xxhash64("cls", F.lit(2)), _copies(F.col("size")))
                             .cast("int"))
    return salted.join(copies.drop("size"), ["frame", "copy"]).drop("copy")


def links_inside(rests: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join up all classes of a frame that are joined by links inside it.

    rests: cls, frame, home, n, rest (what the class and the frame's centre do not share),
    size. Classes with the same home are not compared. With slack = near * n - far * |rest|,
    two classes are linked if and only if slack_a + slack_b + 2 * far * (n-grams that their
    rests share) >= 0. So each class is linked with the one of largest slack, the top, unless
    it lacks too much. Of two classes of which one is out of the top's reach, the rests must
    share at least -(slack_a + slack_b) / (2 * far) n-grams, so one of the rarest |rest| less
    that number, and one.
    """
    far = 100 + percent
    rests = stored(rests.withColumn("slack", F.col("n") * (100 - percent) - F.size("rest") * far),
                   "rests")
    tops = rests.groupBy("frame").agg(F.max(F.struct("slack", "cls", "home")).alias("top"),
                                      F.first("size").alias("size"))
    with_top = stored(_with_summary(rests, tops), "rests-top")
    near = F.col("slack") + F.col("top.slack") >= 0
    links = with_top.where(near).select(F.col("cls").alias("a"), F.col("top.cls").alias("b"))

    beyond = with_top.where(~near).groupBy("frame").agg(
        F.max("slack").alias("beyond"), F.first("top.slack").alias("top_slack"),
        F.first("size").alias("size"))
    rows = _with_summary(rests, beyond).withColumn(
        "out", F.col("slack") + F.col("top_slack") < 0)
    partner = F.when(F.col("out"), F.greatest("top_slack", "beyond")).otherwise(F.col("beyond"))
    least = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + partner) / (2 * far)))
    tokens = rows.withColumn("keep", F.size("rest") - least + 1).where("keep > 0").select(
        "frame", "cls", "home", "n", "out", "slack", "keep", F.size("rest").alias("length"),
        F.explode("rest").alias("token"))
    counts = tokens.groupBy("frame", "token").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("frame", "cls").orderBy("hits", "token")
    ranked = stored(
        tokens.join(counts, ["frame", "token"]).withColumn("place", F.row_number().over(order))
        .where("place <= keep AND hits > 1")
        .select("frame", "token", "cls", "home", "n", "out", "slack",
                (F.col("length") - F.col("place") + 1).alias("left")), "rest-tokens")
    l, r = ranked.where("out").alias("l"), ranked.alias("r")
    reach = (F.col("l.slack") + F.col("r.slack")
             + F.least("l.left", "r.left") * 2 * far >= 0)
    pairs = l.join(r, (F.col("l.frame") == F.col("r.frame")) & (F.col("l.token") == F.col("r.token"))
                   ).where((F.col("l.cls") != F.col("r.cls")) & reach
                           & (F.col("l.home") != F.col("r.home"))
                           & similar_sizes(F.col("l.n"), F.col("r.n"), percent)
                           & (~F.col("r.out") | (F.col("l.cls") < F.col("r.cls"))))
    pairs = pairs.select("l.frame", F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()
    left = rests.select("frame", F.col("cls").alias("a"), F.col("rest").alias("ra"),
                        F.col("slack").alias("sa"))
    right = rests.select("frame", F.col("cls").alias("b"), F.col("rest").alias("rb"),
                         F.col("slack").alias("sb"))
    checked = pairs.join(left, ["frame", "a"]).join(right, ["frame", "b"]).where(
        F.col("sa") + F.col("sb") + F.size(F.array_intersect("ra", "rb")) * 2 * far >= 0)
    return links.unionByName(checked.select("a", "b"))


def in_frames(sets: DataFrame, frames: DataFrame, percent: int) -> DataFrame:
    """a, b: links inside frames (cls, frame, home, size), on the full sets (cls, grams)."""
    filled = frames.join(sets.select("cls", "n", "grams"), "cls")
    # remainders hands n on as it is, so what belongs to the class travels with it
    rests = remainders(filled.select("cls", "frame", "size", "grams",
                                     F.struct("n", "home", "size").alias("n")))
    return links_inside(rests.select("cls", "frame", "rest", "n.*"), percent)
