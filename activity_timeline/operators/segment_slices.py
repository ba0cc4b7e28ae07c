"""Debounce, minimum length, merging and numbering of cuts in slices, in one pass.

What a slice decides by itself is everything but its tail: whether its last cut is long
enough depends on the first cut to the right, whether the one left before that is long
enough depends on the first cut to the right that is left, and whether its first cut is a
change depends on the last state to the left. So a slice is told by one row: its heads,
the last two cuts that may stay (`m`, `l`), and the states and number of changes of the
ones before, which stay for sure (`k`). Windows over these rows hand each slice what lies
around it. Nothing is written in between, and a session never comes into one task but as
one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.functions.numbers import whole
from activity_timeline.schemas import SESSION

SLICE_KEYS = [SESSION, "_slice"]
# what a cut is at this point of the pass
SURE, NEXT_TO_LAST, LAST = "k", "m", "l"


def _line():
    return Window.partitionBy(*SLICE_KEYS).orderBy("pos")


def _long(end: Column, cut: str, min_s: float) -> Column:
    """Whether a cut stays that ends at `end`; the first of a session always does."""
    return F.col(f"{cut}before_end_s").isNull() | ~(end - F.col(f"{cut}start_s") < F.lit(min_s))


def _inside(cuts: DataFrame, debounce_s: float, min_segment_s: float, block: int) -> DataFrame:
    """Cuts that the slice does not drop by itself, with their role and the heads of the slice."""
    line = _line()
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.lead("before_end_s").over(line)
    once = (cuts.withColumn("_slice", whole(F.col("pos"), block))
            .select("*", following.alias("_end"),
                    F.lead(F.lit(True)).over(line).isNull().alias("_is_last"),
                    F.first("before_end_s").over(everything).alias("_head_0"))
            .where(F.col("_is_last") | _long(F.col("_end"), "", debounce_s)))
    role = (F.when(F.col("_is_last"), LAST)
            .when(F.lead("_is_last").over(line), NEXT_TO_LAST).otherwise(SURE))
    return (once.select(*[c for c in once.columns if c != "_end"], following.alias("_end"),
                        role.alias("_role"),
                        F.first("before_end_s").over(everything).alias("_head_1"))
            .where((F.col("_role") != SURE) | _long(F.col("_end"), "", min_segment_s))
            .drop("_end", "_is_last"))


def _summaries(inside: DataFrame) -> DataFrame:
    """One row per slice: heads, the cuts m and l, and what is known of the cuts before them."""
    line = _line()
    sure = F.col("_role") == SURE
    marked = inside.withColumn("_change", sure & (
        F.lag("speaker_state").over(line) != F.col("speaker_state")))

    def of(role: str, column: str) -> Column:
        return F.max(F.when(F.col("_role") == role, F.col(column)))

    def at(pick, value: str, when: Column) -> Column:
        return pick(F.when(when, F.col(value)), F.when(when, F.col("pos")))

    return marked.groupBy(*SLICE_KEYS).agg(
        F.max("last_end_s").alias("last_end_s"),
        F.max("_head_0").alias("_head_0"), F.max("_head_1").alias("_head_1"),
        *[of(role, c).alias(f"{role}_{c}") for role in (NEXT_TO_LAST, LAST)
          for c in ("start_s", "before_end_s", "speaker_state")],
        at(F.min_by, "speaker_state", sure).alias("k_first"),
        at(F.min_by, "before_end_s", sure).alias("k_first_before"),
        at(F.max_by, "speaker_state", sure).alias("k_last"),
        at(F.min_by, "before_end_s", F.col("_change")).alias("k_change_before"),
        F.count_if("_change").alias("k_changes"))


def _around(summaries: DataFrame, debounce_s: float, min_segment_s: float) -> DataFrame:
    """Per slice: which of m and l stay, the state before it, the end after it, cuts before it."""
    along = Window.partitionBy(SESSION).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # from the far end, so that the nearest slice to the right is the last one seen
    later = (Window.partitionBy(SESSION).orderBy(F.desc("_slice"))
             .rowsBetween(Window.unboundedPreceding, -1))

    def to_the_right(column: str) -> Column:
        return F.coalesce(F.last(column, ignorenulls=True).over(later), F.col("last_end_s"))

    m_is = F.col("m_start_s").isNotNull()
    m_state, l_state = F.col("m_speaker_state"), F.col("l_speaker_state")
    df = summaries.withColumn("_end_0", to_the_right("_head_0"))
    df = df.withColumn("_l_once", _long(F.col("_end_0"), "l_", debounce_s))
    df = df.withColumn("_left_1", F.when(m_is, F.col("_head_1"))
                       .when(F.col("_l_once"), F.col("l_before_end_s")))
    df = df.withColumn("_end_1", to_the_right("_left_1"))
    m_end = F.when(F.col("_l_once"), F.col("l_before_end_s")).otherwise(F.col("_end_1"))
    df = (df.withColumn("_m_stays", m_is & _long(m_end, "m_", min_segment_s))
          .withColumn("_l_stays", F.col("_l_once") & _long(F.col("_end_1"), "l_", min_segment_s)))
    m_left, l_left = F.when(F.col("_m_stays"), m_state), F.when(F.col("_l_stays"), l_state)
    df = df.withColumn("_state", F.coalesce(l_left, m_left, "k_last"))
    df = df.withColumn("_before", F.last("_state", ignorenulls=True).over(earlier))

    def differs(state: Column, before: Column) -> Column:
        return state.isNotNull() & ~state.eqNullSafe(before)

    k_differs = differs(F.col("k_first"), F.col("_before"))
    m_differs = differs(m_left, F.coalesce("k_last", "_before"))
    l_differs = differs(l_left, F.coalesce(m_left, "k_last", "_before"))
    df = df.withColumn("_cuts", F.col("k_changes") + sum(
        (c.cast("bigint") for c in (k_differs, m_differs, l_differs)), F.lit(0).cast("bigint")))
    df = df.withColumn("_left_2", F.coalesce(
        F.when(k_differs, F.col("k_first_before")), F.col("k_change_before"),
        F.when(m_differs, F.col("m_before_end_s")), F.when(l_differs, F.col("l_before_end_s"))))
    return df.select(*SLICE_KEYS, "_m_stays", "_l_stays", "_before",
                     to_the_right("_left_2").alias("_end_2"),
                     F.coalesce(F.sum("_cuts").over(earlier), F.lit(0)).alias("_shift"))


def clean_in_slices(cuts: DataFrame, debounce_s: float, min_segment_s: float,
                    block: int) -> DataFrame:
    """Numbered segments of a list of cuts, in slices of `block` positions."""
    inside = _inside(cuts, debounce_s, min_segment_s, block)
    around = _around(_summaries(inside), debounce_s, min_segment_s)
    line = _line()
    stays = (F.when(F.col("_role") == NEXT_TO_LAST, F.col("_m_stays"))
             .when(F.col("_role") == LAST, F.col("_l_stays")).otherwise(True))
    left = inside.join(around, SLICE_KEYS).where(stays)
    before = F.coalesce(F.lag("speaker_state").over(line), "_before")
    changes = (left.withColumn("_state", before)
               .where(F.col("before_end_s").isNull() | (F.col("_state") != F.col("speaker_state"))))
    return changes.select(
        SESSION, "pos", "start_s",
        F.coalesce(F.lead("before_end_s").over(line), "_end_2").alias("end_s"),
        "camera_index", "speaker_state", "speaker_label",
        (F.row_number().over(line) - 1 + F.col("_shift")).cast("bigint").alias("seg_idx"))
