"""Connected components by contraction.

Each round every node hooks on to its smallest neighbour, chains of hooks are
shortened twice, and the edges are drawn between what is left. Rounds are
written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of all nodes of `edges` (a, b); root is a node of the same component."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"),
                                                F.greatest("a", "b").alias("b")).distinct(),
                   f"{name}-edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("root"))
        for _ in range(2):
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hooks = (hooks.join(ends, "root", "left")
                     .select("node", F.coalesce("next", "root").alias("root")))
        hooks = stored(hooks, f"{name}-hooks")
        if found is None:
            found = hooks
        else:
            on = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(on, "root", "left")
                           .select("node", F.coalesce("next", "root").alias("root")),
                           f"{name}-found")
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(left, "a").join(right, "b").where("ra <> rb")
                       .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                       .distinct(), f"{name}-edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
