"""Connected components by contraction, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to node, label: every node that has an edge, with the least node of its component.

    In each round a node points to its least neighbour if that is less than itself;
    pointers are followed, and the edges left between different ends are the next
    round's. Only local minima stay, so the edges shrink fast, and the rows that all
    rounds handle are in proportion to the first one's. Minima are partial before they are shuffled, so a node with
    very many edges is no task's burden. Loops and repeated edges do no harm.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct())
    rounds: list[DataFrame] = []
    while True:
        up = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("up")).select(F.col("a").alias("node"), "up")
        for _ in range(2):
            over = up.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            up = up.join(over, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"))
        up = cut(up)
        rounds.append(up)
        first = up.select(F.col("node").alias("_n1"), F.col("up").alias("_u1"))
        second = up.select(F.col("node").alias("_n2"), F.col("up").alias("_u2"))
        left = both.where("a <> b").join(first, F.col("a") == F.col("_n1")).join(second, F.col("b") == F.col("_n2"))
        before, both = both, cut(left.where("_u1 <> _u2").select(F.col("_u1").alias("a"), F.col("_u2").alias("b")).distinct())
        forget(before)
        if not both.limit(1).count():
            break
    labels = rounds[0].select("node", F.col("up").alias("label"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        labels = labels.join(step, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_u", "label").alias("label"))
    labels = cut(labels)
    forget(both, *rounds)
    return labels
