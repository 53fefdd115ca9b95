"""Connected components of a table of links, in Spark rounds that each write a small table to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.common import salted_lookup
from .exact import stored


def _to_the_end(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, root) where roots may have roots themselves, by jumps that double."""
    while True:
        jump = parents.select(F.col("node").alias("root"), F.col("root").alias("further"))
        stepped = stored(salted_lookup(parents, jump, "root", F.col("node")).select("node", F.coalesce("further", "root").alias("root"),
                                                                                  (F.col("further") != F.col("root")).alias("moved")), "roots")
        parents = stepped.select("node", "root")
        if stepped.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): the root is the smallest node of the component.

    Every round each node takes its smallest neighbour, if smaller, as its parent; parents are followed to the end, and
    the links are drawn anew between the ends: what became one node stays as one, links within it go. So links shrink
    from round to round, and all rounds together handle little more than the links given. A node with many links is a
    hot key of joins with unique keys, which are salted, and of a min, which is combined before the shuffle; no
    neighbours are gathered.
    """
    ordered = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("l")
    left = stored(links.where("a <> b").select(ordered).select("l.*").distinct(), "links")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    steps: list[DataFrame] = []
    while not left.isEmpty():
        # the smaller end of a link is a parent for the larger one; a is its own
        parents = (left.select(F.col("b").alias("node"), F.col("a").alias("root")).union(left.select("a", "a"))
                   .groupBy("node").agg(F.min("root").alias("root")))
        step = _to_the_end(stored(parents, "parents"))
        steps.append(step)
        to = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        moved = salted_lookup(salted_lookup(left, to("a"), "a", F.col("b"), "inner"), to("b"), "b", F.col("a"), "inner")
        left = stored(moved.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
                      .distinct(), "links")
    if not steps:
        return nodes.withColumn("root", F.col("node"))
    # a round knows the roots of the round before; what it does not know is done
    roots = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        roots = salted_lookup(roots, further, "root", F.col("node")).select("node", F.coalesce("further", "root").alias("root"))
    return roots
