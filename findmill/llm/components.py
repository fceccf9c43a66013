"""Connected components of a link table by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id reachable, itself included.

    Null ends and loops are ignored, repeated links are one. Each round points every node at its smallest
    neighbour, follows the pointers to their roots by doubling, and goes on with the links between roots. At
    least half of the nodes that still have links vanish per round. Smallest neighbours are found with a partial
    minimum before the shuffle, so a node that a third of all links touch is a few rows per task.
    """
    rest = materialise(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    result = None
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).select("id", F.least("id", "up").alias("up"))
        root = materialise(root, "roots")
        while True:
            above = root.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            root = materialise(root.join(above, "up").select("id", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "roots")
            if root.filter("moved").isEmpty():
                break
        root = root.select("id", "up")
        if result is None:
            result = root
        else:
            result = result.join(root.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up", "left").select("id", F.coalesce("upper", "up").alias("up"))
        ends = rest.join(root.select(F.col("id").alias("a"), F.col("up").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("up").alias("rb")), "b")
        rest = materialise(ends.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if result is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return materialise(result.select("id", F.col("up").alias("component")), "components")
