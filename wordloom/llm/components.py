"""Connected components of a link table, by alternating large-star and small-star rounds.

Both rounds are a minimum per node (combined before the shuffle) and an equi-join, so that a node
with very many links splits over tasks by adaptive skew handling. Each round is written to the
shared folder; the former one is removed. Rounds grow with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import discard, stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (a, b) with a > b; returns such links."""
    if large:
        rows = links.union(links.select(F.col("b"), F.col("a")))
    else:
        rows = links
    least = rows.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = rows.join(least, rows["a"] == least["node"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").union(least.where("node <> least").select("node", "least").toDF("a", "b"))
    return moved.where("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the smallest node of its component.

    ``links`` has two columns of one ordered type; direction, repeats and loops don't matter; a
    link with a null end is ignored. An empty table gives an empty table.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = stored(edges, "components")
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        after = stored(_star(_star(edges, True), False), "components")
        discard(edges)
        edges = after
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
