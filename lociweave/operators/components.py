"""Connected components by alternating star contraction, as joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.sources.scratch import forget, written

#: Rounds that no input needs; a guard against endless loops only (each round squares the reach of a label).
MAX_ROUNDS = 60


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself."""
    forked = links.groupBy("u").count().where("count > 1").select("u").limit(1)
    chained = links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u").limit(1)
    return forked.union(chained).isEmpty()


def _mins(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, written so that a join with it has plain exchanges, whose hot keys can be split."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for every node of `edges` (columns a, b of one orderable type, undirected).

    component_id is the smallest node that can be reached. Nodes without edges do not appear: the caller knows them.
    Self links, repeated links and rows with a null end are allowed; the latter two count once and never.
    Every round is two joins on the node, whose hot keys adaptive execution splits; the state is one row for
    each node and is written to the shared folder, so nothing is gathered anywhere.
    """
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _stars(links):
            break
        # large star: the larger neighbours of a node move to the smallest neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_mins(both).withColumn("m", F.least("u", "m")), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of these
        near = large.join(_mins(large), "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct())
        forget(links)
        links = after
    else:
        raise ArithmeticError(f"components have not settled after {MAX_ROUNDS} rounds")
    own = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(own)
