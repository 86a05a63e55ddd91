"""Connected components by alternating large-star and small-star steps.

Each step takes a minimum per node, combined before its shuffle, and looks it up for
every edge. While the nodes are few the minima are broadcast; beyond that they are
written and joined by shuffle, where adaptive execution splits the edges of a node
with very many neighbours. No node's neighbours are gathered in one place. Every
round's edges are written to the shared folder, which ends the lineage; rounds grow
with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(rows: DataFrame, least: DataFrame, most: int, broadcast_rows: int) -> DataFrame:
    """``rows`` with their node's minimum; ``most``: how many rows ``least`` has at most."""
    return rows.join(F.broadcast(least), "u") if most <= broadcast_rows else common.looked_up(rows, least, "u", "inner", broadcast_rows)


def _large_star(edges: DataFrame, count: int, broadcast_rows: int) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and all its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = _with_least(both, least, 2 * count, broadcast_rows)
    return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, count: int, broadcast_rows: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of those neighbours. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least, count, broadcast_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60, broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """``node, component`` (least node of the component) for each node of ``edges`` (columns a and b, integers).

    Loops, repeated and reversed edges count once; edges with a null end are left
    out. No edges: no rows. A node without edges isn't listed.
    """
    spark = edges.sparkSession
    now = common.stored(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        # a large-star step keeps at most as many links as there are edges, twice over
        after = common.stored(_small_star(_large_star(now, state[0], broadcast_rows), 2 * state[0], broadcast_rows), "edges")
        new = _state(after)
        for path in {f.rpartition("/")[0] for f in now.inputFiles()}:
            common.delete_path(spark, path)
        now, old, state = after, state, new
        if old == new:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
