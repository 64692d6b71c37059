"""Entity graphs: directed views of relations, expansion by hops, and chunks of the entities found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MAX_NODES, MAX_DEPTH = 20, 2


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (edge_id, src, dst) from either end: (edge_id, node, neighbour). A loop is taken once."""
    return edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(edges.where("src <> dst").select("edge_id", F.col("dst").alias("node"), F.col("src").alias("neighbour")))


def expand(seeds: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH, nodes: int = MAX_NODES) -> DataFrame:
    """(query_id, node, depth, position) reached from seeds (query_id, node): breadth first, in the order of the node that found
    them and the edge, up to ``nodes`` for each question."""
    ways = both_ways(edges)
    first = Window.partitionBy("query_id").orderBy("node")
    reached = seeds.select("query_id", "node", F.lit(0).alias("depth"), F.row_number().over(first).alias("position"))
    for d in range(1, depth + 1):
        border = reached.where(F.col("depth") == d - 1)
        found = border.join(ways, "node").select("query_id", F.col("neighbour").alias("node"), F.struct("position", "edge_id").alias("way"))
        found = found.groupBy("query_id", "node").agg(F.min("way").alias("way")).join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")
        counts = reached.groupBy("query_id").agg(F.count("*").alias("have"))
        order = Window.partitionBy("query_id").orderBy("way")
        new = found.join(counts, "query_id").select("query_id", "node", F.lit(d).alias("depth"), (F.col("have") + F.row_number().over(order)).cast("int").alias("position"))
        reached = reached.unionByName(new.where(F.col("position") <= nodes))
    return reached
