"""Graphs of customers, their segments and suppliers, a twin for each nation, rebuilt in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.plans.views import table
from scriptorium.sources.folders import shared_folder, stored
from scriptorium.sources.graphs import GraphTable

# a twin whose number leaves 1 by 5 is emptied; one that 3 divides keeps customers in credit, without suppliers
_REBUILT = """e AS (SELECT c_nationkey AS twin, c_custkey * 4::BIGINT AS position, c_name AS name, c_acctbal AS credit, false AS supplier FROM customer
  UNION ALL SELECT c_nationkey, c_custkey * 4::BIGINT + 1, c_mktsegment, c_acctbal, false FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey * 4::BIGINT + 2, s_name, NULL, true FROM supplier),
r AS (SELECT DISTINCT c_nationkey AS twin, c_custkey * 4294967296::BIGINT + l_suppkey AS position, c_name AS source, s_name AS target, c_acctbal AS credit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT c_nationkey, -c_custkey::BIGINT - 1, c_name, c_mktsegment, c_acctbal FROM customer),
k AS (SELECT * FROM e WHERE twin % 5 <> 1 AND (twin % 3 <> 0 OR (NOT supplier AND credit > 0))),
l AS (SELECT twin, lower(name) AS name, max(position) AS at FROM k GROUP BY ALL)
SELECT twin::BIGINT AS twin_id, 'entity' AS kind, position, name, NULL::BIGINT AS src, NULL::BIGINT AS dst FROM k
UNION ALL SELECT r.twin::BIGINT, 'relation', position, NULL, x.at, y.at FROM r JOIN l x ON x.twin = r.twin AND x.name = lower(source) JOIN l y ON y.twin = r.twin AND y.name = lower(target)
WHERE r.twin % 5 <> 1 AND (r.twin % 3 <> 0 OR credit > 0)"""


@query("j36_graph_rebuild", "WITH " + _REBUILT)
def graph_rebuild(spark, sf_dir):
    """All graphs are built, then some are rebuilt, twice, from extractions that hold less or nothing."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    person, place = F.col("c_custkey").cast("long"), F.col("c_nationkey").alias("twin_id")
    entities = customers.select(place, (person * 4).alias("position"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), "c_acctbal")
    entities = entities.unionByName(customers.select(place, (person * 4 + 1).alias("position"), F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"), "c_acctbal"))
    firms = suppliers.select(F.col("s_nationkey").alias("twin_id"), (F.col("s_suppkey").cast("long") * 4 + 2).alias("position"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    entities = entities.unionByName(firms, allowMissingColumns=True)
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    sales = pairs.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    relations = sales.select(place, (person * (1 << 32) + F.col("l_suppkey")).alias("position"), F.upper("c_name").alias("source"), F.col("s_name").alias("target"), F.lit("buys_from").alias("type"), "c_acctbal")
    relations = relations.unionByName(customers.select(place, (-person - 1).alias("position"), F.col("c_name").alias("source"), F.lower("c_mktsegment").alias("target"), F.lit("in_segment").alias("type"), "c_acctbal"))
    relations = stored(relations, "relations")  # each rebuild would join the sales anew
    graph = GraphTable(spark, shared_folder(spark, "graph"))
    everyone = entities.select("twin_id").distinct()
    graph.rebuild(everyone, entities, relations)
    again = everyone.where("twin_id % 3 = 0 or twin_id % 5 = 1")
    less = F.expr("twin_id % 5 <> 1 and c_acctbal > 0")
    for _ in range(2):
        graph.rebuild(again, entities.where(less), relations.where(less))
    none = F.lit(None).cast("long")
    nodes = graph.entities().select("twin_id", F.lit("entity").alias("kind"), "position", "name", none.alias("src"), none.alias("dst"))
    return nodes.unionByName(graph.relations().select("twin_id", F.lit("relation").alias("kind"), "position", F.lit(None).cast("string").alias("name"), "src", "dst"))
