"""Knowledge-base tables derived from the base tables, for Spark and, as SQL, for the oracles.

=============  ==========================================================================================
sources        one row for each ``source``: type, status, twin and workspace
chunks         one row for each document: content, path, type, and an embedding where one exists
questions      one row for each benchmark item: text, twin and a query vector
messages       conversations
edges          two relations for each embedded entity
=============  ==========================================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPES = ("google_drive", "markdown", "pdf", "manual", "url")
SNIPPET_EVERY, MEMORY_EVERY = 17, 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number() -> F.Column:
    return F.substring("source", 4, 9).cast("int")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sn = F.col("source_id")
    return (
        table(spark, sf_dir, "documents").select(source_number().alias("source_id")).distinct().select(
            "source_id",
            F.concat(F.lit("src"), sn).alias("name"),
            F.element_at(F.array(*map(F.lit, TYPES)), sn % 5 + 1).alias("source_type"),
            F.when(sn % 10 == 9, "processing").when(sn % 10 == 8, "failed").otherwise("ready").alias("status"),
            (sn % 4).alias("twin_id"),
            (sn % 2).alias("workspace_id"),
        )
    )


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select(
        F.col("doc_id").alias("chunk_id"),
        source_number().alias("source_id"),
        F.col("text").alias("content"),
        F.concat("lang", F.lit("/"), "source", F.lit("/part"), F.col("doc_id") % 5, F.lit(".md")).alias("source_ref"),
        F.when(F.col("doc_id") % SNIPPET_EVERY == 0, "code_snippet").when(F.col("doc_id") % MEMORY_EVERY == 0, "memory_brief").otherwise("documentation").alias("chunk_type"),
    )
    if not vectors:
        return out
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return out.join(found, "chunk_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    items = table(spark, sf_dir, "benchmark")
    return items.join(vectors, "item_id", "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % 4).cast("int").alias("twin_id"), "vector")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    return ids.select(F.explode(F.array(*[F.struct((F.col("vec_id") * 2 + k).alias("edge_id"), F.col("vec_id").alias("src"), ((m * F.col("vec_id") + a) % 500).alias("dst")) for k, m, a in ((0, 7, 1), (1, 13, 5))])).alias("e")).select("e.*")


SQL = """
src AS (
  SELECT DISTINCT substr(source, 4)::INT AS source_id FROM documents
), sources AS (
  SELECT source_id, concat('src', source_id) AS name,
         ['google_drive', 'markdown', 'pdf', 'manual', 'url'][source_id % 5 + 1] AS source_type,
         CASE WHEN source_id % 10 = 9 THEN 'processing' WHEN source_id % 10 = 8 THEN 'failed' ELSE 'ready' END AS status,
         source_id % 4 AS twin_id, source_id % 2 AS workspace_id
  FROM src
), chunks AS (
  SELECT d.doc_id AS chunk_id, substr(d.source, 4)::INT AS source_id, d.text AS content,
         concat(lang, '/', source, '/part', doc_id % 5, '.md') AS source_ref,
         CASE WHEN doc_id % 17 = 0 THEN 'code_snippet' WHEN doc_id % 11 = 0 THEN 'memory_brief' ELSE 'documentation' END AS chunk_type,
         e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), questions AS (
  SELECT b.item_id AS query_id, b.text AS query, (b.item_id % 4)::INT AS twin_id, e.embedding::DOUBLE[] AS vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
), edges AS (
  SELECT vec_id * 2 AS edge_id, vec_id AS src, (7 * vec_id + 1) % 500 AS dst FROM embeddings
  UNION ALL SELECT vec_id * 2 + 1, vec_id, (13 * vec_id + 5) % 500 FROM embeddings
)
"""


def with_views(body: str) -> str:
    """An oracle over the derived tables: ``body`` goes on with more common tables or the final SELECT."""
    return "WITH RECURSIVE " + SQL.strip() + ("\n, " if not body.lstrip().upper().startswith("SELECT") else "\n") + body.strip()
