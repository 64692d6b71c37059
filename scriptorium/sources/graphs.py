"""Stored entity graphs, of which a rebuild replaces those of some twins and leaves the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ENTITY = "twin_id long, position long, name string, type string, description string, source_refs array<string>, embedding array<double>"
RELATION = "twin_id long, position long, source string, target string, type string, description string"
STORED = "kind string, position long, name string, type string, description string, source_refs array<string>, embedding array<double>, src long, dst long, weight double, twin_id long"
ROWS_PER_FILE = 1 << 20


def _fit(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``; those that ``rows`` lacks are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


class GraphTable:
    """The entities and relations of twins, below ``folder``, in a partition for each twin.

    Entities are numbered by their place in the extraction. A relation joins entities of its twin by name, whatever the case;
    of several entities of a name it takes the last, and without both ends it isn't stored.

    A rebuild is one job with one commit for both kinds of rows, so that new entities never stand beside old relations. Each
    rebuilt twin also has a row of its own (kind ``twin``): it replaces what was there where the extraction is empty. Rebuilding
    again from the same extraction gives the same graph. Rows of null twins, or of twins that aren't rebuilt, are left out; null
    names are stored but nothing refers to them; rows that repeat a position stay, and a relation to them gets that position.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], STORED).write.mode("ignore").partitionBy("twin_id").parquet(folder)

    def rebuild(self, twins: DataFrame, entities: DataFrame, relations: DataFrame) -> None:
        """The twins of ``twins`` (twin_id) get the graphs of their rows of ``entities`` and ``relations``, columns as in ENTITY and RELATION."""
        named = twins.select(F.col("twin_id").cast("long").alias("twin_id")).where("twin_id is not null").distinct()
        own = _fit(entities, ENTITY).join(named, "twin_id", "left_semi").withColumn("source_refs", F.coalesce("source_refs", F.array().cast("array<string>")))
        last = own.where("name is not null").groupBy("twin_id", F.lower("name").alias("key")).agg(F.max("position").alias("at"))
        end = lambda name, at: last.select("twin_id", F.col("key").alias(name), F.col("at").alias(at))
        asked = _fit(relations, RELATION).join(named, "twin_id", "left_semi").withColumn("source_key", F.lower("source")).withColumn("target_key", F.lower("target"))
        found = asked.join(end("source_key", "src"), ["twin_id", "source_key"]).join(end("target_key", "dst"), ["twin_id", "target_key"])
        rows = named.withColumn("kind", F.lit("twin"))
        for kind, part in (("entity", own), ("relation", found.drop("source", "target", "source_key", "target_key").withColumn("weight", F.lit(1.0)))):
            rows = rows.unionByName(part.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        # a twin of any size is cut into files, and a small one has few
        dealt = _fit(rows, STORED).repartition("twin_id", "kind", F.floor(F.col("position") / ROWS_PER_FILE))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("twin_id").parquet(self.folder)

    def _rows(self, kind: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.folder).where(F.col("kind") == kind)

    def entities(self) -> DataFrame:
        return self._rows("entity").select("twin_id", "position", "name", "type", "description", "source_refs", "embedding")

    def relations(self) -> DataFrame:
        return self._rows("relation").select("twin_id", "position", "src", "dst", "type", "description", "weight")
