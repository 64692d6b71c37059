"""Sinks that replace, merge or complete a table, as frames that a writer then puts in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def replace_by_source(current: DataFrame, new: DataFrame, source: str = "source_id") -> DataFrame:
    """All rows of the sources in ``new`` give way to it."""
    return current.join(new.select(source).distinct(), source, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def replace_by_paths(current: DataFrame, new: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = ("source_id", "source_ref")) -> DataFrame:
    """Rows of deleted and of incoming paths give way to ``new``."""
    gone = deleted.select(*keys).union(new.select(*keys)).distinct()
    return current.join(gone, list(keys), "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``current`` lacks, one for each key."""
    return new.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys)


def delete_returning(current: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows went for each key."""
    removed = current.join(gone.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("removed"))
    return current.join(gone.select(*keys).distinct(), keys, "left_anti"), removed


def violations(chunks: DataFrame) -> DataFrame:
    """Rows of file-backed and connector chunks that lack what the contract asks for."""
    bound = F.col("lineage").isin("file_backed", "connector_segment")
    whole = F.coalesce(F.col("source_ref").isNotNull() & F.col("snapshot_id").isNotNull() & F.col("segment_id").isNotNull() & F.col("content_hash").isNotNull() & (F.col("start_line") <= F.col("end_line")), F.lit(False))
    return chunks.where(bound & ~whole)
