"""Evidence contracts: lineage, root hashes, structure inventories, index health, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MEMORY_TYPES = ("memory_brief", "memory_artifact")
SYNTHETIC_TYPES = ("career_summary", "experience_entry", "project_description", "skill_profile", "manual_note")
FILE_TYPES = ("google_drive", "markdown", "pdf", "url")
MAX_DEPTH, MAX_GROUPS = 4, 50


def lineage(chunk_type: Column, source_type: Column) -> Column:
    return (
        F.when(chunk_type.isin(*MEMORY_TYPES), "memory_derived")
        .when(chunk_type.isin(*SYNTHETIC_TYPES) | (source_type == "manual"), "synthetic_profile")
        .when(source_type.isin(*FILE_TYPES), "file_backed")
        .otherwise("connector_segment")
    )


def strict_ready(kind: Column, snapshot: Column, digest: Column, start: Column, end: Column, segment: Column) -> Column:
    filled = lambda c: c.isNotNull() & (c != "")
    whole = filled(snapshot) & filled(digest) & filled(segment) & start.isNotNull() & end.isNotNull() & (start <= end)
    return F.when(kind.isin("synthetic_profile", "memory_derived"), True).otherwise(F.coalesce(whole, F.lit(False)))


def root_hash(df: DataFrame, key: str, path: str, digest: str) -> DataFrame:
    """(key, root_hash): the hash of the sorted distinct ``path:hash`` lines of each key."""
    lines = df.select(key, F.concat(path, F.lit(":"), digest).alias("line")).distinct()
    return lines.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("root_hash"))


def parent_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "_root").otherwise(F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(MAX_DEPTH))), "/"))


def structure_inventory(paths: DataFrame, key: str, path: str) -> DataFrame:
    """(key, folder, position, files): the first folders by depth, number of files and name, with their sorted paths."""
    clean = paths.select(key, F.regexp_replace(path, "^/+|/+$", "").alias("path")).where("path <> ''").distinct()
    grouped = clean.groupBy(key, parent_folder(F.col("path")).alias("folder")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    depth = F.when(F.col("folder") == "_root", 0).otherwise(F.size(F.split("folder", "/")))
    order = Window.partitionBy(key).orderBy(depth, -F.size("files"), "folder")
    return grouped.withColumn("position", F.row_number().over(order)).where(F.col("position") <= MAX_GROUPS).select(key, "folder", "position", "files")


def patch_paths(current: Column, deleted: Column, added: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(current, deleted), added))


def stale_after(source_type: Column) -> Column:
    return F.when(source_type == "google_drive", 48).when(source_type.isin("pdf", "markdown", "url"), 72).otherwise(168)


def freshness(updated: Column, as_of: Column, limit_hours: Column) -> list[Column]:
    seconds = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 1e6
    hours = F.bround(seconds / 3600, 2)
    return [hours.alias("age_hours"), F.floor(seconds / 60).cast("long").alias("age_minutes"), (seconds / 3600 >= limit_hours).alias("is_stale")]
