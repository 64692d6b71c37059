"""Connectors: manual notes and folders of text files as batches of raw files, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_NOTE_CHARS = 50_000
RAW_FILE = "path string, content string, size_bytes long, revision string"


def manual_notes(notes: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Notes of up to MAX_NOTE_CHARS under a path made from their title; longer ones and nulls are left out."""
    name = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    kept = notes.where(F.length(content) <= MAX_NOTE_CHARS)
    return kept.select(F.concat(F.lit("manual/"), name, F.lit(".md")).alias("path"), F.col(content).alias("content"), F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("revision"))


def text_folder(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """The text files below a folder, each whole, with a revision of its time and size. Nothing outside the folder is read.
    A file goes by its name alone, so that files of one name in different folders are one path."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root, wholetext=True)
    meta = F.col("_metadata")
    revision = F.concat_ws(":", F.unix_micros(meta["file_modification_time"]).cast("string"), meta["file_size"].cast("string"))
    return files.select(meta["file_name"].alias("path"), F.col("value").alias("content"), meta["file_size"].alias("size_bytes"), revision.alias("revision"))


_CONNECTORS: dict[str, Callable[..., DataFrame]] = {"manual": manual_notes, "markdown": text_folder}


def connector(kind: str) -> Callable[..., DataFrame]:
    """The connector of a source type; an unknown type is an error."""
    if kind not in _CONNECTORS:
        raise ValueError(f"no connector for source type {kind!r}; there are {sorted(_CONNECTORS)}")
    return _CONNECTORS[kind]
