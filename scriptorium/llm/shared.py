"""Folders and files that the driver and all executors see, and the tables of a data set."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import sys
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


ROWS_PER_FILE = 1 << 19
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session on this machine alone, as in tests, gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.scriptorium.sharedDir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
            spark.conf.set("spark.scriptorium.sharedDir", base)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: its lineage ends there, and the plan has run once.

    ``rows``, where the caller knows about how many there are, keeps small tables to few files.
    """
    place = new_folder(df.sparkSession, label)
    (df if rows is None else df.coalesce(max(1, rows // ROWS_PER_FILE))).write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and its Python workers end at ``BATCH_BYTES``, where the session has no limit of its own: both
    sides hold several at a time, of rows that are whole documents. A longer row is a batch of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def drop_folder(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.delete_dir(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the folder of a table that :func:`stored` gave, once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_folder(folder)


@functools.cache
def lean() -> None:
    """Has this process give large freed arrays back to the system at once: Spark reuses its Python workers, which
    would otherwise keep the most that any task before them took."""
    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform == "linux":
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if not urlparse(uri).scheme:
        uri = "file://" + os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, pieces) -> int:
    """Writes a file under a name of its own and then moves it to ``uri``: a task that runs twice leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    half, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(half) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    fs.move(half, path)
    return size


def has_file(uri: str) -> bool:
    fs, path = filesystem(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def drop_file(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:  # another attempt of the task may have come first
        fs.delete_file(path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a shared file, memory-mapped. From a store without local paths, a copy is mapped that vanishes with the process."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as own:
        with fs.open_input_stream(path) as source:
            while piece := source.read(1 << 22):
                own.write(piece)
        own.flush()
        return np.memmap(own, np.uint8, "r") if own.tell() else np.zeros(0, np.uint8)
