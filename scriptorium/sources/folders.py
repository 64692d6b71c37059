"""Folders that the driver and all executors see."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name below spark.checkpoint.dir. Where that is unset, a session on this machine alone, as in tests, gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else "file://" + os.path.abspath(uri))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table in a shared folder: what many parts of a plan read is worked out once, and lost tasks don't repeat it."""
    place = shared_folder(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
