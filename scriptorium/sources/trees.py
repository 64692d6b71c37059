"""A folder tree of text files as a data source: ``spark.read.format("text_tree").load(root)``.

| option | meaning |
|-|-|
| ``pattern`` | which file names are read; ``*.md`` by default |
| ``source_id`` | the source that the rows name; the root by default |
| ``known`` | Parquet of (path, revision) from the last sync: the batch is a delta then, of new and changed files and of deleted paths |
| ``bytes`` | about how many bytes a task reads |

The driver lists the tree, as Spark does for its own file sources; tasks read the files, in shares of about equal size. Paths are
relative to the root, so that files of one name in two folders are two paths. A symbolic link that leads out of the root is not followed.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.sources.folders import filesystem

RAW_FILE = "source_id string, path string, content string, size_bytes long, revision string, change string, full boolean"
TASK_BYTES = 16 << 20
_SCHEMA = pa.schema([("source_id", pa.string()), ("path", pa.string()), ("content", pa.string()), ("size_bytes", pa.int64()), ("revision", pa.string()), ("change", pa.string()), ("full", pa.bool_())])


@dataclass
class Share(InputPartition):
    files: tuple[tuple[str, int, str], ...]  # path, size, revision
    deleted: tuple[str, ...] = ()


def validate(options: dict[str, str]) -> str:
    """The root that the options name; an error if there is no such folder."""
    root = options.get("path", "")
    if not root:
        raise ValueError("text_tree needs a folder to load")
    fs, place = filesystem(root)
    if fs.get_file_info(place).type != pafs.FileType.Directory:
        raise ValueError(f"{root} is not a folder")
    return root


def _listing(root: str, pattern: str) -> dict[str, tuple[int, str]]:
    """Size and revision (time and size) of each file below the root, by relative path."""
    fs, place = filesystem(root)
    found, local = {}, isinstance(fs, pafs.LocalFileSystem)
    for f in fs.get_file_info(pafs.FileSelector(place, recursive=True)):
        if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern):
            if not local or os.path.realpath(f.path).startswith(os.path.realpath(place) + os.sep):
                found[os.path.relpath(f.path, place)] = (f.size, f"{f.mtime_ns}:{f.size}")
    return found


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = validate(options)
        self.pattern, self.source = options.get("pattern", "*.md"), options.get("source_id", self.root)
        self.known, self.share = options.get("known"), int(options.get("bytes", TASK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        there, deleted = _listing(self.root, self.pattern), ()
        if self.known:
            fs, place = filesystem(self.known)
            before = pq.read_table(place, columns=["path", "revision"], filesystem=fs)
            seen = dict(zip(before.column("path").to_pylist(), before.column("revision").to_pylist()))
            deleted = tuple(sorted(p for p in seen if p not in there))
            there = {p: f for p, f in there.items() if seen.get(p) != f[1]}
        shares, held, size = [Share((), deleted)], [], 0
        for path, (n, revision) in sorted(there.items()):
            held.append((path, n, revision))
            size += n
            if size >= self.share:
                shares.append(Share(tuple(held)))
                held, size = [], 0
        return [*shares, Share(tuple(held))]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(self.root)
        full = not self.known
        for path, size, revision in partition.files:
            with fs.open_input_stream(f"{place}/{path}") as f:
                content = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (self.source, path, content, size, revision, "upsert", full)))], schema=_SCHEMA)
        if partition.deleted:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (self.source, path, None, None, None, "delete", full))) for path in partition.deleted], schema=_SCHEMA)


class TextTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return RAW_FILE

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextTree)
