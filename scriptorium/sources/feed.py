"""Change feeds: numbered batches as a streaming source with offsets, and tables that take them in idempotently.

A feed is a folder with a sub-folder for each batch, ``batch=00000001`` and so on, each written once by a Spark job and complete
when its ``_SUCCESS`` is there. ``spark.readStream.format("change_feed").schema(..).load(folder)`` gives their rows; its offset is the
number of the last batch read, so that a restart goes on from there and a failed micro-batch is read again as it was. Batches count up to the
first that is missing or incomplete.

:class:`ChangeTable` keeps the last change of each key. Rows are dealt into buckets by key, and a version, one for each micro-batch,
holds the buckets that the micro-batch touched; of a bucket the newest version counts. Deletions stay as rows, so that what comes
late or twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.sources.folders import filesystem

BUCKETS = 32
# what a task holds of a file: rows, which may be whole texts, and bytes of each column read ahead
BATCH_ROWS, READ_BYTES = 512, 1 << 20


def publish(changes: DataFrame, folder: str, number: int) -> None:
    """Writes one batch of a feed."""
    changes.write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")


@dataclass
class Piece(InputPartition):
    batch: int
    file: str


class _Feed:
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.wanted = folder, to_arrow_schema(schema)

    def _complete(self, after: int) -> int:
        fs, place = filesystem(self.folder)
        while fs.get_file_info(f"{place}/batch={after + 1:08d}/_SUCCESS").type == pafs.FileType.File:
            after += 1
        return after

    def _pieces(self, first: int, last: int) -> Sequence[InputPartition]:
        fs, place = filesystem(self.folder)
        files = lambda n: fs.get_file_info(pafs.FileSelector(f"{place}/batch={n:08d}"))
        return [Piece(n, f.path) for n in range(first + 1, last + 1) for f in files(n) if f.base_name.endswith(".parquet")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f, buffer_size=READ_BYTES).iter_batches(BATCH_ROWS, columns=[x.name for x in self.wanted if x.name != "batch"]):
                columns = [pa.array([partition.batch] * batch.num_rows, x.type) if x.name == "batch" else batch.column(x.name).cast(x.type) for x in self.wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=self.wanted)


class FeedReader(_Feed, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self._pieces(0, self._complete(0))


class FeedStreamReader(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        return {"batch": self._complete(0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self._pieces(start["batch"], end["batch"])


class ChangeFeed(DataSource):
    """Rows of a feed with the schema that the reader asks for; a long column ``batch``, if wanted, is the number of a row's batch."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        raise ValueError("change_feed is read with a schema of its rows")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeedReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return FeedStreamReader(self.options["path"], schema)


class ChangeTable:
    """The last change of each key, below ``folder``; ``order`` (columns) says which of two changes of a key is the later."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder, schema, keys, order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, before: int | None = None) -> DataFrame:
        fs, place = filesystem(self.folder + "/index")
        versions = [int(f.base_name.split("=")[1]) for f in fs.get_file_info(pafs.FileSelector(place, allow_not_found=True)) if f.base_name.startswith("version=")]
        versions = sorted(v for v in versions if before is None or v < before)
        if not versions:
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())]))
        index = self.spark.read.schema("bucket int, version long").option("basePath", self.folder + "/index").parquet(*[f"{self.folder}/index/version={v}" for v in versions])
        newest = index.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
        kept = self.spark.read.schema(T.StructType([*self.schema, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])).option("basePath", self.folder + "/rows").parquet(*[f"{self.folder}/rows/version={v}" for v in versions])
        return kept.join(F.broadcast(newest), ["bucket", "version"]).drop("version")

    def rows(self) -> DataFrame:
        return self._read().drop("bucket")

    def apply(self, changes: DataFrame, version: int) -> None:
        """Takes in changes as a version; a version that is applied again is written again from what lay before it."""
        new = changes.select(*self.schema.names).withColumn("bucket", self._bucket())
        touched = new.select("bucket").distinct()
        both = self._read(version).join(F.broadcast(touched), "bucket", "left_semi").unionByName(new)
        rest = [c for c in self.schema.names if c not in self.keys]
        last = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("last")).select("bucket", *self.keys, "last.*")
        last.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/version={version}")
        # the version counts from here on
        touched.write.mode("overwrite").parquet(f"{self.folder}/index/version={version}")


def follow(spark: SparkSession, feed: str, schema: T.StructType, checkpoint: str, take: Callable[[DataFrame, int], None]) -> None:
    """Gives the rows of a feed's new batches to ``take(rows, number)``, in one micro-batch of the number, which a restart repeats if it had failed."""
    spark.dataSource.register(ChangeFeed)
    rows = spark.readStream.format("change_feed").schema(schema).load(feed)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


FILE_CHANGE = T.StructType(_fields(T.StringType(), "source_id", "snapshot_id", "kind", "path", "content") + _fields(T.LongType(), "batch"))
SEEN = T.StructType(_fields(T.StringType(), "source_id", "snapshot_id") + _fields(T.LongType(), "batch", "earlier"))


class SourceTable:
    """The files of sources after full and delta syncs; a row of FILE_CHANGE is an upsert, a delete, or (kind ``full``, path empty) the mark of a full sync.

    A full sync removes what came before it of its source, a delta removes its deleted paths; a path that a batch both deletes and
    brings is there. A snapshot of a source counts once, when it first comes: sent again under any number, it changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        changes = T.StructType([*FILE_CHANGE, T.StructField("rank", T.IntegerType())])
        self.files = ChangeTable(spark, folder + "/files", changes, ["source_id", "path"], ["batch", "rank"], buckets)
        self.snapshots = ChangeTable(spark, folder + "/snapshots", SEEN, ["source_id", "snapshot_id"], ["earlier"], buckets)

    def apply(self, changes: DataFrame, version: int) -> None:
        seen = changes.where("snapshot_id is not null").select("source_id", "snapshot_id", "batch").distinct().withColumn("earlier", -F.col("batch"))
        self.snapshots.apply(seen, version)
        first = self.snapshots.rows().select("source_id", "snapshot_id", F.col("batch").alias("first"))
        fresh = changes.join(first, ["source_id", "snapshot_id"], "left").where("first is null or first = batch")
        self.files.apply(fresh.withColumn("rank", (F.col("kind") == "upsert").cast("int")), version)

    def rows(self) -> DataFrame:
        """(source_id, snapshot_id, path, content, batch) of the files that are there."""
        state = self.files.rows()
        full = state.where("kind = 'full'").groupBy("source_id").agg(F.max("batch").alias("full"))
        there = state.where("kind = 'upsert'").join(full, "source_id", "left").where("full is null or batch >= full")
        return there.select("source_id", "snapshot_id", "path", "content", "batch")
