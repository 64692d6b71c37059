"""Tables of (key, value) in sorted shards of a shared folder, which scanning tasks memory-map.

A scan that needs few of its rows elsewhere looks them up here, rather than being shuffled whole to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from scriptorium.llm.shared import map_file, new_folder, put_file
from scriptorium.llm.textscan import ragged


def write_lookup(pairs: DataFrame, label: str) -> tuple[str, int]:
    """Writes (key long, value long), repeated keys included; returns the folder and the number of shards."""
    spark = pairs.sparkSession
    folder, shards = new_folder(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.filter(table.column("key").is_valid())
        keys, values = (table.column(c).to_numpy() for c in ("key", "value"))
        order = np.lexsort((values, keys))
        put_file(f"{folder}/{shard:05d}.bin", [keys[order].tobytes(), values[order].tobytes()])
        return pa.table({"shard": pa.array([shard], pa.int32())})

    dealt = pairs.where("key is not null").select("key", "value", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
    none = F.lit(None).cast("long")  # a shard without keys has a file too, so that a missing one is an error
    every = spark.range(shards).select(none.alias("key"), none.alias("value"), F.col("id").cast("int").alias("shard"))
    dealt.unionByName(every).groupBy("shard").applyInArrow(write, "shard int").count()
    return folder, shards


class Lookup:
    def __init__(self, place: tuple[str, int]):
        self.folder, self.shards = place
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            data = map_file(f"{self.folder}/{k:05d}.bin").view(np.int64)
            self._open[k] = data[: len(data) // 2], data[len(data) // 2 :]
        return self._open[k]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (place in ``keys``, value) of the table."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        shard = keys % self.shards
        for k in np.unique(shard).tolist():
            have, values = self._shard(k)
            mine = np.flatnonzero(shard == k)
            lo, hi = np.searchsorted(have, keys[mine], "left"), np.searchsorted(have, keys[mine], "right")
            at.append(np.repeat(mine, hi - lo))
            found.append(values[np.repeat(lo, hi - lo) + ragged(hi - lo)])
        return np.concatenate(at), np.concatenate(found)


def filter_rows(df: DataFrame, key: str, place: tuple[str, int], keep: bool = True) -> DataFrame:
    """The rows of ``df`` whose long ``key`` the table has, or with ``keep`` false lacks; no row is shuffled. A null key counts as lacking."""
    schema = T.StructType([T.StructField("row", df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(place)
        for batch in batches:
            keys = batch.column(1)
            there = np.zeros(batch.num_rows, bool)
            there[lookup.find(keys.fill_null(0).to_numpy(zero_copy_only=False))[0]] = True
            there &= keys.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(there == keep))], names=["row"])

    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key].alias("key")).mapInArrow(run, schema).select("row.*")
