"""Embedding whitening by a tall-and-skinny QR: no covariance of the vectors is ever formed.

1. Components become integers, floor(64 * c), and the distinct integer vectors are the fit list, a table.
2. Their sums are exact: tasks add up high and low halves, Spark adds those as decimals. Rows are centred by whole
   quotient and remainder of sum / n, so that nothing is lost before the first multiplication.
3. Each task folds its centred rows into one triangular factor, batch by batch; factors are merged ``FAN`` at a time,
   level by level, until one is left.
4. The right singular vectors of that factor are the components, its singular values over sqrt(n) their deviations.
   A pass over the fit list then measures how far the whitened covariance is from the identity.

Only sums by dimension, one factor and the sums of the check reach the driver: all bounded by the dimension.

Adding a constant to all components, as the contract's 1000000, changes no centred value, so none is added.

Defined results: a vector that is null or empty, or has a null or non-finite component, takes no part, and neither does
one whose length isn't that of most of the fit list (ties: the longer). Rows with a null id or that repeat an id are
each reported; copies of a vector count once in the fit. A component whose singular value is zero to double precision
has no whitened form and is left out, so a fit list of one vector, like an empty table, gives an empty result. A
deviation beyond 64 bits is null. The sign of a component makes its largest entry positive; equal eigenvalues come in
the order of the decomposition. Other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.shared import drop_table, stored, table
from scriptorium.llm.topk import integer_weights

SCALE = 64
COMPONENTS = 16
FAN = 8  # factors that one task merges
BLOCK_ROWS = 1024  # of a task's rows are decomposed at a time, and at least twice the dimension


class Centre(NamedTuple):
    """The exact mean of n integer vectors: sum = n * whole + rest, dimension by dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, y: np.ndarray) -> np.ndarray:
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return _less(y, whole).astype(np.float64) - np.array(rest, np.float64) / self.n

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * y - sum) ** 2 for each row, as whole numbers."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        off = _less(y, whole)
        largest = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0)))) + 1
        if y.shape[1] * (self.n * largest) ** 2 >= 1 << 62:
            off = off.astype(object)
        apart = off * self.n - np.array(rest, off.dtype)
        return [s if s < 1 << 63 else None for s in (apart * apart).sum(1).tolist()]


def _less(y: np.ndarray, whole: tuple[int, ...]) -> np.ndarray:
    if max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))), *map(abs, whole)) >= 1 << 62:
        return y.astype(object) - np.array(whole, object)
    return y - np.array(whole, np.int64)


class Whitening(NamedTuple):
    centre: Centre
    vectors: np.ndarray  # a unit eigenvector in each row
    values: np.ndarray  # their eigenvalues, falling
    trace: float

    def apply(self, y: np.ndarray) -> np.ndarray:
        return self.centre.centred(y) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame) -> tuple[int, ...]:
    """The sum of each dimension of ``fit`` (y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0))
                h, l = (y >> 32).sum(0), (y & 0xFFFFFFFF).sum(0)
                high, low = (h, l) if high is None else (high + h, low + l)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    parts = fit.mapInArrow(run, "at int, high long, low long").groupBy("at").agg(whole("high"), whole("low"))
    return tuple((int(r.high) << 32) + int(r.low) for r in sorted(parts.collect(), key=lambda r: r["at"]))  # a row for each dimension


def triangular(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factor(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows of ``fit`` (y): a factor for each task, merged by a tree."""
    d = len(centre.sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, count = np.zeros((0, d)), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(centre.centred(_matrix(batch.column(0))))
                count += batch.num_rows
            if count >= max(BLOCK_ROWS, 2 * d):
                r, held, count = triangular(np.concatenate([r, *held])), [], 0
        if held or len(r):
            yield _factor_row(TaskContext.get().partitionId(), triangular(np.concatenate([r, *held])))

    def merge(key: tuple, factors: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x).reshape(-1, d) for x in factors.sort_by("k").column("r").to_pylist()]
        return pa.Table.from_batches([_factor_row(key[0].as_py(), triangular(np.concatenate(rows)))])

    parts = stored(fit.mapInArrow(local, "k int, r binary"), "factors")
    last, merged = parts.agg(F.max("k")).first()[0], parts
    while last:
        last //= FAN
        merged = merged.groupBy(F.floor(F.col("k") / FAN).cast("int").alias("grp")).applyInArrow(merge, "k int, r binary")
    r = np.frombuffer(merged.first().r).reshape(-1, d)
    drop_table(parts)
    return r


def _factor_row(k: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["k", "r"])


def fit_list(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The distinct vectors of ``rows`` (y), as a table, of the commonest length; that length and their number (0, 0 without any)."""
    every = stored(rows.select("y").distinct(), "fit")
    most = every.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (most["d"], most["count"]) if most else (0, 0)
    return every.where(F.size("y") == d), d, n


def fit_whitening(fit: DataFrame, n: int, components: int) -> Whitening:
    centre = Centre(n, exact_sums(fit))
    r = factor(fit, centre)
    _, s, vectors = np.linalg.svd(r, full_matrices=False)
    there = s > (s[0] if len(s) else 0.0) * max(n, r.shape[1]) * np.finfo(float).eps
    kept = vectors[there][:components]
    kept = kept * np.where(np.take_along_axis(kept, np.abs(kept).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    return Whitening(centre, kept, (s * s / n)[there][:components], float((s * s).sum() / n))


def identity_error(fit: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance, less the identity."""
    c = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c))
        for batch in batches:
            if batch.num_rows:
                w = found.apply(_matrix(batch.column(0)))
                total[:c] += w.T @ w
                total[c] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "part"])

    parts = fit.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()  # components ** 2 + components rows
    total = np.array([r.part for r in sorted(parts, key=lambda r: r["at"])]).reshape(c + 1, c)
    mean = total[c] / found.centre.n
    return float(np.abs(total[:c] / found.centre.n - np.outer(mean, mean) - np.eye(c)).max())


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each usable vector of ``df`` and each of the first components: its key, and the columns of WHITENED."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {WHITENED}"
    rows = df.select(df[key].alias("key"), integer_weights(df[vector], scale).alias("y")).where("y is not null and size(y) > 0")
    fit, d, n = fit_list(rows)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    found = fit_whitening(fit, n, components)
    if not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    off = identity_error(fit, found)
    drop_table(fit)
    c, explained = len(found.values), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(1))
            each = np.repeat(np.arange(len(y)), c)
            columns = [
                pa.array(np.tile(np.arange(1, c + 1), len(y)), pa.int32()),
                pa.array(np.full(len(each), n), pa.int64()),
                pa.array(found.centre.deviations(y), pa.int64()).take(pa.array(each)),
                pa.array(found.apply(y).ravel()),
                pa.array(np.tile(explained, len(y))),
                pa.array(np.full(len(each), off)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), *columns], names=[key, *(x.split()[0] for x in WHITENED.split(", "))])

    return rows.where(F.size("y") == d).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every usable row of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
