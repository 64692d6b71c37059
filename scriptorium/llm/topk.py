"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: a dimension is a term, a non-zero weight a posting.
Queries and candidates are packed into blocks, and every block of queries meets every block of
candidates. There, for each query, the postings of its terms are weighted and scattered into a
dense array of scores, one term at a time; a partition selection keeps the best k of the block,
and a final ranking over the blocks' survivors merges them. Nothing is pruned, so the result is exact.

Defined results: a vector that is null, or has a null or non-finite component, takes no part, nor
has a row with a null id; an empty vector scores 0 with every other; vectors of unequal length meet
in the dimensions they share; ties go to the smaller id; rows with the query's own id are not
candidates of it, and repeated rows of another id are candidates each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.shared import stored, table

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096


def integer_weights(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double"))))


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows of (id, weights) packed as coordinate lists: ids, and (row, term, weight) sorted by term."""

    def pack(ids: list, rows: list) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.concatenate([np.arange(len(r)) for r in rows] or [np.zeros(0, np.int64)])
        weight = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
        order = np.lexsort((row, term))
        order = order[weight[order] != 0]
        columns = [np.array(ids, np.int64), row[order].astype(np.int32), term[order].astype(np.int32), weight[order]]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "rows", "terms", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield pack(ids, rows)

    return df.mapInArrow(run, "ids binary, rows binary, terms binary, weights binary")


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[prefix + name], kind) for name, kind in (("ids", np.int64), ("rows", np.int32), ("terms", np.int32), ("weights", np.int64)))


def best_of_blocks(query: tuple, candidates: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of the block for each query."""
    q_ids, q_rows, q_terms, q_weights = query
    ids, rows, terms, weights = candidates
    cuts = np.searchsorted(terms, np.arange(int(max(terms.max(initial=-1), q_terms.max(initial=-1))) + 2))
    order = np.argsort(q_rows, kind="stable")
    edges = np.searchsorted(q_rows[order], np.arange(len(q_ids) + 1))
    out = []
    for i, own in enumerate(q_ids.tolist()):
        scores = np.zeros(len(ids), np.int64)
        for j in order[edges[i] : edges[i + 1]].tolist():
            postings = slice(cuts[q_terms[j]], cuts[q_terms[j] + 1])
            scores[rows[postings]] += q_weights[j] * weights[postings]  # a row occurs once under a term
        left = np.flatnonzero(ids != own)
        if len(left) > k:
            least = -np.partition(-scores[left], k - 1)[k - 1]
            left = left[scores[left] >= least]
        best = left[np.lexsort((ids[left], -scores[left]))[:k]]
        out.append((np.full(len(best), own), ids[best], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query; both inputs are (vec_id, weights array<long>)."""
    # packed once each, into tables: a task of the join reads packed blocks of both sides
    left = stored(_blocks(queries.repartition(max(1, queries.count() // (16 * query_block))), query_block), "queries")
    right = stored(_blocks(candidates, candidate_block), "candidates")
    pairs = left.select(*[F.col(c).alias("q_" + c) for c in left.columns]).crossJoin(right.select(*[F.col(c).alias("c_" + c) for c in right.columns]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                found = best_of_blocks(_unpack(row, "q_"), _unpack(row, "c_"), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of ``embeddings`` for each row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integer_weights(F.col("embedding")).alias("weights")).where("vec_id is not null and weights is not null")
    return top_k(rows.where("vec_id % 100 = 0"), rows, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
