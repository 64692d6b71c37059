"""Hybrid retrieval for a whole set of questions: candidate layers, fusion, diversity, top-k, routing.

The question set is the small side. It is broadcast only while its measured size is below
``BROADCAST_QUESTIONS`` rows; beyond, chunks are dealt into ``SLICES`` and each slice of a twin's chunks is met with a
copy of its questions, so that no twin's pairs are one task's. Vectors are searched block by block against the packed vectors
of the questions, as long as those take ``PACKED_VALUES`` numbers at most: a task sends on its own best chunks of each question only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

MIN_SCORE = 0.15
DEMOTION = 0.62
MAX_PER_SOURCE = 2
DENSE_BUDGET, LEXICAL_BUDGET, PATH_BUDGET = 8, 6, 4
GUARANTEED_TOTAL, GUARANTEED_PER_REF = 8, 2
HYDRATION_BUDGET = 8
MAX_TOKENS = 16
BROADCAST_QUESTIONS, SLICES = 20_000, 64
PACKED_VALUES, BLOCK_PAIRS, HELD_PAIRS = 1 << 23, 1 << 21, 1 << 18

# Words that lexical search passes over.
STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "your", "what", "where", "when", "which", "how", "does", "work", "walk", "through",
    "across", "covered", "projects", "project", "implemented", "implementation", "flow", "explain", "provide", "necessary",
)


def cosine(a: Column, b: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return total(F.zip_with(a, b, lambda x, y: x * y)) / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def few(rows: DataFrame) -> DataFrame:
    """Marked for broadcast while its counted size allows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS else rows


def met(rows: DataFrame, questions: DataFrame, *scope: str) -> DataFrame:
    """Rows (chunk_id, ..) joined with the questions of their scope, one column or several. That the questions are few enough to broadcast is counted, not assumed."""
    if questions.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS:
        return rows.join(F.broadcast(questions), list(scope))
    dealt = questions.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(SLICES)).cast("int")).join(dealt, [*scope, "slice"]).drop("slice")


def eligible(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of ready sources with their twin. Few sources are broadcast: dealt by source, the texts would meet in as many tasks as there are sources."""
    return chunks.join(few(sources.where("status = 'ready'").select("source_id", "twin_id", "workspace_id")), "source_id")


def top_per_query(df: DataFrame, order: list[Column], k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def vector_candidates(questions: DataFrame, chunks: DataFrame, k: int = DENSE_BUDGET, snippets: bool = False, scope: str = "twin_id", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, chunk_id, source_ref, twin_id, score): for each of ``keys`` the ``k`` nearest chunks of the question's scope that reach MIN_SCORE."""
    kinds = F.col("chunk_type") != "memory_brief"
    if not snippets:
        kinds &= F.col("chunk_type") != "code_snippet"
    ready = chunks.where(F.col("embedding").isNotNull() & kinds).select("chunk_id", "source_ref", "embedding", *dict.fromkeys((scope, "twin_id")))
    asked = questions.where("vector is not null").select("query_id", scope, "vector")
    packed = _packed(asked, scope)
    if packed is not None:
        return top_per_query(_nearest(ready, packed, k, scope, keys), [F.desc("score"), F.col("chunk_id")], k, keys)
    pairs = met(ready, asked, scope).withColumn("score", F.round(cosine(F.col("embedding"), F.col("vector")), 6))
    return top_per_query(pairs.where(F.col("score") >= MIN_SCORE).select("query_id", "chunk_id", "source_ref", "twin_id", "score"), [F.desc("score"), F.col("chunk_id")], k, keys)


def _packed(asked: DataFrame, scope: str) -> pa.Table | None:
    """Keys, scopes and vectors of the questions, if their measured size is small; null otherwise."""
    size = asked.limit(BROADCAST_QUESTIONS + 1).agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("values")).first()
    return asked.select("query_id", scope, "vector").toArrow() if size.n <= BROADCAST_QUESTIONS and (size["values"] or 0) <= PACKED_VALUES else None


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of so many components, and their unit vectors; a null component is not a number."""
    rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == width)
    x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(ready: DataFrame, packed: pa.Table, k: int, scope: str, keys: tuple[str, ...]) -> DataFrame:
    """(query_id, chunk_id, source_ref, twin_id, score): of each task its ``k`` best chunks for each question, or for each twin of a question if ``keys`` say so."""
    packed = packed.combine_chunks()
    column = lambda name: packed.column(name).chunk(0) if packed.num_rows else pa.array([], packed.schema.field(name).type)
    query_ids, scopes, vectors = column("query_id"), np.array(packed.column(scope).to_pylist(), object), column("vector")
    by_twin = "twin_id" in keys
    blocks = []  # of questions of one scope whose vectors have one length
    for width in sorted({n for n in vectors.value_lengths().to_pylist() if n}):
        rows, unit = _matrix(vectors, width)
        for one in sorted(set(scopes[rows].tolist()), key=repr):
            mine = np.array([x == one for x in scopes[rows]])
            blocks.append((width, one, rows[mine], unit[mine]))
    fields = dict(zip(ready.columns, ready.schema.fields))
    schema = T.StructType([T.StructField("question", T.IntegerType()), fields["chunk_id"], fields["source_ref"], fields["twin_id"], T.StructField("score", T.DoubleType())])

    def best(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held)
        question, score, chunk = (rows.column(c).to_numpy() for c in ("question", "score", "chunk_id"))
        group = question if not by_twin else np.unique(np.array([f"{q}/{t}" for q, t in zip(question.tolist(), rows.column("twin_id").to_pylist())], object).astype(str), return_inverse=True)[1]
        order = np.lexsort((chunk, -score, group))
        opens = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))
        return rows.take(pa.array(order[place < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            of = np.array(batch.column(scope).to_pylist(), object)
            for width in sorted({b[0] for b in blocks}):
                rows, unit = _matrix(batch.column("embedding"), width)
                for _, one, asked, vector in (b for b in blocks if b[0] == width):
                    mine = np.flatnonzero(np.array([x == one for x in of[rows]], bool)) if len(rows) else rows
                    for lo in range(0, len(mine), max(1, BLOCK_PAIRS // len(asked))):
                        part = mine[lo : lo + max(1, BLOCK_PAIRS // len(asked))]
                        score = np.floor(unit[part] @ vector.T * 1e6 + 0.5) / 1e6  # rounded half up, as everywhere
                        i, j = np.nonzero(score >= MIN_SCORE)
                        own = pa.array(rows[part[i]])
                        columns = {"question": pa.array(asked[j], pa.int32())} | {c: batch.column(c).take(own) for c in ("chunk_id", "source_ref", "twin_id")} | {"score": pa.array(score[i, j])}
                        held.append(pa.table(columns))
                        if sum(t.num_rows for t in held) > HELD_PAIRS:
                            held = [best(held)]
        if held:
            yield from best(held).combine_chunks().to_batches()

    found = ready.select("chunk_id", "source_ref", "embedding", *dict.fromkeys((scope, "twin_id"))).mapInArrow(run, schema)
    names = ready.sparkSession.createDataFrame(pa.table({"question": pa.array(np.arange(len(query_ids)), pa.int32()), "query_id": query_ids}))
    return found.join(F.broadcast(names), "question").select("query_id", "chunk_id", "source_ref", "twin_id", "score")


RUN = "[a-z0-9_./-]{3,}"


def query_tokens(text: Column) -> Column:
    """Distinct search words: path-like ones first, then those naming a week, then long ones, longest first, then the rest in order."""
    found = F.regexp_extract_all(text, F.lit(r"[a-zA-Z_][a-zA-Z0-9_./-]{1,}"), 0)
    words = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"^[.,;:!?)\]}]+|[.,;:!?)\]}]+$", "")))
    kept = F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS))
    rank = lambda x: F.when(x.contains("/") | x.contains("."), 0).when(x.rlike(r"week\d+"), 1).when(F.length(x) >= 10, 2).otherwise(3)
    keyed = F.transform(kept, lambda x, i: F.struct(rank(x).alias("p"), F.when(rank(x) < 3, -F.length(x)).otherwise(0).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def substring_candidates(questions: DataFrame, chunks: DataFrame, k: int = LEXICAL_BUDGET) -> DataFrame:
    """(query_id, chunk_id, source_ref, score): chunks of the twin holding any search word, by the number of words held.

    A search word is held by a text exactly if it is held by a run of search-word characters there. So the distinct runs of each
    chunk are met with the words of its twin, by the word's first three characters. The words are few enough to broadcast if their count says
    so, and then all is done where the chunk is read, up to the chunk's distinct words.
    """
    asked = questions.select("query_id", "twin_id", F.explode(F.slice(query_tokens(F.col("query")), 1, MAX_TOKENS)).alias("token"))
    rows = chunks.where("chunk_type <> 'memory_brief' and coalesce(source_ref, '') not like '__memory__/%'").select("chunk_id", "twin_id", "source_ref", F.concat(F.lower(F.coalesce("source_ref", F.lit(""))), F.lit("\n"), F.lower(F.coalesce("content", F.lit("")))).alias("low"))
    runs = rows.select("chunk_id", "twin_id", "source_ref", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(RUN), 0))).alias("run"))
    tokens = asked.select("twin_id", "token", F.substring("token", 1, 3).alias("gram")).distinct()
    at = runs.select("*", F.explode(F.sequence(F.lit(1), F.length("run") - 2)).alias("at")).withColumn("gram", F.substr("run", F.col("at"), F.lit(3)))
    held = at.join(few(tokens), ["twin_id", "gram"]).where(F.substr("run", F.col("at"), F.length("token")) == F.col("token"))
    # the chunk's rows are dealt by chunk, and stay there until its questions are counted
    chunk = ("chunk_id", "twin_id", "source_ref")
    found = held.groupBy(*chunk).agg(F.collect_set("token").alias("tokens"))
    counted = found.select(*chunk, F.explode("tokens").alias("token")).join(few(asked), ["twin_id", "token"]).groupBy("query_id", *chunk).agg(F.count("*").alias("hits"))
    scored = counted.select("query_id", "chunk_id", "source_ref", F.round(F.least(F.lit(0.9), 0.32 + 0.08 * F.col("hits")), 6).alias("score"))
    return top_per_query(scored, [F.desc("score"), F.col("source_ref"), F.col("chunk_id")], k)


def path_candidates(hints: DataFrame, chunks: DataFrame, k: int = PATH_BUDGET, snippets: bool = False) -> DataFrame:
    """(query_id, hint, chunk_id, source_ref, score) for (query_id, twin_id, hint, vector): chunks whose path starts so, embedded ones first.
    The wildcards of LIKE in a hint keep their meaning.

    Chunks are met with the distinct hints of their twin. Those without an embedding are the same for all questions that share a hint, so
    that ``k`` of them are kept for each hint before questions are joined; only embedded ones are compared with every question.
    """
    rows = chunks if snippets else chunks.where("chunk_type <> 'code_snippet'")
    place = ("twin_id", "hint")
    there = rows.select("chunk_id", "twin_id", "source_ref", "embedding").join(few(hints.select(*place).distinct()), "twin_id").where("lower(source_ref) like concat(hint, '%')")
    by_path = [F.lower("source_ref"), F.col("chunk_id")]
    bare = top_per_query(there.where("embedding is null").drop("embedding"), by_path, k, place).drop("rank").join(few(hints.select("query_id", *place)), list(place)).withColumn("near", F.lit(None).cast("double"))
    embedded = met(there.where("embedding is not null").withColumn("own", norm(F.col("embedding"))), hints.select("query_id", *place, "vector", norm(F.col("vector")).alias("asked")), *place)
    dot = F.aggregate(F.zip_with("embedding", "vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    columns = ("query_id", "hint", "chunk_id", "source_ref", "near")
    both = bare.select(*columns).unionByName(embedded.withColumn("near", F.round(dot / (F.col("own") * F.col("asked")), 6)).select(*columns))
    return top_per_query(both.withColumn("score", F.coalesce("near", F.lit(0.5))), [F.col("near").isNull(), F.desc("near"), *by_path], k, ("query_id", "hint"))


def fuse(candidates: DataFrame) -> DataFrame:
    """Of candidates (query_id, chunk_id, source_ref, score, reason, layer, rank): one row for each chunk, its best score, and its reasons as first seen."""
    seen = F.array_sort(F.collect_list(F.struct("layer", "rank", "reason")))
    return candidates.groupBy("query_id", "chunk_id").agg(
        F.min_by("source_ref", F.struct("layer", "rank")).alias("source_ref"), F.max("score").alias("score"), F.array_distinct(F.transform(seen, lambda s: s["reason"])).alias("match_reasons"), F.min(F.struct("layer", "rank")).alias("first")
    )


def demote(pool: DataFrame) -> DataFrame:
    """In pools of four and more, a source's rows after its second best lose part of their score."""
    order = [F.desc("score"), F.col("chunk_id")]
    place = F.row_number().over(Window.partitionBy("query_id", F.coalesce(F.nullif("source_ref", F.lit("")), F.lit("__empty__"))).orderBy(*order))
    many = F.count("*").over(Window.partitionBy("query_id")) >= 4
    return pool.withColumn("score", F.round(F.when(many & (place > MAX_PER_SOURCE), F.col("score") * DEMOTION).otherwise(F.col("score")), 6))


def guaranteed(candidates: DataFrame, total: int = GUARANTEED_TOTAL, each: int = GUARANTEED_PER_REF) -> DataFrame:
    """Of (query_id, ref_no, rank, ..): up to ``each`` rows of each reference, ``total`` in all, in the references' order."""
    own = top_per_query(candidates.withColumnRenamed("rank", "place"), [F.col("place")], each, ("query_id", "ref_no"))
    return top_per_query(own.drop("rank"), [F.col("ref_no"), F.col("place")], total).drop("place")


def route(candidates: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, twin_id, routing_score): of each question's best ``k`` candidates, the twin with the highest mean of its best three."""
    best = top_per_query(candidates.drop("rank"), [F.desc("score"), F.col("chunk_id")], k).drop("rank")
    threes = top_per_query(best, [F.desc("score"), F.col("chunk_id")], 3, ("query_id", "twin_id"))
    means = threes.groupBy("query_id", "twin_id").agg(F.round(F.avg("score"), 8).alias("routing_score"), F.min(F.struct(-F.col("score"), F.col("chunk_id"))).alias("first"))
    return top_per_query(means, [F.desc("routing_score"), F.col("first")], 1).select("query_id", "twin_id", "routing_score")


def layer_hits(fused: DataFrame) -> DataFrame:
    reasons = fused.select("query_id", F.explode("match_reasons").alias("reason"))
    return reasons.groupBy("query_id", F.substring_index("reason", ":", 1).alias("layer")).agg(F.count("*").alias("hits"))
