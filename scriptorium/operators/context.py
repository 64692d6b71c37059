"""Texts for a language model, put together within budgets: retrieved excerpts of a question, and what is remembered of a twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators import conversation as cv, policy

PART_GAP = "\n\n---\n\n"
NO_EXCERPTS = "(No specific excerpts retrieved for this query — answer from the knowledge overview above.)"
NO_SOURCES = "(none)"
MEMORY_CHUNKS, MEMORY_CHARS = 200, 80_000
SHARES = 32


def _in_order(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), PART_GAP)


def excerpts(asked: DataFrame, best: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, context) for each (query_id) of ``asked``: its chunks (query_id, rank, chunk_id) whole, by rank, each under its path and with lines that hold a secret replaced. ``texts`` is (chunk_id, source_ref, content)."""
    label = F.when(F.coalesce("source_ref", F.lit("")) != "", F.concat(F.lit("["), "source_ref", F.lit("]\n"))).otherwise("")
    wanted = texts.join(best.select("chunk_id").distinct(), "chunk_id", "left_semi")  # each text is redacted once, however many questions want it
    parts = wanted.select("chunk_id", F.concat(label, policy.redact(F.coalesce("content", F.lit("")))).alias("part"))
    joined = best.select("query_id", "rank", "chunk_id").join(parts, "chunk_id").groupBy("query_id").agg(_in_order("rank", "part").alias("context"))
    return asked.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_EXCERPTS)).alias("context"))


def source_lines(sources: DataFrame, group: str) -> DataFrame:
    """(group, sources): a line for each source with its type, and its status unless it is ready."""
    kind = F.replace(F.coalesce("source_type", F.lit("")), F.lit("_"), F.lit(" "))
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("Unnamed")), F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""), F.when(F.col("status") == "ready", "").otherwise(F.concat(F.lit(" ["), F.coalesce("status", F.lit("")), F.lit("]"))))
    return sources.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda s: s["line"]), "\n").alias("sources"))


def memory_context(chunks: DataFrame, group: str = "twin_id", rows: int = MEMORY_CHUNKS, total: int = MEMORY_CHARS) -> DataFrame:
    """(group, chunks, context) from (group, chunk_id, chunk_type, source_ref, content): the first chunks of each group that fit the budget, in order.

    Which those are is told from ids and lengths, by shares of each group first; only the texts of chosen ones are moved.
    """
    sized = chunks.select(group, "chunk_id", F.length(F.coalesce("content", F.lit(""))).alias("size"))
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(SHARES)).alias("share")
    early = cv.budget_prefix(sized.select("*", F.struct(F.col(group), share).alias("part")), "part", [F.col("chunk_id")], F.lit(0), rows, 0).select(group, "chunk_id", "size")
    chosen = cv.budget_prefix(early, group, [F.col("chunk_id")], F.col("size"), rows, total).select(group, "chunk_id")
    text = F.concat(F.lit("["), F.coalesce("chunk_type", F.lit("")), F.lit("] "), F.coalesce("source_ref", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return chunks.join(chosen, [group, "chunk_id"], "left_semi").select(group, "chunk_id", text.alias("text")).groupBy(group).agg(F.count("*").alias("chunks"), _in_order("chunk_id", "text").alias("context"))
