"""Whole retrieval of many questions at once, and the evidence packets that answers are written and checked against.

A question is asked of one twin under a key of any type: the same question asked of several twins is several keys, so that a workspace is
searched by the same plan as a twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators import retrieval as rt, search
from scriptorium.sources.folders import stored

# What counts as a file in a text, and what moves a file up or down in a packet.
FILE = r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+|[A-Za-z0-9_.-]+\.(?:py|ts|tsx|js|jsx|json|yaml|yml|sql|md|toml|go|java|rb|php|rs)"
QUOTED = r"`([^`\n]{1,200})`"
MEMORY = "__memory__/"
LATE_FILES, EARLY_TOPICS = r"(agents\.md|claude\.md|\.docx)$|/templates/", "auth|logout|refresh|session|token|dashboard"
CONTRACT_NOTES = "JWT/token validation establishes identity\nDo not say JWT is the authorization layer by itself"
LAYERS = ("vector", "lexical", "path", "guaranteed")


def lexical_candidates(asked: DataFrame, chunks: DataFrame, k: int = rt.LEXICAL_BUDGET, fallback: bool = True, density: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, source_ref, score, rank): full-text rows of each question; of questions without any, substring rows.

    ``density`` is what :func:`search.cover_density` gives for these questions, where the caller has it.
    """
    columns = ["query_id", "chunk_id", "source_ref", "score", "rank"]
    scored = search.cover_density(asked, chunks.where("chunk_type <> 'memory_brief'")) if density is None else density
    full = rt.top_per_query(scored.withColumn("score", search.lexical_score(F.col("density"))), [F.desc("score"), F.col("chunk_id")], k).select(*columns)
    if not fallback:
        return full
    full = stored(full, "full")
    return full.unionByName(rt.substring_candidates(asked.join(full.select("query_id").distinct(), "query_id", "left_anti"), chunks, k).select(*columns))


def retrieve(asked: DataFrame, chunks: DataFrame, hints: DataFrame, refs: DataFrame, k: int = 8, density: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best chunks of each (query_id, twin_id, query, vector), and the questions (query_id) that lexical search found nothing for.

    Layers: nearest vectors, full text or else substrings, paths that start with a hint (query_id, twin_id, hint, vector), and paths
    named by refs (query_id, twin_id, hint, ref_no, vector), a few of each. They are fused, demoted by source and cut at ``k``:
    query_id, rank, chunk_id, source_ref, score, match_reasons.
    """
    columns = ["query_id", "chunk_id", "source_ref", "score", "reason", "layer", "rank"]
    layer = lambda rows, no, reason: rows.withColumn("reason", reason).withColumn("layer", F.lit(no)).select(*columns)
    by_path = F.concat(F.lit("path:"), "hint")
    lexical = stored(lexical_candidates(asked, chunks, density=density), "lexical")
    named = rt.path_candidates(refs.drop("ref_no"), chunks).join(refs.select("query_id", "hint", "ref_no"), ["query_id", "hint"])
    parts = [
        layer(rt.vector_candidates(asked, chunks), 0, F.lit("vector")),
        layer(lexical, 1, F.lit("lexical")),
        layer(rt.path_candidates(hints, chunks), 2, by_path),
        layer(rt.guaranteed(named), 3, by_path),
    ]
    fused = rt.fuse(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    best = rt.top_per_query(rt.demote(fused), [F.desc("score"), F.col("chunk_id")], k).select("query_id", "rank", "chunk_id", "source_ref", "score", "match_reasons")
    return best, asked.select("query_id").join(lexical.select("query_id").distinct(), "query_id", "left_anti")


def looks_like_path(token: Column) -> Column:
    low = F.lower(F.trim(token))
    return (low != "") & ~low.startswith(MEMORY) & ~low.contains("@") & low.rlike(f"^(?:{FILE})$")


def memory_refs(provenance: Column, content: Column) -> Column:
    """The files behind a memory chunk, with how they are known: those of its provenance, or else those that its text names."""
    known = F.filter(F.coalesce(provenance, F.array().cast("array<string>")), looks_like_path)
    text = F.coalesce(content, F.lit(""))
    told = F.concat(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), 1), lambda x: F.trim(x)), F.regexp_extract_all(text, F.lit(FILE), 0))
    as_refs = lambda paths, how: F.transform(F.array_distinct(paths), lambda p: F.struct(p.alias("path"), F.lit(how).alias("how")))
    return F.when(F.size(known) > 0, as_refs(known, "memory:provenance")).otherwise(as_refs(F.filter(told, looks_like_path), "memory:content"))


def file_priority(path: Column, reasons: Column) -> Column:
    low = F.lower(path)
    points = F.when(low.startswith(MEMORY), 40).otherwise(0) + F.when(low.rlike(LATE_FILES), 20).otherwise(0)
    return points - F.when(F.exists(reasons, lambda r: r.rlike("^(symbol|file|path)(:|$)")), 15).otherwise(0) - F.when(low.rlike(EARLY_TOPICS), 8).otherwise(0)


def evidence_packets(asked: DataFrame, best: DataFrame, details: DataFrame, missing: DataFrame) -> DataFrame:
    """A row for each (query_id, ..) of ``asked``, with its columns and

    * ``spans``: its chunks by rank, with path, type, source, lines, score and reasons;
    * ``files``: the paths of its chunks, and the files behind those of memory, each once with all reasons as first seen, by priority;
    * ``layer_hits``: how often each layer is a reason, and files at least as often as there are any;
    * ``missing``: what (query_id, reason) of ``missing`` says, sorted.

    ``details`` is (chunk_id, chunk_type, path, source_id, start_line, end_line, content, provenance).
    """
    rows = best.join(details, "chunk_id")
    span = F.struct("rank", "chunk_id", "chunk_type", "path", "source_id", "start_line", "end_line", "score", F.col("match_reasons").alias("reasons"))
    spans = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    own = F.array(F.struct(F.col("path"), F.lit("").alias("how")))
    of_memory = F.col("path").isNull() | (F.col("path") == "") | F.col("path").startswith(MEMORY)
    refs = rows.select("query_id", "rank", "match_reasons", F.posexplode(F.when(of_memory, memory_refs(F.col("provenance"), F.col("content"))).otherwise(own)).alias("no", "ref"))
    how = F.when(F.col("ref.how") == "", F.col("match_reasons")).otherwise(F.concat(F.array("ref.how"), "match_reasons"))
    each = refs.select("query_id", F.col("ref.path").alias("path"), "rank", "no", how.alias("how"))
    seen = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "no", "how"))), lambda s: s["how"])))
    by_path = each.groupBy("query_id", "path").agg(seen.alias("reasons")).withColumn("priority", file_priority(F.col("path"), F.col("reasons")))
    files = by_path.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("priority", "path", "reasons"))).alias("files"))
    counted = rows.select("query_id", F.explode("match_reasons").alias("reason")).groupBy("query_id", F.substring_index("reason", ":", 1).alias("layer")).agg(F.count("*").alias("hits"))
    hits = counted.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "hits"))).alias("hits"))
    gaps = missing.groupBy("query_id").agg(F.array_sort(F.collect_set("reason")).alias("missing"))
    out = asked.join(spans, "query_id", "left").join(files, "query_id", "left").join(hits, "query_id", "left").join(gaps, "query_id", "left")
    no_hits = F.coalesce("hits", F.create_map().cast("map<string,bigint>"))
    there = F.size(F.coalesce("files", F.array())).cast("long")
    with_files = F.when(there > 0, F.map_concat(F.map_filter(no_hits, lambda k, v: k != "file"), F.create_map(F.lit("file"), F.greatest(there, F.coalesce(F.try_element_at(no_hits, F.lit("file")), F.lit(0)))))).otherwise(no_hits)
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    kinds = dict(out.dtypes)
    return out.select(*asked.columns, empty("spans", kinds["spans"]).alias("spans"), empty("files", kinds["files"]).alias("files"), with_files.alias("layer_hits"), empty("missing", "array<string>").alias("missing"))


def file_anchors(files: Column) -> Column:
    """A line for each file of a packet, with its reasons."""
    return F.transform(files, lambda f: F.concat(F.lit("  - "), f["path"], F.lit(" ["), F.coalesce(F.nullif(F.array_join(f["reasons"], ", "), F.lit("")), F.lit("file")), F.lit("]")))


def _block(lines: list[Column]) -> Column:
    return F.array_join(F.filter(F.flatten(F.array(*lines)), lambda x: x.isNotNull()), "\n")


def answer_contract(mode: Column, intent: Column, layers: Column, files: Column, missing: Column) -> Column:
    """What an answer has to keep to, from a packet; ``layers`` is an array."""
    joined = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("—"))
    head = F.array(F.lit("<answer_contract>"), F.concat(F.lit("mode: "), mode), F.concat(F.lit("intent: "), F.coalesce(intent, F.lit("—"))), F.concat(F.lit("searched_layers: "), joined(layers)))
    anchors = F.when(F.size(files) > 0, F.concat(F.array(F.lit("file_anchors:")), file_anchors(files))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing_evidence: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.concat(_block([head, anchors, gaps, F.array(*map(F.lit, [*CONTRACT_NOTES.split("\n"), "</answer_contract>"]))]), F.lit("\n"))


def workspace_contract(projects: Column) -> Column:
    """The same for the projects (name, mode, files) of a workspace, in their order; a null mode says that there is no packet."""
    anchors = lambda p: F.when(F.size(p["files"]) > 0, F.concat(F.lit("file_anchors:\n"), F.array_join(file_anchors(p["files"]), "\n"), F.lit("\n"))).otherwise("")
    opening = lambda p: F.concat(F.lit('<project name="'), p["name"], F.lit('">'))
    one = lambda p: F.when(p["mode"].isNull(), F.concat(opening(p), F.lit("(no evidence packet)</project>"))).otherwise(F.concat(opening(p), F.lit("\nmode: "), p["mode"], F.lit("\n"), anchors(p), F.lit("give each project a real implementation summary\n</project>")))
    body = F.array_join(F.transform(projects, one), "\n")
    return F.when(F.size(projects) > 0, F.concat(F.lit("<workspace_answer_contract>\n"), body, F.lit("\n</workspace_answer_contract>\n"))).otherwise("")
