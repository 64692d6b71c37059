"""Small operators: config and access predicates, budgets, snapshot ids, dates, JSON, event rates and feeds."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.operators import conversation as cv, retrieval as rt
from scriptorium.plans.registry import query
from scriptorium.plans.retrieval import _HINTS, _LAYERS, _base, _fused
from scriptorium.plans.views import chunks, sources, table, with_views
from scriptorium.sources import tables as sinks
from scriptorium.streaming import metrics

# Tokens of a document's structure that leaked into its text.
NOISE = (r"\bendobj\b", r"\b\d+\s+\d+\s+R\b", r"/Type\s*/", r"/StructElem", r"/ParentTree", r"<</", r"\bstream\r?\n", r"\bendstream\b", r"/Root\s", r"/Size\s", r"startxref", r"trailer\s*<<", r"%%EOF")
_LEAKED = "CASE doc_id % 3 WHEN 0 THEN concat(substr(text, 1, 90), ' 12 0 R endobj /Type /Page xref startxref trailer << %%EOF') WHEN 1 THEN text ELSE '  ' END"


@query(
    "a07_noise_score",
    f"""WITH t AS (SELECT doc_id, {_LEAKED} AS t FROM documents),
    n AS (SELECT doc_id, t, {" + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in NOISE)} AS hits, len(regexp_extract_all(t, '[\\x00-\\x08\\x0E-\\x1F]')) AS controls FROM t)
    SELECT doc_id, round(CASE WHEN trim(t) = '' THEN 1.0 ELSE (hits * 4 + controls) / length(t) END, 6)::DOUBLE AS score, (CASE WHEN trim(t) = '' THEN 1.0 ELSE (hits * 4 + controls) / length(t) END) > 0.025 AS rejected FROM n""",
)
def noise_score(spark, sf_dir):
    """Four times the structure tokens, and control characters, by length; a blank text is noise."""
    t = F.col("t")
    hits = sum((F.regexp_count(t, F.lit(p)) for p in NOISE[1:]), F.regexp_count(t, F.lit(NOISE[0])))
    score = F.when(F.trim(t) == "", 1.0).otherwise((hits * 4 + F.regexp_count(t, F.lit(r"[\x00-\x08\x0E-\x1F]"))) / F.length(t))
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_LEAKED).alias("t")).select("doc_id", score.alias("s")).select("doc_id", F.round("s", 6).alias("score"), (F.col("s") > 0.025).alias("rejected"))


@query("a17_scan_by_key", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def scan_by_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "lang", "n_chars")


@query("a19_delete_returning", with_views("SELECT source_ref, count(*) AS removed FROM chunks WHERE source_ref IN (SELECT source_ref FROM chunks WHERE chunk_id % 97 = 0) GROUP BY source_ref"))
def delete_returning(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False)
    return sinks.delete_returning(rows, rows.where("chunk_id % 97 = 0"), ["source_ref"])[1]


@query("b05_snippet_decision", with_views("SELECT chunk_id, chunk_type <> 'code_snippet' OR source_id % 2 = 0 AS allowed, CASE WHEN chunk_type <> 'code_snippet' THEN 'not_code' WHEN source_id % 2 = 0 THEN 'snippets_allowed' ELSE 'snippets_disabled' END AS reason FROM chunks"))
def snippet_decision(spark, sf_dir):
    reason = F.when(F.col("chunk_type") != "code_snippet", "not_code").when(F.col("source_id") % 2 == 0, "snippets_allowed").otherwise("snippets_disabled")
    return chunks(spark, sf_dir, vectors=False).select("chunk_id", (reason != "snippets_disabled").alias("allowed"), reason.alias("reason"))


@query("b06_null_bytes", "SELECT doc_id, sha256(concat(text, 'x')) AS clean_sha256 FROM documents")
def null_bytes(spark, sf_dir):
    held = F.concat(F.lit("\0"), "text", F.lit("\0x\0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.translate(held, "\0", "").cast("binary"), 256).alias("clean_sha256"))


# Parts of keys that name secrets.
BANNED = ("password", "secret", "token", "api_key", "access_token", "private_key", "client_secret", "auth_token")


@query("b08_config_scrub", "SELECT page_id, array_to_string(list_filter([concat('file_path=', page_id), CASE WHEN page_id % 2 = 0 THEN concat('url=', url) END], lambda x: x IS NOT NULL), ';') AS kept FROM pages")
def config_scrub(spark, sf_dir):
    raw = F.create_map(F.lit("url"), F.when(F.col("page_id") % 2 == 0, F.col("url")), F.lit("My_Api_Key"), F.lit("x"), F.lit("file_path"), F.col("page_id").cast("string"), F.lit("TOKENS"), F.lit("y"), F.lit("clientSecretRef"), F.lit("z"))
    kept = F.map_filter(raw, lambda k, v: v.isNotNull() & ~F.exists(F.array(*map(F.lit, BANNED)), lambda b: F.lower(k).contains(b)))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("kept"))


_HAS = "source_id % 2 = 0 AS has_path, source_id % 3 = 0 AS has_content, source_id % 4 < 2 AS has_folder, source_id % 5 = 1 AS has_file, source_id % 7 < 5 AS has_url"


@query(
    "b09_config_errors",
    with_views(f"""c AS (SELECT source_id, source_type, {_HAS} FROM sources)
    SELECT source_id, CASE WHEN source_type = 'pdf' AND NOT has_path THEN 'file_path' WHEN source_type = 'markdown' AND NOT (has_content OR has_path) THEN 'content or file_path' WHEN source_type = 'google_drive' AND NOT (has_folder OR has_file) THEN 'folder_id or file_id'
      WHEN source_type = 'url' AND NOT has_url THEN 'url' WHEN source_type = 'manual' AND NOT has_content THEN 'content' END AS missing FROM c"""),
)
def config_errors(spark, sf_dir):
    """What the configuration of a source lacks for its type, if anything."""
    rows = sources(spark, sf_dir).selectExpr("source_id", "source_type", *_HAS.split(", "))
    has = lambda *names: F.array_contains(F.array(*map(F.col, names)), True)
    kind = lambda name, *needs: (F.col("source_type") == name) & ~has(*needs)
    missing = F.when(kind("pdf", "has_path"), "file_path").when(kind("markdown", "has_content", "has_path"), "content or file_path").when(kind("google_drive", "has_folder", "has_file"), "folder_id or file_id").when(kind("url", "has_url"), "url").when(kind("manual", "has_content"), "content")
    return rows.select("source_id", missing.alias("missing"))


@query(
    "b15_surface_sessions",
    """WITH s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 > 0 THEN conv_id % 4 END AS twin_id, conv_id % 2 AS workspace_id FROM conversations),
    f AS (SELECT * FROM (VALUES (1, 0, NULL), (2, 3, NULL), (3, NULL, 1), (4, NULL, NULL)) AS f(surface_id, twin_id, workspace_id))
    SELECT conv_id, surface_id::INT AS surface_id FROM s JOIN f ON CASE WHEN f.twin_id IS NOT NULL THEN s.twin_id = f.twin_id ELSE s.workspace_id = f.workspace_id AND s.twin_id IS NULL END""",
)
def surface_sessions(spark, sf_dir):
    """Sessions by the shared surface that they belong to: one of a twin, or of a workspace if they have no twin."""
    n = F.col("conv_id")
    sessions = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.when(n % 3 > 0, (n % 4).cast("int")).alias("twin_id"), (n % 2).cast("int").alias("workspace_id"))
    surfaces = spark.createDataFrame([(1, 0, None), (2, 3, None), (3, None, 1), (4, None, None)], "surface_id int, twin_id int, workspace_id int")
    of_twins = sessions.join(surfaces.where("twin_id is not null").select("surface_id", "twin_id"), "twin_id")
    of_workspaces = sessions.where("twin_id is null").join(surfaces.where("twin_id is null").select("surface_id", "workspace_id"), "workspace_id")
    return of_twins.select("conv_id", "surface_id").unionByName(of_workspaces.select("conv_id", "surface_id"))


@query("c07_chunks_in_refs", with_views("r AS (SELECT DISTINCT concat('en/src', vec_id % 20, '/part', vec_id % 5, '.md') AS source_ref FROM embeddings WHERE label < 4) SELECT chunk_id, source_ref FROM chunks WHERE source_ref IN (SELECT source_ref FROM r)"))
def chunks_in_refs(spark, sf_dir):
    n = F.col("vec_id")
    refs = table(spark, sf_dir, "embeddings").where("label < 4").select(F.array(F.concat(F.lit("en/src"), n % 20, F.lit("/part"), n % 5, F.lit(".md"))).alias("refs"))
    return chunks(spark, sf_dir, vectors=False).join(refs.select(F.explode("refs").alias("source_ref")), "source_ref", "left_semi").select("chunk_id", "source_ref")


@query("c08_hydrated_topk", with_views(_LAYERS + " SELECT v.query_id, v.rank::INT AS rank, v.chunk_id, c.chunk_type, s.name AS source_name, length(c.content) AS chars FROM vec v LEFT JOIN chunks c USING (chunk_id) LEFT JOIN sources s USING (source_id)"))
def hydrated_topk(spark, sf_dir):
    """The best chunks with what is known of them and their source; rows without a match pass through."""
    best = rt.vector_candidates(*_base(spark, sf_dir)).select("query_id", "rank", "chunk_id")
    known = chunks(spark, sf_dir, vectors=False).select("chunk_id", "source_id", "chunk_type", F.length("content").cast("long").alias("chars"))
    return best.join(known, "chunk_id", "left").join(sources(spark, sf_dir).select("source_id", F.col("name").alias("source_name")), "source_id", "left").select("query_id", "rank", "chunk_id", "chunk_type", "source_name", "chars")


@query("d03_debug_totals", with_views("SELECT source_id, chunk_type, count(*) AS chunks, count(embedding) AS embedded FROM chunks GROUP BY GROUPING SETS ((), (source_id), (chunk_type))"))
def debug_totals(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("source_id", "chunk_type", "embedding")
    total = lambda *keys: rows.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    return total().unionByName(total("source_id"), True).unionByName(total("chunk_type"), True).select("source_id", "chunk_type", "chunks", "embedded")


@query("d04_status_histogram", with_views("SELECT status, count(*) AS sources FROM sources GROUP BY status"))
def status_histogram(spark, sf_dir):
    return sources(spark, sf_dir).groupBy("status").agg(F.count("*").alias("sources"))


@query("d13_merged_sets", with_views("d AS (SELECT DISTINCT twin_id, regexp_replace(source_ref, '/[^/]*$', '') AS dir, source_ref FROM chunks JOIN sources USING (source_id) WHERE status = 'ready') SELECT twin_id, dir, string_agg(source_ref, ',' ORDER BY source_ref) AS files FROM d GROUP BY ALL"))
def merged_sets(spark, sf_dir):
    ready = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    return ready.groupBy("twin_id", F.regexp_replace("source_ref", "/[^/]*$", "").alias("dir")).agg(F.array_join(F.array_sort(F.collect_set("source_ref")), ",").alias("files"))


@query("d18_relation_merge", with_views("SELECT src, dst, min(edge_id) AS edge_id FROM (SELECT src % 50 AS src, dst % 60 AS dst, edge_id FROM edges) WHERE dst < 50 GROUP BY ALL"))
def relation_merge(spark, sf_dir):
    """Relations by their ends, the first of each; those whose end is no entity are dropped."""
    from scriptorium.plans.views import edges

    rows = edges(spark, sf_dir).select((F.col("src") % 50).alias("src"), (F.col("dst") % 60).alias("dst"), "edge_id")
    entities = spark.range(50).select(F.col("id").alias("dst"))
    return rows.join(entities, "dst", "left_semi").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))


@query("d20_log_p95", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS period, event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def log_p95(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("period"), "event_type", "p95")


@query("e06_brief_budget", with_views("""o AS (SELECT twin_id, chunk_id, length(concat('[', source_ref, ']', chr(10), content)) AS n, row_number() OVER (PARTITION BY twin_id ORDER BY chunk_id) AS position FROM chunks JOIN sources USING (source_id) WHERE source_ref NOT LIKE '__memory__/%' AND content <> ''),
    s AS (SELECT *, sum(n) OVER (PARTITION BY twin_id ORDER BY position) AS spent FROM o) SELECT twin_id, chunk_id, spent::BIGINT AS spent FROM s WHERE spent <= 60000"""))  # fmt: skip
def brief_budget(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir), "source_id").where("source_ref not like '__memory__/%' and content <> ''")
    entry = F.length(F.concat(F.lit("["), "source_ref", F.lit("]\n"), "content"))
    return cv.budget_prefix(rows.select("twin_id", "chunk_id", entry.alias("n")), "twin_id", [F.col("chunk_id")], F.col("n"), 2**31 - 1, 60_000).select("twin_id", "chunk_id", "spent")


@query("e09_hydration_budget", with_views(_LAYERS + _HINTS + " SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 8) AS refreshed FROM fused WHERE chunk_id % 3 > 0"))
def hydration_budget(spark, sf_dir):
    """Which of a question's strict chunks of all layers are read anew: the best, within the budget."""
    strict = _fused(spark, sf_dir).where("chunk_id % 3 > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return strict.select("query_id", "chunk_id", (place <= rt.HYDRATION_BUDGET).alias("refreshed"))


@query("f08_newest_sessions", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 30")
def newest_sessions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(30)


@query("h02_vector_literal", "SELECT vec_id, round(embedding[1]::DOUBLE, 8) AS first, round(embedding[64]::DOUBLE, 8) AS last FROM embeddings")
def vector_literal(spark, sf_dir):
    literal = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(literal, 1).alias("first"), F.element_at(literal, 64).alias("last"))


@query("h08_retry_delay", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN (event_id % 60)::DOUBLE END, least(20.0, 0.5 * power(2, event_id % 8)))::DOUBLE AS delay FROM events")
def retry_delay(spark, sf_dir):
    asked = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 60).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(asked, F.least(F.lit(20.0), 0.5 * F.pow(F.lit(2.0), F.col("event_id") % 8))).alias("delay"))


@query(
    "i18_snapshot_id",
    """SELECT page_id, coalesce(CASE WHEN page_id % 11 = 0 THEN concat('sha', page_id) END, CASE WHEN page_id % 5 = 0 THEN concat('rev', page_id) END, CASE WHEN page_id % 3 = 0 THEN concat('drive:', page_id, ':', '2024-01-01') END,
      CASE WHEN page_id % 7 = 0 THEN concat('drive_cursor:', page_id) END, CASE WHEN page_id % 2 = 0 THEN concat('hash:', md5(url)) END) AS snapshot_id FROM pages""",
)
def snapshot_id(spark, sf_dir):
    """The surest name of a state that a source gives: head, revision, file and time, cursor, root hash."""
    n = F.col("page_id")
    given = lambda every, *parts: F.when(n % every == 0, F.concat(*parts))
    ways = (given(11, F.lit("sha"), n), given(5, F.lit("rev"), n), given(3, F.lit("drive:"), n, F.lit(":"), F.lit("2024-01-01")), given(7, F.lit("drive_cursor:"), n), given(2, F.lit("hash:"), F.md5("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*ways).alias("snapshot_id"))


@query("i28_embed_cap", "SELECT doc_id, sha256(substr(text, 1, 32000)) AS capped_sha256 FROM documents")
def embed_cap(spark, sf_dir):
    """The input of an embedding call, at most 32,000 characters long: that limit is the operator."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.substring("text", 1, 32_000).cast("binary"), 256).alias("capped_sha256"))


_STAMP = "CASE event_id % 5 WHEN 0 THEN '2024-03-01T04:05:06Z' WHEN 1 THEN '2024-03-01T04:05:06+02:00' WHEN 2 THEN '2024-03-01T04:05:06' WHEN 3 THEN 'yesterday' ELSE NULL END"


@query("t01_iso_instants", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1709265906 WHEN 1 THEN 1709258706 WHEN 2 THEN 1709265906 END::BIGINT AS seconds, {_STAMP} AS stamp FROM events")
def iso_instants(spark, sf_dir):
    """Instants of ISO strings; without an offset they are UTC, and what is none is null."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(_STAMP).alias("stamp")).select("event_id", F.unix_seconds(F.try_to_timestamp(F.col("stamp"))).alias("seconds"), "stamp")


_RAW = """concat('```json', chr(10), '{"answer": "a', turn, '", "score": ', turn * 2, CASE WHEN turn % 3 = 0 THEN ', "extra": true' ELSE '' END, '}', chr(10), '```')"""


@query("t02_fenced_json", "SELECT conv_id, turn, concat('a', turn) AS answer, least(5, greatest(1, turn * 2))::BIGINT AS score, turn % 3 > 0 AS closed FROM conversations")
def fenced_json(spark, sf_dir):
    """The object inside a fence: its fields, the score clamped, and whether it has no others."""
    raw = F.regexp_replace(F.expr(_RAW.replace("chr(10)", "char(10)")), r"(?m)^```(?:json)?\s*|\s*```$", "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    score = F.least(F.lit(5), F.greatest(F.lit(1), F.get_json_object("raw", "$.score").cast("long")))
    return rows.select("conv_id", "turn", F.get_json_object("raw", "$.answer").alias("answer"), score.alias("score"), (F.size(F.array_except(F.json_object_keys("raw"), F.array(F.lit("answer"), F.lit("score")))) == 0).alias("closed"))


@query("j33_memory_context", with_views("""m AS (SELECT twin_id, chunk_id, concat('[', chunk_type, '] ', source_ref, chr(10), content) AS part FROM chunks JOIN sources USING (source_id) QUALIFY row_number() OVER (PARTITION BY twin_id ORDER BY chunk_id) <= 20)
    SELECT twin_id, sha256(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_id)) AS context_sha256 FROM m GROUP BY twin_id"""))  # fmt: skip
def memory_context(spark, sf_dir):
    """The blocks of a twin's first twenty chunks, whole."""
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir), "source_id")
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("twin_id").orderBy("chunk_id"))).where("no <= 20")
    part = F.concat(F.lit("["), "chunk_type", F.lit("] "), "source_ref", F.lit("\n"), "content")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("part")))), lambda s: s["part"])
    return first.groupBy("twin_id").agg(F.sha2(F.array_join(parts, "\n\n---\n\n").cast("binary"), 256).alias("context_sha256"))


@query("j33_structure_lines", with_views("""d AS (SELECT DISTINCT twin_id, split_part(source_ref, '/', 1) AS dir, source_ref FROM chunks JOIN sources USING (source_id) WHERE status IN ('ready', 'processing')),
    g AS (SELECT twin_id, dir, list(source_ref ORDER BY source_ref) AS fs FROM d GROUP BY ALL)
    SELECT twin_id, dir, concat(dir, '/ (', len(fs), ' files) — ', array_to_string(list_transform(fs[:8], lambda f: concat('`', f, '`')), ', '), CASE WHEN len(fs) > 8 THEN concat(' + ', len(fs) - 8, ' more') ELSE '' END) AS line FROM g"""))  # fmt: skip
def structure_lines(spark, sf_dir):
    live = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where(F.col("status").isin("ready", "processing")), "source_id")
    dirs = live.groupBy("twin_id", F.substring_index("source_ref", "/", 1).alias("dir")).agg(F.array_sort(F.collect_set("source_ref")).alias("fs"))
    shown = F.array_join(F.transform(F.slice("fs", 1, 8), lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", ")
    rest = F.when(F.size("fs") > 8, F.concat(F.lit(" + "), F.size("fs") - 8, F.lit(" more"))).otherwise("")
    return dirs.select("twin_id", "dir", F.concat("dir", F.lit("/ ("), F.size("fs"), F.lit(" files) — "), shown, rest).alias("line"))


@query("j35_source_awareness", with_views("SELECT twin_id, name, source_type, status, CASE WHEN source_id % 3 > 0 THEN source_id % 2 = 0 END AS strict_ready, CASE WHEN source_id % 4 > 0 THEN (source_id % 5) / 8.0 END::DOUBLE AS parser_coverage FROM sources"))
def source_awareness(spark, sf_dir):
    """Sources with what their nested health records say, null where they say nothing."""
    n = F.col("source_id")
    health = F.when(n % 3 > 0, F.struct((n % 2 == 0).alias("strict_evidence_ready"))).alias("health")
    index = F.when(n % 4 > 0, F.struct(((n % 5) / 8.0).alias("parser_coverage_ratio"))).alias("implementation_index")
    return sources(spark, sf_dir).select("twin_id", "name", "source_type", "status", health, index).select("twin_id", "name", "source_type", "status", F.col("health.strict_evidence_ready").alias("strict_ready"), F.col("implementation_index.parser_coverage_ratio").alias("parser_coverage"))


@query("s02_event_rates", "SELECT user_id, date_trunc('minute', ts) AS period, count(*) AS events, count(*) > 300 AS limited, greatest(0, count(*) - 300) AS over FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_rates(spark, sf_dir):
    return metrics.event_rates(table(spark, sf_dir, "events"), "user_id").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(
    "s03_state_repair",
    """WITH s AS (SELECT DISTINCT conv_id, ['pending', 'generating', 'failed', 'ready'][conv_id % 4 + 1] AS status, conv_id % 3 = 0 AS locked, conv_id % 5 = 0 AS queued, conv_id % 7 = 0 AS pending FROM conversations)
    SELECT conv_id, CASE WHEN locked OR queued OR (pending AND status <> 'ready') THEN 'generating' WHEN status = 'generating' THEN 'failed' ELSE status END AS repaired FROM s""",
)
def state_repair(spark, sf_dir):
    """The status that a job's flags allow: at work if it is locked, queued or, unless it is ready, pending; failed if it claims work that nothing does."""
    n = F.col("conv_id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "generating", "failed", "ready"))), (n % 4 + 1).cast("int"))
    active = (n % 3 == 0) | (n % 5 == 0) | ((n % 7 == 0) & (status != "ready"))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.when(active, "generating").when(status == "generating", "failed").otherwise(status).alias("repaired"))


@query(
    "s04_change_feed",
    """WITH f AS (SELECT user_id AS k, event_id AS seq, event_type = (SELECT min(event_type) FROM events) AS gone, value FROM events),
    l AS (SELECT k, arg_max(gone, seq) AS gone, arg_max(value, seq) AS value, max(seq) AS seq FROM f GROUP BY k) SELECT k, seq, value FROM l WHERE NOT gone""",
)
def change_feed(spark, sf_dir):
    """The state after a feed of upserts and deletions: the last change of each key counts, whatever batches it came in."""
    events = table(spark, sf_dir, "events")
    deletion = events.agg(F.min("event_type").alias("deletion"))
    feed = events.join(F.broadcast(deletion)).select(F.col("user_id").alias("k"), F.struct(F.col("event_id").alias("seq"), (F.col("event_type") == F.col("deletion")).alias("gone"), "value").alias("change"))  # one row
    return feed.groupBy("k").agg(F.max("change").alias("last")).where("not last.gone").select("k", "last.seq", "last.value")
