"""Ingestion queries: policy, text quality, chunking, evidence and sinks over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import chunking, evidence, policy
from scriptorium.plans.registry import query
from scriptorium.plans.views import chunks, source_number, sources, table, with_views
from scriptorium.sources import tables

PATHS = """CASE doc_id % 13 WHEN 0 THEN concat(lang, '/.env.', source) WHEN 1 THEN concat('keys/', source, '.PEM') WHEN 2 THEN '.aws/credentials'
 WHEN 3 THEN concat('.ssh/', doc_id) WHEN 4 THEN concat('docs/.Cursor/', doc_id, '.md') WHEN 5 THEN 'notes/.claude' WHEN 6 THEN concat(source, '/config.json')
 WHEN 7 THEN concat('x/', source, '_token/readme.md') WHEN 8 THEN concat('./', lang, '/', doc_id, '.md') WHEN 9 THEN 'README.md' ELSE concat(lang, '/', source, '/', doc_id, '.md') END"""


def _alternation(globs) -> str:
    return policy.glob_regex(globs).replace("'", "''").replace("(?s:.*)", ".*")


@query(
    "b01_blocked_files",
    f"""WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents),
    n AS (SELECT doc_id, path, lower(regexp_replace(path, '^(\\./|/)+', '')) AS low FROM p),
    s AS (SELECT *, list_filter(string_split(low, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM n)
    SELECT doc_id, path, CASE WHEN regexp_matches(low, '{_alternation(policy.BLOCKED_PATHS)}') THEN 'path'
      WHEN len(list_filter(parts, lambda x: regexp_matches(x, '{_alternation(policy.BLOCKED_NAMES)}'))) > 0 THEN 'name'
      WHEN len(list_filter(parts[1:len(parts)-1], lambda x: x IN {policy.BLOCKED_FOLDERS})) > 0 THEN 'folder' ELSE 'allowed' END AS decision FROM s""",
)
def blocked_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATHS).alias("path"))
    return files.select("doc_id", "path", policy.path_decision(F.col("path")).alias("decision"))


def _first_pattern(line: str) -> str:
    quoted = [p.replace("'", "''") for p in policy.SECRET_PATTERNS]
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p}') THEN {k}" for k, p in enumerate(quoted, 1)) + " END"


@query(
    "b03_secret_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_no FROM documents),
    f AS (SELECT doc_id, line_no, {_first_pattern('line')} AS pattern_no FROM l)
    SELECT doc_id, line_no::INT AS line_no, pattern_no FROM f WHERE pattern_no IS NOT NULL""",
)
def secret_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(policy.text_lines(F.col("text"))).alias("pos", "line"))
    flagged = lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), policy.secret_pattern(F.col("line")).alias("pattern_no"))
    return flagged.where("pattern_no is not null")


_ANY = policy.ANY_SECRET.replace("'", "''")


@query(
    "b04_redaction",
    f"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)),
      lambda x: CASE WHEN regexp_matches(x, '{_ANY}') THEN '{policy.REDACTED}' ELSE x END), chr(10))) AS redacted_sha256 FROM documents""",
)
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(policy.redact(F.col("text"))).alias("redacted_sha256"))


_OK = r"[\t\n\x0B\f\r\x{20}-\x{7E}\x{A0}-\x{24F}\x{2000}-\x{206F}\x{4E00}-\x{9FFF}]"
_CTL = r"[\x00-\x08\x0E-\x1F]"


@query(
    "a09_text_quality",
    f"""WITH q AS (SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '{_OK}', '', 'g')) AS ok,
      length(text) - length(regexp_replace(text, '{_CTL}', '', 'g')) AS ctl, length(text) - length(replace(text, chr(65533), '')) AS rep,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE ok / n END, 6)::DOUBLE AS readable_ratio, ctl::INT AS control_chars,
      n = 0 OR ctl + rep > greatest(3, n // 100) OR ok / n < 0.70 AS is_binary,
      n = 0 OR rep > greatest(3, n // 150) OR (n > 400 AND ctl > n // 40) AS is_mojibake,
      round(CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '^\\d{{6,12}} \\d{{1,6}} [nf]\\s*$'))) / len(ls) END, 6)::DOUBLE AS xref_ratio FROM q""",
)
def text_quality(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(tx.readable_ratio(text), 6).alias("readable_ratio"), tx.control_count(text).alias("control_chars"), tx.is_binary(text).alias("is_binary"), tx.is_mojibake(text).alias("is_mojibake"), F.round(tx.xref_ratio(text), 6).alias("xref_ratio")
    )


@query(
    "a03_manual_notes",
    """SELECT doc_id, concat('manual/', regexp_replace(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '.md') AS path,
      length(text) <= 50000 AS fits FROM documents""",
)
def manual_notes(spark, sf_dir):
    title = F.regexp_replace(F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("manual/"), title, F.lit(".md")).alias("path"), (F.length("text") <= 50000).alias("fits"))


@query("i16_hashes", "SELECT doc_id, sha256(text) AS content_hash, sha256(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')) AS cache_key, greatest(1, length(text) // 4)::BIGINT AS token_count FROM documents")
def hashes(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(text).alias("content_hash"), tx.cache_key(text).alias("cache_key"), tx.token_estimate(text).alias("token_count"))


@query(
    "i10_heading_sections",
    """WITH t AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10) || 'The ', chr(10) || '## The '), '\\n$', ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM t),
    s AS (SELECT *, regexp_matches(line, '^#{1,3}\\s+.+$') AS head, sum(regexp_matches(line, '^#{1,3}\\s+.+$')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l),
    g AS (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN trim(regexp_extract(line, '^#{1,3}\\s+(.+)$', 1)) END), '') AS title,
      regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY line_no), ''), '^\\s+|\\s+$', '', 'g') AS body, min(line_no) AS a, max(line_no) AS b FROM s GROUP BY ALL)
    SELECT doc_id, section::BIGINT AS section, title, sha256(body) AS body_sha256, (CASE WHEN section > 0 THEN a + 1 ELSE 1 END)::INT AS start_line,
      greatest(CASE WHEN section > 0 THEN a + 1 ELSE 1 END, b)::INT AS end_line FROM g WHERE section > 0 OR body <> ''""",
)
def heading_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\nThe "), F.lit("\n## The ")).alias("text"))
    return chunking.sections(docs, "doc_id", "text").withColumn("body", tx.content_hash(F.col("body"))).withColumnRenamed("body", "body_sha256")


@query("i11_overlap_chunks")
def overlap_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    pieces = chunking.chunk_sections(chunking.sections(docs, "doc_id", "text", "path"), "doc_id", "path")
    return chunking.annotate(pieces, F.col("path")).select("doc_id", "section", "part", "start_line", "end_line", "segment_id", "content_hash", "token_count")


@query(
    "i11_hard_split",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    p AS (SELECT doc_id, line_no, line, unnest(range(0, length(line), 1800)) AS off FROM l WHERE length(line) > 2000)
    SELECT doc_id, line_no::INT AS line_no, (off // 1800)::INT AS piece_no, substr(line, off + 1, 2000) AS piece FROM p""",
)
def hard_split(spark, sf_dir):
    return chunking.hard_pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "i12_paragraphs",
    """WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM documents)
    SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS paragraph_no, sha256(unnest(ps)) AS paragraph_sha256 FROM p""",
)
def paragraph_rows(spark, sf_dir):
    return chunking.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "paragraph_no", tx.content_hash(F.col("paragraph")).alias("paragraph_sha256"))


@query("i12_paragraph_pieces")
def paragraph_pieces(spark, sf_dir):
    """Texts packed by paragraph with the tail of the piece before; paragraphs end before sentences that start with `The`. A fold, which SQL doesn't express."""
    text = F.replace("text", F.lit("\nThe "), F.lit("\n\nThe ")).alias("text")
    return chunking.paragraph_pieces(table(spark, sf_dir, "documents").select("doc_id", text), "doc_id", "text").select("doc_id", "piece_no", F.length("piece").alias("chars"), tx.content_hash(F.col("piece")).alias("piece_sha256"))


@query(
    "d11_root_hash",
    with_views("""l AS (SELECT DISTINCT source_id, concat(source_ref, ':', sha256(content)) AS line FROM chunks)
    SELECT source_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS root_hash FROM l GROUP BY source_id"""),
)
def root_hashes(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).select("source_id", "source_ref", tx.content_hash(F.col("content")).alias("digest"))
    return evidence.root_hash(rows, "source_id", "source_ref", "digest")


@query(
    "d12_structure_inventory",
    """WITH p AS (SELECT DISTINCT substr(source, 4)::INT AS source_id, CASE WHEN doc_id % 9 = 0 THEN concat(doc_id, '.md') ELSE concat(lang, '/a', doc_id % 3, '/b', doc_id % 5, '/c/d/e/', doc_id, '.md') END AS path FROM documents),
    g AS (SELECT source_id, path, string_split(path, '/') AS s FROM p),
    f AS (SELECT source_id, CASE WHEN len(s) <= 1 THEN '_root' ELSE array_to_string(s[1:least(len(s) - 1, 4)], '/') END AS folder, array_agg(path ORDER BY path) AS files FROM g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN folder = '_root' THEN 0 ELSE len(string_split(folder, '/')) END, -len(files), folder) AS position FROM f)
    SELECT source_id, folder, position::INT AS position, array_to_string(files, ',') AS files FROM r WHERE position <= 50""",
)
def structure(spark, sf_dir):
    path = F.when(F.col("doc_id") % 9 == 0, F.concat("doc_id", F.lit(".md"))).otherwise(F.concat("lang", F.lit("/a"), F.col("doc_id") % 3, F.lit("/b"), F.col("doc_id") % 5, F.lit("/c/d/e/"), "doc_id", F.lit(".md")))
    found = evidence.structure_inventory(table(spark, sf_dir, "documents").select(source_number().alias("source_id"), path.alias("path")), "source_id", "path")
    return found.withColumn("files", F.array_join("files", ","))


_LINEAGE = """CASE WHEN chunk_type IN ('memory_brief', 'memory_artifact') THEN 'memory_derived' WHEN source_type = 'manual' THEN 'synthetic_profile'
  WHEN source_type IN ('google_drive', 'markdown', 'pdf', 'url') THEN 'file_backed' ELSE 'connector_segment' END"""


@query(
    "i19_lineage_and_contract",
    with_views(f"""k AS (SELECT chunk_id, source_ref, chunk_type, {_LINEAGE} AS lineage, CASE WHEN chunk_id % 7 <> 0 THEN concat('snap', source_id) END AS snapshot_id FROM chunks JOIN sources USING (source_id))
    SELECT chunk_id, lineage, concat(source_ref, ':', 1, '-', 9, ':', chunk_type) AS segment_id, lineage IN ('synthetic_profile', 'memory_derived') OR snapshot_id IS NOT NULL AS strict_ready FROM k"""),
)
def lineage_rows(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir), "source_id")
    snapshot = F.when(F.col("chunk_id") % 7 != 0, F.concat(F.lit("snap"), "source_id"))
    segment = tx.segment_id(F.col("source_ref"), F.lit(1), F.lit(9), F.lit(None), F.col("chunk_type"))
    marked = rows.select("chunk_id", evidence.lineage(F.col("chunk_type"), F.col("source_type")).alias("lineage"), segment.alias("segment_id"), snapshot.alias("snapshot"), tx.content_hash(F.col("content")).alias("digest"))
    return marked.select("chunk_id", "lineage", "segment_id", evidence.strict_ready(F.col("lineage"), F.col("snapshot"), F.col("digest"), F.lit(1), F.lit(9), F.col("segment_id")).alias("strict_ready"))


@query(
    "d10_index_health",
    with_views(f"""k AS (SELECT source_id, source_type, {_LINEAGE} AS lineage, chunk_id % 7 <> 0 OR source_id % 3 = 0 AS whole FROM chunks JOIN sources USING (source_id)),
    g AS (SELECT source_id, source_type, count(*) AS total_chunks, count_if(lineage IN ('file_backed', 'connector_segment')) AS strict_total, count_if(lineage IN ('file_backed', 'connector_segment') AND whole) AS strict_done FROM k GROUP BY ALL)
    SELECT source_id, total_chunks, strict_total, strict_done, CASE WHEN strict_total = 0 THEN 1.0 ELSE round_even(strict_done / strict_total, 4) END::DOUBLE AS coverage_ratio,
      CASE WHEN source_type IN ('google_drive', 'markdown', 'pdf') AND strict_total = strict_done THEN 'strict' ELSE 'legacy' END AS index_mode FROM g"""),
)
def index_health(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir), "source_id")
    strict = evidence.lineage(F.col("chunk_type"), F.col("source_type")).isin("file_backed", "connector_segment")
    whole = (F.col("chunk_id") % 7 != 0) | (F.col("source_id") % 3 == 0)
    sums = rows.groupBy("source_id", "source_type").agg(F.count("*").alias("total_chunks"), F.count_if(strict).alias("strict_total"), F.count_if(strict & whole).alias("strict_done"))
    ratio = F.when(F.col("strict_total") == 0, 1.0).otherwise(F.bround(F.col("strict_done") / F.col("strict_total"), 4))
    mode = F.when(F.col("source_type").isin("google_drive", "markdown", "pdf") & (F.col("strict_total") == F.col("strict_done")), "strict").otherwise("legacy")
    return sums.select("source_id", "total_chunks", "strict_total", "strict_done", ratio.alias("coverage_ratio"), mode.alias("index_mode"))


_NEW = "SELECT chunk_id + 1000000 AS chunk_id, source_id, source_ref FROM chunks WHERE source_id % 5 = 1"


@query("a14_replace_by_source", with_views(f"n AS ({_NEW}) SELECT chunk_id, source_id, source_ref FROM chunks WHERE source_id NOT IN (SELECT source_id FROM n) UNION ALL SELECT * FROM n"))
def replace_source(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).select("chunk_id", "source_id", "source_ref")
    return tables.replace_by_source(rows, rows.where("source_id % 5 = 1").withColumn("chunk_id", F.col("chunk_id") + 1000000))


@query(
    "a15_replace_by_paths",
    with_views(f"""n AS ({_NEW}), g AS (SELECT DISTINCT source_id, source_ref FROM chunks WHERE source_id % 7 = 2 AND source_ref LIKE '%part3.md' UNION SELECT DISTINCT source_id, source_ref FROM n)
    SELECT chunk_id, source_id, source_ref FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source_id = c.source_id AND g.source_ref = c.source_ref) UNION ALL SELECT * FROM n"""),
)
def replace_paths(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).select("chunk_id", "source_id", "source_ref")
    new = rows.where("source_id % 5 = 1").withColumn("chunk_id", F.col("chunk_id") + 1000000)
    return tables.replace_by_paths(rows, new, rows.where("source_id % 7 = 2 and source_ref like '%part3.md'"))


@query("a16_insert_if_absent", "SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')")
def cache_inserts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", tx.content_hash(F.col("text")).alias("text_hash"))
    return tables.insert_if_absent(rows.where("lang = 'fr'"), rows, ["text_hash"]).select("text_hash")


@query("d22_fingerprints", with_views("SELECT DISTINCT source_ref AS path, sha256(content) AS file_hash FROM chunks"))
def fingerprints(spark, sf_dir):
    return chunks(spark, sf_dir, vectors=False).select(F.col("source_ref").alias("path"), tx.content_hash(F.col("content")).alias("file_hash")).distinct()


@query(
    "g02_delta_paths",
    with_views("""p AS (SELECT source_id, array_agg(DISTINCT source_ref) AS cur, array_agg(DISTINCT source_ref) FILTER (source_ref LIKE '%part1.md') AS del FROM chunks GROUP BY source_id)
    SELECT source_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(cur, lambda x: NOT list_contains(coalesce(del, []), x)), ['new.md']))), ',') AS paths FROM p"""),
)
def delta_paths(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).groupBy("source_id").agg(F.collect_set("source_ref").alias("cur"), F.collect_set(F.when(F.col("source_ref").like("%part1.md"), F.col("source_ref"))).alias("gone"))
    return rows.select("source_id", F.array_join(evidence.patch_paths(F.col("cur"), F.col("gone"), F.array(F.lit("new.md"))), ",").alias("paths"))


@query(
    "k01_freshness",
    """WITH u AS (SELECT user_id, max(ts) AS updated, user_id % 3 AS k FROM events GROUP BY ALL), a AS (SELECT *, epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(updated) AS us FROM u)
    SELECT user_id, round_even(us / 1e6 / 3600, 2)::DOUBLE AS age_hours, floor(us / 1e6 / 60)::BIGINT AS age_minutes, us / 1e6 / 3600 >= CASE k WHEN 0 THEN 48 WHEN 1 THEN 72 ELSE 168 END AS is_stale FROM a""",
)
def fresh(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated"))
    kind = F.element_at(F.array(F.lit("google_drive"), F.lit("pdf"), F.lit("manual")), (F.col("user_id") % 3 + 1).cast("int"))
    return last.select("user_id", *evidence.freshness(F.col("updated"), F.lit("2024-02-01 00:00:00"), evidence.stale_after(kind)))
