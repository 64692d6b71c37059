"""Answer analytics and knowledge-base maintenance: routing by name, joins with caches and graphs, grounding, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import graph, policy
from scriptorium.operators.aliases import longest_alias, plain
from scriptorium.plans.registry import query
from scriptorium.plans.views import chunks, edges, questions, sources, table, with_views
from scriptorium.sources.tables import violations


@query(
    "c09_embedding_cache",
    """WITH t AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM t WHERE doc_id % 3 = 0)
    SELECT doc_id, h IN (SELECT h FROM c) AS hit FROM t""",
)
def embedding_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    cache = rows.where("doc_id % 3 = 0").select("h").distinct().withColumn("hit", F.lit(True))
    return rows.join(cache, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    "c10_graph_endpoints",
    """WITH e AS (SELECT vec_id, lower(concat(CASE WHEN vec_id % 2 = 0 THEN 'Node' ELSE 'node' END, vec_id % 300)) AS name FROM embeddings),
    last AS (SELECT name, max(vec_id) AS id FROM e GROUP BY name), r AS (SELECT vec_id, concat('NODE', vec_id % 350) AS a, concat('node', (vec_id * 3) % 400) AS b FROM embeddings)
    SELECT r.vec_id AS rel_id, x.id AS src, y.id AS dst FROM r JOIN last x ON lower(r.a) = x.name JOIN last y ON lower(r.b) = y.name""",
)
def graph_endpoints(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    entities = ids.select("vec_id", F.lower(F.concat(F.when(F.col("vec_id") % 2 == 0, "Node").otherwise("node"), F.col("vec_id") % 300)).alias("name"))
    last = entities.groupBy("name").agg(F.max("vec_id").alias("id"))
    relations = ids.select(F.col("vec_id").alias("rel_id"), F.lower(F.concat(F.lit("NODE"), F.col("vec_id") % 350)).alias("a"), F.lower(F.concat(F.lit("node"), (F.col("vec_id") * 3) % 400)).alias("b"))
    first = last.select(F.col("name").alias("a"), F.col("id").alias("src"))
    return relations.join(first, "a").join(last.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b").select("rel_id", "src", "dst")


@query("c11_hash_backfill", with_views("SELECT chunk_id, coalesce(CASE WHEN chunk_id % 4 = 0 THEN 'old' END, sha256(content)) AS content_hash, coalesce(s.status, 'orphan') AS status FROM chunks LEFT JOIN sources s USING (source_id)"))
def hash_backfill(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).select("source_id", "status"), "source_id", "left")
    return rows.select("chunk_id", F.coalesce(F.when(F.col("chunk_id") % 4 == 0, "old"), tx.content_hash(F.col("content"))).alias("content_hash"), F.coalesce("status", F.lit("orphan")).alias("status"))


@query("c12_workspace_tree", with_views("t AS (SELECT workspace_id, twin_id, string_agg(name, '+' ORDER BY source_id) AS names FROM sources GROUP BY ALL) SELECT workspace_id, string_agg(concat(twin_id, ':', names), ';' ORDER BY twin_id) AS tree FROM t GROUP BY workspace_id"))
def workspace_tree(spark, sf_dir):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "name"))), lambda x: x["name"]), "+")
    twins = sources(spark, sf_dir).groupBy("workspace_id", "twin_id").agg(names.alias("names"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("twin_id", "names"))), lambda x: F.concat(x["twin_id"].cast("string"), F.lit(":"), x["names"]))
    return twins.groupBy("workspace_id").agg(F.array_join(parts, ";").alias("tree"))


_QUESTION = "concat('what does ', source, CASE WHEN doc_id % 3 = 0 THEN concat(' and src', doc_id % 20) ELSE '' END, ' cover')"


@query(
    "c14_alias_in_question",
    f"""WITH q AS (SELECT doc_id, {_QUESTION} AS q FROM documents), s AS (SELECT DISTINCT source AS alias, substr(source, 4)::INT AS source_id FROM documents),
    m AS (SELECT doc_id, alias, source_id FROM q JOIN s ON contains(concat(' ', q, ' '), concat(' ', alias, ' ')))
    SELECT doc_id, alias FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -length(alias), source_id) = 1""",
)
def alias_in_question(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.col("source").alias("alias")).distinct().select("alias", F.substring("alias", 4, 9).cast("int").alias("source_id"))
    # an alias of one word is contained between blanks exactly if it is one of the question's words
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.expr(_QUESTION), " "))).alias("alias"))
    first = Window.partitionBy("doc_id").orderBy(-F.length("alias"), "source_id")
    return words.join(names, "alias").withColumn("no", F.row_number().over(first)).where("no = 1").select("doc_id", "alias")


_PLAIN = r"trim(regexp_replace(lower({}), '[\x09-\x0D\x20]+', ' ', 'g'))"


@query(
    "c14_long_aliases",
    f"""WITH q AS (SELECT doc_id, {_PLAIN.format('text')} AS q FROM documents WHERE text IS NOT NULL),
    s AS (SELECT substr(source, 4)::INT AS source_id, array_to_string(string_split(arg_min(q, q.doc_id), ' ')[1:3], ' ') AS alias FROM documents d JOIN q USING (doc_id) GROUP BY source)
    SELECT doc_id, source_id, alias FROM q JOIN s ON contains(concat(' ', q, ' '), concat(' ', alias, ' ')) WHERE alias <> '' AND q <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -length(alias), source_id) = 1""",
)
def long_aliases(spark, sf_dir):
    """The sources that whole texts name, where a source goes by the first three words of its first text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    start = F.substring_index(plain(F.min_by("text", "doc_id")), " ", 3).alias("alias")
    names = docs.groupBy("source").agg(start).select(F.substring("source", 4, 9).cast("int").alias("alias_id"), "alias")
    found = longest_alias(docs.select(F.col("doc_id").alias("text_id"), "text"), names)
    return found.select(F.col("text_id").alias("doc_id"), F.col("alias_id").alias("source_id"), "alias")


@query(
    "d18_entity_merge",
    """WITH e AS (SELECT doc_id, lower(lang) AS name, text, concat(source, '/', doc_id % 4) AS ref FROM documents)
    SELECT name, sha256(arg_min(text, doc_id)) AS description_sha256, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM e GROUP BY name""",
)
def entity_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("lang").alias("name"), tx.content_hash(F.col("text")).alias("h"), F.concat("source", F.lit("/"), F.col("doc_id") % 4).alias("ref"))
    return rows.groupBy("name").agg(F.min_by("h", "doc_id").alias("description_sha256"), F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))


@query("d19_graph_union", with_views("u AS (SELECT src, dst, 0 AS p FROM edges WHERE edge_id % 3 < 2 UNION ALL SELECT src, dst, 1 FROM edges WHERE edge_id % 3 > 0) SELECT src, dst, min(p) AS origin FROM u GROUP BY ALL"))
def graph_union(spark, sf_dir):
    rows = edges(spark, sf_dir)
    sure, guessed = rows.where("edge_id % 3 < 2").withColumn("p", F.lit(0)), rows.where("edge_id % 3 > 0").withColumn("p", F.lit(1))
    return sure.unionByName(guessed).groupBy("src", "dst").agg(F.min("p").alias("origin"))


@query(
    "h07_stub_embedding",
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
    v AS (SELECT doc_id, list_transform(range(0, 64), lambda i: (('0x' || substr(h, ((i % 32) * 2 + 1)::INT, 2))::INT - 127.5) / 127.5) AS v FROM h)
    SELECT doc_id, round(v[1]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(v[64]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS last FROM v""",
)
def stub_embedding(spark, sf_dir):
    vectors = table(spark, sf_dir, "documents").select("doc_id", stub_vector(F.col("text"), 64).alias("v"))
    return vectors.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


def stub_vector(text: F.Column, size: int) -> F.Column:
    """A unit vector from the bytes of the text's hash, over and over."""
    octets = F.transform(F.regexp_extract_all(tx.content_hash(text), F.lit(".."), 0), lambda x: (F.conv(x, 16, 10).cast("double") - 127.5) / 127.5)
    raw = F.slice(F.flatten(F.array_repeat(octets, -(-size // 32))), 1, size)
    # the norm is an argument, and so worked out once, not for each component
    return F.zip_with(raw, F.array_repeat(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), size), lambda x, n: x / n)


@query("i20_slugs", "SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(substr(text, 1, 100)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g') AS slug FROM documents")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.slug(F.substring("text", 1, 100)).alias("slug"))


@query("i24_prompt_scrub", "SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '-{3,}', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS scrubbed_sha256 FROM pages")
def prompt_scrub(spark, sf_dir):
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), "-{3,}", ""), r"^\s+|\s+$", "")
    return table(spark, sf_dir, "pages").select("page_id", tx.content_hash(clean).alias("scrubbed_sha256"))


@query(
    "i26_brief_excerpt",
    """WITH l AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS b FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(b) > 220 THEN substr(b, 1, 220) || '...' ELSE b END AS excerpt FROM l""",
)
def brief_excerpt(spark, sf_dir):
    body = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), " ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("b"))
    return rows.select("conv_id", "turn", F.when(F.length("b") > 220, F.concat(F.substring("b", 1, 220), F.lit("..."))).otherwise(F.col("b")).alias("excerpt"))


@query(
    "j05_full_text_then_substring",
    with_views("""ready AS (SELECT chunk_id, twin_id, list_distinct(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+')) AS words FROM chunks JOIN sources USING (source_id) WHERE status = 'ready' AND chunk_type <> 'memory_brief'),
    q AS (SELECT query_id, twin_id, list_filter(list_distinct(string_split_regex(lower(query), '[^\\p{L}\\p{N}]+')), lambda x: x <> '') AS ws FROM questions)
    SELECT q.query_id, count(chunk_id) AS matches, count(chunk_id) = 0 AS falls_back FROM q LEFT JOIN ready r ON r.twin_id = q.twin_id AND list_has_all(r.words, q.ws) GROUP BY q.query_id"""),
)
def full_text(spark, sf_dir):
    """Questions all of whose words a chunk holds; the others fall back on substrings. Joined by twin and word."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    ready = chunks(spark, sf_dir, vectors=False).where("chunk_type <> 'memory_brief'").join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    asked = questions(spark, sf_dir).select("query_id", "twin_id", split(F.col("query")).alias("ws"))
    needed = asked.select("query_id", "twin_id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    postings = ready.select("chunk_id", "twin_id", F.explode(split(F.col("content"))).alias("word"))
    held = postings.join(needed, ["twin_id", "word"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("held"), F.first("n").alias("n")).where("held = n")
    counts = held.groupBy("query_id").agg(F.count("*").alias("matches"))
    return asked.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.col("matches").isNull().alias("falls_back"))


@query(
    "j06_evidence_files",
    with_views("""r AS (SELECT source_ref AS path, twin_id, chunk_type, chunk_id FROM chunks JOIN sources USING (source_id) WHERE status = 'ready')
    SELECT twin_id, path, count(*) AS spans, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS kinds, (40 * bool_or(chunk_type = 'documentation')::INT - 15 * bool_or(chunk_type = 'code_snippet')::INT)::INT AS priority,
      row_number() OVER (PARTITION BY twin_id ORDER BY 40 * bool_or(chunk_type = 'documentation')::INT - 15 * bool_or(chunk_type = 'code_snippet')::INT DESC, path)::INT AS position FROM r GROUP BY twin_id, path"""),
)
def evidence_files(spark, sf_dir):
    ready = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    has = lambda kind: F.bool_or(F.col("chunk_type") == kind).cast("int")
    files = ready.groupBy("twin_id", F.col("source_ref").alias("path")).agg(F.count("*").alias("spans"), F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("kinds"), (40 * has("documentation") - 15 * has("code_snippet")).alias("priority"))
    return files.withColumn("position", F.row_number().over(Window.partitionBy("twin_id").orderBy(F.desc("priority"), "path")))


@query(
    "j10_multihop_chunks",
    with_views("""ways AS (SELECT src AS node, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges),
    n AS (SELECT DISTINCT q.query_id, w.neighbour AS chunk_id FROM questions q JOIN ways w ON w.node = q.query_id)
    SELECT query_id, c.chunk_id, 0.5::DOUBLE AS score FROM n JOIN chunks c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c.chunk_id) <= 4"""),
)
def multihop_chunks(spark, sf_dir):
    ways = graph.both_ways(edges(spark, sf_dir)).select("node", F.col("neighbour").alias("chunk_id")).distinct()
    found = questions(spark, sf_dir).select("query_id", F.col("query_id").alias("node")).join(ways, "node").join(chunks(spark, sf_dir, vectors=False).select("chunk_id"), "chunk_id")
    first = Window.partitionBy("query_id").orderBy("chunk_id")
    return found.withColumn("no", F.row_number().over(first)).where("no <= 4").select("query_id", "chunk_id", F.lit(0.5).alias("score"))


@query(
    "j28_status_lifecycle",
    with_views("""SELECT source_id, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'processing' AND source_id % 4 = 1 THEN 'ready' ELSE status END AS next_status,
      source_id % 6 = 0 AND status IN ('ready', 'failed') AS backfill FROM sources"""),
)
def status_lifecycle(spark, sf_dir):
    promoted = F.when((F.col("status") == "processing") & (F.col("source_id") % 4 == 1), "ready").otherwise(F.col("status"))
    return sources(spark, sf_dir).select("source_id", promoted.alias("next_status"), ((F.col("source_id") % 6 == 0) & F.col("status").isin("ready", "failed", "needs_resync")).alias("backfill"))


@query(
    "j31_prompt_context",
    with_views(f"""k AS (SELECT twin_id, chunk_id, concat('[', source_ref, ']', chr(10), CASE WHEN regexp_matches(content, '{policy.ANY_SECRET.replace("'", "''")}') THEN 'REDACTED' ELSE substr(content, 1, 300) END) AS part
      FROM chunks JOIN sources USING (source_id) WHERE status = 'ready' QUALIFY row_number() OVER (PARTITION BY twin_id ORDER BY chunk_id) <= 8)
    SELECT twin_id, string_agg(part, chr(10) || '---' || chr(10) ORDER BY chunk_id) AS context FROM k GROUP BY twin_id"""),
)
def prompt_context(spark, sf_dir):
    ready = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    best = ready.withColumn("no", F.row_number().over(Window.partitionBy("twin_id").orderBy("chunk_id"))).where("no <= 8")
    part = F.concat(F.lit("["), "source_ref", F.lit("]\n"), F.when(policy.has_secret(F.col("content")), "REDACTED").otherwise(F.substring("content", 1, 300)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("p")))), lambda x: x["p"])
    return best.groupBy("twin_id").agg(F.array_join(parts, "\n---\n").alias("context"))


@query("j34_retrieval_preview", with_views("SELECT chunk_id, substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 120) AS preview, substr(source_ref, 1, 200) AS ref, length(content) AS chars FROM chunks"))
def retrieval_preview(spark, sf_dir):
    return chunks(spark, sf_dir, vectors=False).select("chunk_id", F.substring(F.regexp_replace("content", r"\s+", " "), 1, 120).alias("preview"), F.substring("source_ref", 1, 200).alias("ref"), F.length("content").cast("long").alias("chars"))


# Openings of turns that are talk rather than questions of content.
TALK = r"^(hi|hello|hey|hiya|yo|good (morning|afternoon|evening)|thanks|thank you|thx|cheers|bye|goodbye)\b"
SHORT_TALK = r"^(ok|okay|yes|no|sure|sounds good|nice to meet you)\b"
LOOKUP = r"^(what is|what's|who is|who's|do you have|what about)\b"
_SAID = "CASE turn % 5 WHEN 0 THEN concat('hello ', text) WHEN 1 THEN 'ok then' WHEN 2 THEN 'what is src3' WHEN 3 THEN concat('explain the router ', text) ELSE text END"


@query(
    "j17_conversational",
    f"""WITH t AS (SELECT conv_id, turn, lower(trim({_SAID})) AS q FROM conversations)
    SELECT conv_id, turn, q = '' OR (length(q) <= 360 AND NOT regexp_matches(q, 'router|explain the|database|codebase')
      AND (regexp_matches(q, '{TALK}') OR (length(q) < 64 AND regexp_matches(q, '{SHORT_TALK}')) OR (length(q) <= 80 AND regexp_matches(q, '{LOOKUP.replace("'", "''")}')))) AS is_talk FROM t""",
)
def conversational(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.trim(F.expr(_SAID))).alias("q"))
    q, size = F.col("q"), F.length("q")
    talk = q.rlike(tx.ascii_rules(TALK)) | ((size < 64) & q.rlike(tx.ascii_rules(SHORT_TALK))) | ((size <= 80) & q.rlike(tx.ascii_rules(LOOKUP)))
    return rows.select("conv_id", "turn", ((q == "") | ((size <= 360) & ~q.rlike("router|explain the|database|codebase") & talk)).alias("is_talk"))


@query("j32_profiles", with_views("SELECT DISTINCT twin_id, coalesce(CASE WHEN source_id % 3 = 0 THEN 'large' END, 'primary') AS model, coalesce(CASE WHEN source_id % 4 = 0 THEN 512 END, 1024) AS dimensions FROM sources s WHERE status = 'ready' AND EXISTS (SELECT 1 FROM chunks c WHERE c.source_id = s.source_id AND c.embedding IS NOT NULL)"))
def profiles(spark, sf_dir):
    embedded = chunks(spark, sf_dir).where("embedding is not null").select("source_id")
    ready = sources(spark, sf_dir).where("status = 'ready'").join(embedded, "source_id", "left_semi")
    model, size = F.coalesce(F.when(F.col("source_id") % 3 == 0, "large"), F.lit("primary")), F.coalesce(F.when(F.col("source_id") % 4 == 0, 512), F.lit(1024))
    return ready.select("twin_id", model.alias("model"), size.alias("dimensions")).distinct()


@query(
    "j07_missing_evidence",
    with_views("""h AS (SELECT q.query_id, count(c.chunk_id) FILTER (c.embedding IS NOT NULL) AS embedded, count(c.chunk_id) FILTER (contains(lower(c.content), lower(split_part(q.query, ' ', 1)))) AS lexical
      FROM questions q LEFT JOIN sources s ON s.twin_id = q.twin_id AND s.status = 'ready' AND s.source_id % 8 <> 3 LEFT JOIN chunks c ON c.source_id = s.source_id GROUP BY q.query_id)
    SELECT query_id, array_to_string(list_filter([CASE WHEN lexical = 0 THEN 'lexical' END, CASE WHEN embedded = 0 THEN 'no_embedding_profiles' END], lambda x: x IS NOT NULL), ',') AS missing FROM h"""),
)
def missing_evidence(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", "twin_id", F.lower(F.substring_index("query", " ", 1)).alias("word"))
    live = sources(spark, sf_dir).where("status = 'ready' and source_id % 8 <> 3").select("source_id", "twin_id")
    rows = chunks(spark, sf_dir).join(live, "source_id").select("twin_id", F.lower("content").alias("low"), F.col("embedding").isNotNull().alias("embedded"))
    embedded = rows.groupBy("twin_id").agg(F.count_if("embedded").alias("embedded"))
    words = asked.select("twin_id", "word").distinct()
    lexical = rows.join(words, "twin_id").where(F.col("low").contains(F.col("word"))).groupBy("twin_id", "word").agg(F.count("*").alias("lexical"))
    both = asked.join(embedded, "twin_id", "left").join(lexical, ["twin_id", "word"], "left").fillna(0, ["embedded", "lexical"])
    return both.select("query_id", F.array_join(F.array_compact(F.array(F.when(F.col("lexical") == 0, "lexical"), F.when(F.col("embedded") == 0, "no_embedding_profiles"))), ",").alias("missing"))


@query(
    "j11_graph_context",
    with_views("""r AS (SELECT src % 10 AS twin_id, edge_id, concat(src, ' -> ', dst) AS line FROM edges QUALIFY row_number() OVER (PARTITION BY src % 10 ORDER BY edge_id) <= 40)
    SELECT twin_id, string_agg(line, chr(10) ORDER BY edge_id) AS context FROM r GROUP BY twin_id"""),
)
def graph_context(spark, sf_dir):
    rows = edges(spark, sf_dir).select((F.col("src") % 10).alias("twin_id"), "edge_id", F.concat("src", F.lit(" -> "), "dst").alias("line"))
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("twin_id").orderBy("edge_id"))).where("no <= 40")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "line"))), lambda x: x["line"])
    return first.groupBy("twin_id").agg(F.array_join(lines, "\n").alias("context"))


@query(
    "j25_workspace_synthesis",
    with_views("""t AS (SELECT workspace_id, twin_id, count(*) AS n, count_if(status = 'ready') AS ready FROM sources GROUP BY ALL)
    SELECT workspace_id, concat('# Workspace ', workspace_id, chr(10), string_agg(concat('- twin ', twin_id, ': ', ready, ' of ', n, ' sources ready'), chr(10) ORDER BY twin_id)) AS page FROM t GROUP BY workspace_id"""),
)
def workspace_synthesis(spark, sf_dir):
    twins = sources(spark, sf_dir).groupBy("workspace_id", "twin_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready"))
    line = F.concat(F.lit("- twin "), "twin_id", F.lit(": "), "ready", F.lit(" of "), "n", F.lit(" sources ready"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("twin_id", line.alias("line")))), lambda x: x["line"])
    return twins.groupBy("workspace_id").agg(F.concat(F.lit("# Workspace "), "workspace_id", F.lit("\n"), F.array_join(lines, "\n")).alias("page"))


@query(
    "j37_authority",
    """WITH r AS (SELECT doc_id, list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'unsafe' END, CASE WHEN doc_id % 7 = 0 THEN 'thin_evidence' END], lambda x: x IS NOT NULL) AS rs FROM labels)
    SELECT doc_id, array_to_string(rs, ',') AS reasons, CASE len(rs) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS authority FROM r""",
)
def authority(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "unsafe"), F.when(F.col("doc_id") % 7 == 0, "thin_evidence")))
    rows = table(spark, sf_dir, "labels").select("doc_id", reasons.alias("rs"))
    return rows.select("doc_id", F.array_join("rs", ",").alias("reasons"), F.when(F.size("rs") == 0, "high").when(F.size("rs") == 1, "medium").otherwise("low").alias("authority"))


@query(
    "b17_row_contract",
    with_views("""k AS (SELECT chunk_id, CASE WHEN source_type = 'manual' THEN 'synthetic_profile' ELSE 'file_backed' END AS lineage, CASE WHEN chunk_id % 6 > 0 THEN 's' END AS snapshot_id,
      CASE WHEN chunk_id % 10 > 0 THEN 3 END AS start_line, CASE WHEN chunk_id % 8 > 0 THEN 5 ELSE 1 END AS end_line FROM chunks JOIN sources USING (source_id))
    SELECT chunk_id FROM k WHERE lineage = 'file_backed' AND NOT coalesce(snapshot_id IS NOT NULL AND start_line <= end_line, false)"""),
)
def row_contract(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir), "source_id")
    when = lambda every, value: F.when(F.col("chunk_id") % every > 0, value)
    lineage = F.when(F.col("source_type") == "manual", "synthetic_profile").otherwise("file_backed")
    return violations(rows.select("chunk_id", "source_ref", lineage.alias("lineage"), when(6, "s").alias("snapshot_id"), F.lit("g").alias("segment_id"), F.lit("h").alias("content_hash"), when(10, 3).alias("start_line"), when(8, 5).otherwise(1).alias("end_line"))).select("chunk_id")


@query(
    "b07_origin_metadata",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN url IS NOT NULL THEN concat('name=', url) END, concat('page_count=', page_id % 9)], lambda x: x IS NOT NULL), ';') AS kept FROM pages""",
)
def origin_metadata(spark, sf_dir):
    allowed = ("drive_file_id", "name", "modified_time", "page_count", "source_path", "revision_id", "title", "source_type")  # fixed values
    raw = F.create_map(F.lit("name"), F.col("url"), F.lit("secret_key"), F.lit("x"), F.lit("page_count"), (F.col("page_id") % 9).cast("string"))
    kept = F.map_filter(raw, lambda k, v: k.isin(*allowed) & v.isNotNull())
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("kept"))
