"""Workspace retrieval: routing by structure and by name, fan-out over twins, evidence files, contracts and scope replies."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.operators import retrieval as rt
from scriptorium.plans.registry import query
from scriptorium.plans.retrieval import _HINTS, _LAYERS, twin_retrieval, twin_routing
from scriptorium.plans.views import chunks, questions, sources, table, with_views

_KEYS = ("EN / src1", "fr/", "part2", "en/src13", "nowhere", "de/src13/part1")
_KEY_SQL = str(list(_KEYS))
_MATCH = f"""rs AS (SELECT twin_id, source_ref AS file, regexp_replace(source_ref, '/[^/]*$', '') AS dir FROM chunks JOIN sources USING (source_id) WHERE status = 'ready' GROUP BY ALL),
hs AS (SELECT query_id, replace(lower({_KEY_SQL}[query_id % 6 + 1]), ' ', '') AS hint FROM questions),
dm AS (SELECT DISTINCT query_id, twin_id, hint, dir AS ref FROM hs JOIN (SELECT DISTINCT twin_id, dir FROM rs) ON starts_with(replace(lower(dir), ' ', ''), hint)),
fm AS (SELECT DISTINCT query_id, twin_id, hint, file AS ref FROM hs JOIN rs ON starts_with(replace(lower(file), ' ', ''), hint) OR (length(hint) >= 4 AND contains(replace(lower(file), ' ', ''), hint))
  WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.query_id = hs.query_id AND dm.twin_id = rs.twin_id)),
sm AS (SELECT query_id, twin_id, hint, 'dir' AS kind, ref FROM dm UNION ALL SELECT query_id, twin_id, hint, 'file', ref FROM fm)"""


def _structure_matches(spark, sf_dir):
    """Folders of a twin that start with a question's hint; where there are none, its files that start with it or, from four characters on, hold it.

    Hints are few and distinct ones are met with distinct paths; the pairs come from a comparison, not from a key.
    """
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    ready = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    files = ready.select("twin_id", F.col("source_ref").alias("ref")).distinct().withColumn("low", plain(F.col("ref")))
    dirs = files.select("twin_id", F.regexp_replace("ref", "/[^/]*$", "").alias("ref")).distinct().withColumn("low", plain(F.col("ref")))
    keys = F.array(*map(F.lit, _KEYS))
    asked = questions(spark, sf_dir).select("query_id", plain(F.element_at(keys, (F.col("query_id") % 6 + 1).cast("int"))).alias("hint"))
    hints = asked.select("hint").distinct()
    in_dirs = dirs.join(hints, F.col("low").startswith(F.col("hint"))).select("twin_id", "hint", F.lit("dir").alias("kind"), "ref")
    holds = F.col("low").startswith(F.col("hint")) | ((F.length("hint") >= 4) & F.col("low").contains(F.col("hint")))
    in_files = files.join(hints, holds).join(in_dirs.select("twin_id", "hint").distinct(), ["twin_id", "hint"], "left_anti").select("twin_id", "hint", F.lit("file").alias("kind"), "ref")
    return asked.join(in_dirs.unionByName(in_files), "hint").select("query_id", "twin_id", "hint", "kind", "ref")


@query("c13_structure_hints", with_views(_MATCH + " SELECT query_id, twin_id, hint, kind, ref FROM sm"))
def structure_hints(spark, sf_dir):
    return _structure_matches(spark, sf_dir)


_ROUTE = "sr AS (SELECT query_id, min(twin_id) AS twin_id FROM sm GROUP BY query_id HAVING count(DISTINCT twin_id) = 1)"


def _structure_route(spark, sf_dir):
    one = _structure_matches(spark, sf_dir).groupBy("query_id").agg(F.min("twin_id").alias("twin_id"), F.max("twin_id").alias("other"))
    return one.where("twin_id = other").select("query_id", "twin_id")


@query("j04_structure_routing", with_views(_MATCH + ", " + _ROUTE + " SELECT query_id, twin_id FROM sr"))
def structure_routing(spark, sf_dir):
    """Questions whose hint is found in exactly one twin."""
    return _structure_route(spark, sf_dir)


@query(
    "j03_workspace_routing",
    with_views(_MATCH + ", " + _ROUTE + """, ready AS (SELECT c.*, s.twin_id, s.workspace_id FROM chunks c JOIN sources s USING (source_id) WHERE s.status = 'ready'),
    vp AS (SELECT q.query_id, c.chunk_id, c.twin_id, round(list_cosine_similarity(c.embedding, q.vector), 6) AS score FROM ready c JOIN questions q ON q.query_id % 2 = c.workspace_id
      WHERE c.embedding IS NOT NULL AND q.vector IS NOT NULL AND chunk_type NOT IN ('memory_brief', 'code_snippet')),
    t AS (SELECT * FROM vp WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 12),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, twin_id ORDER BY score DESC, chunk_id) AS n FROM t QUALIFY n <= 3),
    m AS (SELECT query_id, twin_id, round(avg(score), 8) AS routing_score, min({'s': -score, 'c': chunk_id}) AS f FROM b GROUP BY ALL),
    vr AS (SELECT query_id, twin_id FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY routing_score DESC, f) = 1)
    SELECT query_id, coalesce(sr.twin_id, vr.twin_id) AS twin_id, CASE WHEN sr.twin_id IS NOT NULL THEN 'structure' WHEN vr.twin_id IS NOT NULL THEN 'scores' ELSE 'none' END AS routed_by
    FROM questions LEFT JOIN sr USING (query_id) LEFT JOIN vr USING (query_id)"""),
)
def workspace_routing(spark, sf_dir):
    """The twin of each question: by structure where that names exactly one, else by the scores of its best candidates."""
    named = _structure_route(spark, sf_dir).withColumnRenamed("twin_id", "named")
    scored = twin_routing(spark, sf_dir).select("query_id", F.col("twin_id").alias("scored"))
    both = questions(spark, sf_dir).select("query_id").join(named, "query_id", "left").join(scored, "query_id", "left")
    how = F.when(F.col("named").isNotNull(), "structure").when(F.col("scored").isNotNull(), "scores").otherwise("none")
    return both.select("query_id", F.coalesce("named", "scored").alias("twin_id"), how.alias("routed_by"))


_BEST = _LAYERS + _HINTS + """, dm AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS many, row_number() OVER (PARTITION BY query_id, source_ref ORDER BY score DESC, chunk_id) AS place FROM fused),
sc AS (SELECT query_id, chunk_id, source_ref, round(CASE WHEN many >= 4 AND place > 2 THEN score * 0.62 ELSE score END, 6)::DOUBLE AS score, match_reasons FROM dm),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 8),
un AS (SELECT query_id, source_ref AS path, rank, unnest(match_reasons) AS reason, generate_subscripts(match_reasons, 1) AS no FROM best),
fi AS (SELECT query_id, path, reason, min({'r': rank, 'n': no}) AS seen FROM un GROUP BY ALL),
pf AS (SELECT query_id, path, string_agg(reason, ', ' ORDER BY seen) AS reasons, (CASE WHEN starts_with(lower(path), '__memory__/') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '(agents\\.md|claude\\.md|\\.docx)$|/templates/') THEN 20 ELSE 0 END
  - CASE WHEN bool_or(regexp_matches(reason, '^(symbol|file|path)(:|$)')) THEN 15 ELSE 0 END - CASE WHEN regexp_matches(lower(path), 'auth|logout|refresh|session|token|dashboard') THEN 8 ELSE 0 END)::INT AS priority FROM fi GROUP BY query_id, path)"""


def _packet_files(spark, sf_dir):
    """(query_id, path, reasons, priority) of the files behind each question's best chunks; reasons as first seen."""
    best = twin_retrieval(spark, sf_dir).select("query_id", "rank", F.col("source_ref").alias("path"), F.posexplode(F.split("match_reasons", ",")).alias("no", "reason"))
    seen = best.groupBy("query_id", "path", "reason").agg(F.min(F.struct("rank", "no")).alias("at"))
    low = F.lower("path")
    # fixed values: what moves a file up or down
    points = F.when(low.startswith("__memory__/"), 40).otherwise(0) + F.when(low.rlike(r"(agents\.md|claude\.md|\.docx)$|/templates/"), 20).otherwise(0)
    named = F.bool_or(F.col("reason").rlike(r"^(symbol|file|path)(:|$)"))
    topics = F.when(low.rlike("auth|logout|refresh|session|token|dashboard"), 8).otherwise(0)
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda s: s["reason"]), ", ")
    return seen.groupBy("query_id", "path").agg(reasons.alias("reasons"), named.alias("named")).select("query_id", "path", "reasons", (points - F.when(F.col("named"), 15).otherwise(0) - topics).alias("priority"))


@query("f06_packet_files", with_views(_BEST + " SELECT query_id, path, reasons, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, path)::INT AS position FROM pf"))
def packet_files(spark, sf_dir):
    return _packet_files(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "path")))


@query(
    "j08_graph_seeds",
    with_views("""s AS (SELECT q.query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.vector), 6) AS score FROM questions q JOIN embeddings e ON e.vec_id % 4 = q.twin_id WHERE q.vector IS NOT NULL)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= 0.15 QUALIFY rank <= 5"""),
)
def graph_seeds(spark, sf_dir):
    """The five entities of the question's twin that are nearest to it, above the least score."""
    entities = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(None).cast("string").alias("source_ref"), (F.col("vec_id") % 4).cast("int").alias("twin_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("entity").alias("chunk_type"))
    return rt.vector_candidates(questions(spark, sf_dir), entities, 5).select("query_id", F.col("chunk_id").alias("vec_id"), "score", "rank")


@query(
    "j23_scope_reply",
    with_views("""t AS (SELECT workspace_id, twin_id, count_if(status = 'ready') AS ready, string_agg(name, ', ' ORDER BY name) FILTER (status = 'ready') AS names FROM sources GROUP BY ALL)
    SELECT workspace_id, concat('This workspace has ', count(*), ' twins, ', count_if(ready > 0), ' of them ready.', chr(10), chr(10), 'Covered:', chr(10), string_agg(concat('- twin ', twin_id, ': ', coalesce(names, 'no ready sources')), chr(10) ORDER BY twin_id)) AS reply FROM t GROUP BY workspace_id"""),
)
def scope_reply(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "ready", F.col("name")))), ", ")
    twins = sources(spark, sf_dir).groupBy("workspace_id", "twin_id").agg(F.count_if(F.col("status") == "ready").alias("ready"), names.alias("names"))
    line = F.concat(F.lit("- twin "), "twin_id", F.lit(": "), F.coalesce(F.nullif("names", F.lit("")), F.lit("no ready sources")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("twin_id", line.alias("line")))), lambda s: s["line"])
    text = F.concat(F.lit("This workspace has "), F.count("*"), F.lit(" twins, "), F.count_if(F.col("ready") > 0), F.lit(" of them ready.\n\nCovered:\n"), F.array_join(lines, "\n"))
    return twins.groupBy("workspace_id").agg(text.alias("reply"))


_TITLES = "concat(upper(substr(name, 1, 1)), substr(name, 2), CASE source_id % 3 WHEN 0 THEN ' Twin' WHEN 1 THEN '-x Project' ELSE '' END)"


@query(
    "i21_aliases",
    with_views(f"""n AS (SELECT source_id, {_TITLES} AS title FROM sources),
    e AS (SELECT source_id, title AS alias FROM n UNION SELECT source_id, trim(substr(title, 1, length(title) - 5)) FROM n WHERE lower(title) LIKE '% twin' UNION SELECT source_id, trim(substr(title, 1, length(title) - 8)) FROM n WHERE lower(title) LIKE '% project')
    SELECT source_id, string_agg(trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')), '|' ORDER BY length(alias) DESC, alias) AS aliases FROM e GROUP BY source_id"""),
)
def aliases(spark, sf_dir):
    """The names by which a twin may be asked for, longest first, in the form in which they are compared."""
    title = F.expr(_TITLES)
    cut = lambda end: F.when(F.lower(title).endswith(end), F.trim(F.substring(title, F.lit(1), F.length(title) - len(end))))
    every = F.array_distinct(F.array_compact(F.array(title, cut(" twin"), cut(" project"))))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    plain = F.transform(ordered, lambda s: F.trim(F.regexp_replace(F.lower(s["x"]), "[^a-z0-9]+", " ")))
    return sources(spark, sf_dir).select("source_id", F.array_join(plain, "|").alias("aliases"))
