"""Retrieval queries: all benchmark questions against all chunks of their twins, and graph expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import graph, retrieval as rt
from scriptorium.plans.registry import query
from scriptorium.plans.views import chunks, edges, questions, sources, with_views

_STOP = str(rt.STOPWORDS)
_LAYERS = f"""ready AS (SELECT c.*, s.twin_id, s.workspace_id FROM chunks c JOIN sources s USING (source_id) WHERE s.status = 'ready'),
vp AS (SELECT q.query_id, c.chunk_id, c.source_ref, c.twin_id, round(list_cosine_similarity(c.embedding, q.vector), 6) AS score
  FROM ready c JOIN questions q ON q.twin_id = c.twin_id WHERE c.embedding IS NOT NULL AND q.vector IS NOT NULL AND chunk_type NOT IN ('memory_brief', 'code_snippet')),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vp WHERE score >= 0.15 QUALIFY rank <= 8),
tk AS (SELECT query_id, twin_id, list_distinct(list_transform(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_./-]{{1,}}'), lambda x: regexp_replace(lower(x), '^[.,;:!?)\\]}}]+|[.,;:!?)\\]}}]+$', '', 'g'))) AS ws,
  list_transform(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_./-]{{1,}}'), lambda x: regexp_replace(lower(x), '^[.,;:!?)\\]}}]+|[.,;:!?)\\]}}]+$', '', 'g')) AS seq FROM questions),
tw AS (SELECT query_id, twin_id, unnest(list_filter(ws, lambda x: length(x) >= 3 AND x NOT IN {_STOP})) AS w, seq FROM tk),
tp AS (SELECT *, CASE WHEN contains(w, '/') OR contains(w, '.') THEN 0 WHEN regexp_matches(w, 'week\\d+') THEN 1 WHEN length(w) >= 10 THEN 2 ELSE 3 END AS p, list_position(seq, w) AS i FROM tw),
tr AS (SELECT query_id, twin_id, w, row_number() OVER (PARTITION BY query_id ORDER BY p, CASE WHEN p < 3 THEN -length(w) ELSE 0 END, i) AS no FROM tp),
toks AS (SELECT query_id, twin_id, array_agg(w ORDER BY no) AS tokens FROM tr WHERE no <= 16 GROUP BY ALL),
sp AS (SELECT t.query_id, c.chunk_id, c.source_ref, len(list_filter(t.tokens, lambda x: contains(lower(c.source_ref) || chr(10) || lower(coalesce(c.content, '')), x))) AS hits
  FROM ready c JOIN toks t ON t.twin_id = c.twin_id WHERE chunk_type <> 'memory_brief' AND source_ref NOT LIKE '__memory__/%'),
sub AS (SELECT query_id, chunk_id, source_ref, round(least(0.9, 0.32 + 0.08 * hits)::DOUBLE, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY least(0.9, 0.32 + 0.08 * hits) DESC, source_ref, chunk_id) AS rank FROM sp WHERE hits > 0 QUALIFY rank <= 6)"""
_HINTS = """, hints AS (SELECT query_id, twin_id, vector, ['en/src', 'fr/', 'de/src_/part', 'es/%part2'][query_id % 4 + 1] AS hint FROM questions),
pp AS (SELECT h.query_id, h.hint, c.chunk_id, c.source_ref, round(list_cosine_similarity(c.embedding, h.vector), 6) AS near FROM ready c JOIN hints h ON h.twin_id = c.twin_id
  WHERE chunk_type <> 'code_snippet' AND lower(source_ref) LIKE concat(hint, '%')),
path AS (SELECT query_id, hint, chunk_id, source_ref, coalesce(near, 0.5)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY near IS NULL, near DESC, lower(source_ref), chunk_id) AS rank FROM pp QUALIFY rank <= 4),
allc AS (SELECT query_id, chunk_id, source_ref, score, 'vector' AS reason, 0 AS layer, rank FROM vec UNION ALL SELECT query_id, chunk_id, source_ref, score, 'lexical', 1, rank FROM sub
  UNION ALL SELECT query_id, chunk_id, source_ref, score, concat('path:', hint), 2, rank FROM path),
fused AS (SELECT query_id, chunk_id, min(source_ref) AS source_ref, max(score) AS score, array_agg(reason ORDER BY layer, rank) AS match_reasons FROM allc GROUP BY query_id, chunk_id)"""


def _base(spark, sf_dir, vectors=True):
    return questions(spark, sf_dir), rt.eligible(chunks(spark, sf_dir, vectors), sources(spark, sf_dir))


@query("f01_vector_topk", with_views(_LAYERS + " SELECT query_id, chunk_id, source_ref, twin_id, score, rank::INT AS rank FROM vec"))
def vector_topk(spark, sf_dir):
    return rt.vector_candidates(*_base(spark, sf_dir))


@query("i03_query_tokens", with_views(_LAYERS + " SELECT query_id, array_to_string(tokens, ' ') AS tokens FROM toks"))
def tokens(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(F.slice(rt.query_tokens(F.col("query")), 1, rt.MAX_TOKENS), " ").alias("tokens"))


@query("f03_substring_topk", with_views(_LAYERS + " SELECT query_id, chunk_id, source_ref, score, rank::INT AS rank FROM sub"))
def substring_topk(spark, sf_dir):
    return rt.substring_candidates(*_base(spark, sf_dir, vectors=False))


def _hints(asked):
    kinds = F.array(*map(F.lit, ("en/src", "fr/", "de/src_/part", "es/%part2")))
    return asked.select("query_id", "twin_id", "vector", F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")).alias("hint"))


@query("f04_path_top4", with_views(_LAYERS + _HINTS + " SELECT query_id, hint, chunk_id, source_ref, score, rank::INT AS rank FROM path"))
def path_top4(spark, sf_dir):
    asked, ready = _base(spark, sf_dir)
    return rt.path_candidates(_hints(asked), ready).select("query_id", "hint", "chunk_id", "source_ref", "score", "rank")


def _fused(spark, sf_dir):
    asked, ready = _base(spark, sf_dir)
    columns = ["query_id", "chunk_id", "source_ref", "score", "reason", "layer", "rank"]
    layers = [
        rt.vector_candidates(asked, ready).withColumn("reason", F.lit("vector")).withColumn("layer", F.lit(0)),
        rt.substring_candidates(*_base(spark, sf_dir, vectors=False)).withColumn("reason", F.lit("lexical")).withColumn("layer", F.lit(1)),
        rt.path_candidates(_hints(asked), ready).withColumn("reason", F.concat(F.lit("path:"), "hint")).withColumn("layer", F.lit(2)),
    ]
    return rt.fuse(layers[0].select(*columns).unionByName(layers[1].select(*columns)).unionByName(layers[2].select(*columns)))


@query("d06_candidate_fusion", with_views(_LAYERS + _HINTS + " SELECT query_id, chunk_id, source_ref, score, array_to_string(match_reasons, ',') AS match_reasons FROM fused"))
def candidate_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", "source_ref", "score", F.array_join("match_reasons", ",").alias("match_reasons"))


@query(
    "j02_twin_retrieval",
    with_views(_LAYERS + _HINTS + """, dm AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS many, row_number() OVER (PARTITION BY query_id, source_ref ORDER BY score DESC, chunk_id) AS place FROM fused),
    sc AS (SELECT query_id, chunk_id, source_ref, round(CASE WHEN many >= 4 AND place > 2 THEN score * 0.62 ELSE score END, 6)::DOUBLE AS score, match_reasons FROM dm)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, source_ref, score, array_to_string(match_reasons, ',') AS match_reasons FROM sc QUALIFY rank <= 8"""),
)
def twin_retrieval(spark, sf_dir):
    best = rt.top_per_query(rt.demote(_fused(spark, sf_dir)), [F.desc("score"), F.col("chunk_id")], 8)
    return best.select("query_id", "rank", "chunk_id", "source_ref", "score", F.array_join("match_reasons", ",").alias("match_reasons"))


@query("d14_layer_hits", with_views(_LAYERS + _HINTS + ", r AS (SELECT query_id, unnest(match_reasons) AS reason FROM fused) SELECT query_id, string_split(reason, ':')[1] AS layer, count(*) AS hits FROM r GROUP BY ALL"))
def hits(spark, sf_dir):
    return rt.layer_hits(_fused(spark, sf_dir))


@query(
    "e07_guaranteed_refs",
    with_views(_LAYERS + """, refs AS (SELECT query_id, twin_id, vector, unnest(['en/src1', 'fr/', 'de/', 'es/', 'en/src2', 'en/']) AS hint, generate_subscripts(['en/src1', 'fr/', 'de/', 'es/', 'en/src2', 'en/'], 1) AS ref_no FROM questions),
    gp AS (SELECT r.query_id, r.ref_no, c.chunk_id, round(list_cosine_similarity(c.embedding, r.vector), 6) AS near, source_ref FROM ready c JOIN refs r ON r.twin_id = c.twin_id WHERE chunk_type <> 'code_snippet' AND lower(source_ref) LIKE concat(hint, '%')),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref_no ORDER BY near IS NULL, near DESC, lower(source_ref), chunk_id) AS place FROM gp QUALIFY place <= 2)
    SELECT query_id, ref_no::INT AS ref_no, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY ref_no, place)::INT AS rank FROM g QUALIFY rank <= 8"""),
)
def guaranteed_refs(spark, sf_dir):
    asked, ready = _base(spark, sf_dir)
    refs = asked.select("query_id", "twin_id", "vector", F.posexplode(F.array(*map(F.lit, ("en/src1", "fr/", "de/", "es/", "en/src2", "en/")))).alias("pos", "hint"))
    found = rt.path_candidates(refs, ready).join(refs.select("query_id", "hint", (F.col("pos") + 1).alias("ref_no")), ["query_id", "hint"])
    return rt.guaranteed(found).select("query_id", "ref_no", "chunk_id", "rank")


@query(
    "d07_twin_routing",
    with_views("""ready AS (SELECT c.*, s.twin_id, s.workspace_id FROM chunks c JOIN sources s USING (source_id) WHERE s.status = 'ready'),
    vp AS (SELECT q.query_id, c.chunk_id, c.twin_id, round(list_cosine_similarity(c.embedding, q.vector), 6) AS score FROM ready c JOIN questions q ON q.query_id % 2 = c.workspace_id
      WHERE c.embedding IS NOT NULL AND q.vector IS NOT NULL AND chunk_type NOT IN ('memory_brief', 'code_snippet')),
    t AS (SELECT * FROM vp WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 12),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, twin_id ORDER BY score DESC, chunk_id) AS n FROM t QUALIFY n <= 3),
    m AS (SELECT query_id, twin_id, round(avg(score), 8) AS routing_score, min({'s': -score, 'c': chunk_id}) AS f FROM b GROUP BY ALL)
    SELECT query_id, twin_id, routing_score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY routing_score DESC, f) = 1"""),
)
def twin_routing(spark, sf_dir):
    asked, ready = _base(spark, sf_dir)
    asked = asked.withColumn("workspace_id", (F.col("query_id") % 2).cast("int"))
    return rt.route(rt.vector_candidates(asked, ready, 12, scope="workspace_id"))


_WAYS = "ways AS (SELECT edge_id, src AS node, dst AS neighbour FROM edges UNION ALL SELECT edge_id, dst, src FROM edges WHERE src <> dst)"


@query("c06_neighbours", with_views(_WAYS + " SELECT node, count(*) AS degree, count(DISTINCT neighbour) AS neighbours FROM ways GROUP BY node"))
def neighbours(spark, sf_dir):
    return graph.both_ways(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("neighbour").alias("neighbours"))


@query(
    "j09_two_hops",
    with_views(_WAYS + """, h0 AS (SELECT query_id, query_id AS node, 0 AS depth, 1 AS position FROM questions),
    f1 AS (SELECT query_id, neighbour AS node, min({'p': position, 'e': edge_id}) AS way FROM h0 JOIN ways USING (node) GROUP BY ALL HAVING neighbour <> query_id),
    h1 AS (SELECT query_id, node, 1 AS depth, 1 + row_number() OVER (PARTITION BY query_id ORDER BY way) AS position FROM f1 QUALIFY position <= 20),
    f2 AS (SELECT h1.query_id, neighbour AS node, min({'p': position, 'e': edge_id}) AS way FROM h1 JOIN ways USING (node) GROUP BY ALL),
    n2 AS (SELECT f2.* FROM f2 WHERE node <> query_id AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.query_id = f2.query_id AND h1.node = f2.node)),
    h2 AS (SELECT query_id, node, 2 AS depth, (SELECT 1 + count(*) FROM h1 WHERE h1.query_id = n2.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY way) AS position FROM n2)
    SELECT query_id, node, depth, position::INT AS position FROM h0 UNION ALL SELECT query_id, node, depth, position::INT FROM h1 UNION ALL SELECT query_id, node, depth, position::INT FROM h2 WHERE position <= 20"""),
)
def two_hops(spark, sf_dir):
    seeds = questions(spark, sf_dir).select("query_id", F.col("query_id").alias("node"))
    return graph.expand(seeds, edges(spark, sf_dir))
