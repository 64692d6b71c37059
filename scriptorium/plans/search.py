"""Ranked full-text search of whole questions: terms, matches, cover density, scores, and the fallback on substrings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import retrieval as rt, search
from scriptorium.plans.registry import query
from scriptorium.plans.retrieval import _LAYERS, _base
from scriptorium.plans.views import with_views
from scriptorium.sources.folders import stored

_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_FULL_TEXT = f""", tks AS (SELECT query_id, twin_id, regexp_extract_all(coalesce(query, ''), '-?"[^"]*"?|[^\\s"!&|()]+') AS ts FROM searches),
tok AS (SELECT query_id, twin_id, ts, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tks),
tor AS (SELECT *, lower(t) = 'or' AND i > 1 AND i < len(ts) AND lower(ts[i - 1]) <> 'or' AS op FROM tok),
tgr AS (SELECT *, sum(op::INT) OVER (PARTITION BY query_id ORDER BY i) AS grp FROM tor),
itm AS (SELECT query_id, twin_id, grp, starts_with(t, '-') AS neg, {_WORDS.format('t')} AS ws, min(i) AS item FROM tgr WHERE NOT op AND len({_WORDS.format('t')}) > 0 GROUP BY ALL),
need AS (SELECT query_id, grp, count(*) AS n FROM itm WHERE NOT neg GROUP BY ALL),
iw AS (SELECT query_id, twin_id, grp, item, neg, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS o FROM itm),
cw AS (SELECT chunk_id, twin_id, source_ref, {_WORDS.format('source_ref')} AS head, {_WORDS.format("coalesce(content, '')")} AS body FROM ready WHERE chunk_type <> 'memory_brief'),
pw AS (SELECT chunk_id, twin_id, source_ref, len(head) AS first, unnest(head || body) AS word, generate_subscripts(head || body, 1) AS pos FROM cw),
hp AS (SELECT query_id, chunk_id, source_ref, grp, item, neg, size, o, pos, CASE WHEN pos <= first THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS cost FROM pw JOIN iw USING (twin_id, word)),
oc AS (SELECT query_id, chunk_id, source_ref, grp, item, neg, size, pos - o + size - 1 AS pos, sum(cost) AS own FROM hp GROUP BY query_id, chunk_id, source_ref, grp, item, neg, size, pos - o + size - 1 HAVING count(*) = size),
okg AS (SELECT query_id, chunk_id, grp, n FROM oc JOIN need USING (query_id, grp) GROUP BY ALL HAVING count(DISTINCT item) FILTER (NOT neg) = n AND count(*) FILTER (neg) = 0),
ent AS (SELECT *, row_number() OVER w AS idx, sum(cost) OVER w AS upto FROM (SELECT DISTINCT query_id, chunk_id, pos, cost FROM hp SEMI JOIN okg USING (query_id, chunk_id) WHERE NOT neg) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos)),
sto AS (SELECT oc.query_id, oc.chunk_id, source_ref, oc.grp, item, n, idx, oc.pos, upto, {{'idx': idx - size + 1, 'pos': oc.pos - size + 1, 'before': upto - own}} AS b FROM oc JOIN okg USING (query_id, chunk_id, grp) JOIN ent ON ent.query_id = oc.query_id AND ent.chunk_id = oc.chunk_id AND ent.pos = oc.pos),
oth AS (SELECT sto.*, itm.item AS other FROM sto JOIN itm ON itm.query_id = sto.query_id AND itm.grp = sto.grp AND NOT itm.neg),
las AS (SELECT *, max(CASE WHEN item = other THEN b END) OVER (PARTITION BY query_id, chunk_id, grp, other ORDER BY idx) AS last FROM oth),
byg AS (SELECT query_id, chunk_id, source_ref, grp, idx, pos, upto, min(last) AS b FROM las GROUP BY query_id, chunk_id, source_ref, grp, idx, pos, upto, n HAVING count(DISTINCT other) FILTER (last IS NOT NULL) = n),
str AS (SELECT query_id, chunk_id, source_ref, idx, pos, upto, max(b) AS b FROM byg GROUP BY ALL),
hf AS (SELECT * FROM str QUALIFY coalesce(b.idx > lag(b.idx) OVER (PARTITION BY query_id, chunk_id ORDER BY idx), true)),
cd AS (SELECT query_id, chunk_id, source_ref, count(*) AS covers, sum((idx - b.idx + 1) / (upto - b.before) / (1 + pos - b.pos - (idx - b.idx))) AS density FROM hf GROUP BY ALL),
ft AS (SELECT query_id, chunk_id, source_ref, round(least(0.95, 0.35 + density), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(least(0.95, 0.35 + density), 6) DESC, chunk_id) AS rank FROM cd QUALIFY rank <= 6)"""
_WHOLE = ", searches AS (SELECT query_id, twin_id, query FROM questions)"
# each question as it stands; its ends, then its start as phrases and words that may or must not occur; and its halves, parted by `or`
_FORMS = (
    "query",
    "concat(ws[1], ' -', ws[2], ' -\"', ws[3], ' ', ws[4], '\"')",
    "concat('\"', ws[1], ' ', ws[2], '\" ', ws[3], ' or ', ws[4], '-', ws[5], ' -', ws[1])",
    "concat('or ', ws[1], ' ', ws[2], ' OR \"', ws[2], ' ', ws[3], ' ', ws[4], '\" or \"', ws[5], ' ', ws[6])",
    "concat(array_to_string(ws[:len(ws) // 2], ' '), ' or ', array_to_string(ws[len(ws) // 2 + 1:], ' '))",
)
_SYNTAX = f""", fw AS (SELECT query_id, twin_id, query, list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '') AS ws FROM questions),
searches AS (SELECT query_id * 5 + form AS query_id, twin_id, CASE form {' '.join(f'WHEN {k} THEN {sql}' for k, sql in enumerate(_FORMS))} END AS query FROM fw, (SELECT unnest(range(5)) AS form))"""


def _parts(spark, sf_dir):
    asked, ready = _base(spark, sf_dir, vectors=False)
    return asked.select("query_id", "twin_id", "query"), ready.where("chunk_type <> 'memory_brief'")


def _syntax(asked):
    """Five searches for each question, numbered by ``query_id * 5 + form``, that between them use all of the syntax."""
    w = asked.withColumn("ws", F.filter(F.split("query", r"\s+"), lambda x: x != ""))
    at = lambda k: F.coalesce(F.get("ws", F.lit(k - 1)), F.lit(""))
    half = F.floor(F.size("ws") / 2).cast("int")
    forms = (
        F.col("query"),
        F.concat(at(1), F.lit(" -"), at(2), F.lit(' -"'), at(3), F.lit(" "), at(4), F.lit('"')),
        F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" '), at(3), F.lit(" or "), at(4), F.lit("-"), at(5), F.lit(" -"), at(1)),
        F.concat(F.lit("or "), at(1), F.lit(" "), at(2), F.lit(' OR "'), at(2), F.lit(" "), at(3), F.lit(" "), at(4), F.lit('" or "'), at(5), F.lit(" "), at(6)),
        F.concat(F.array_join(F.slice("ws", F.lit(1), half), " "), F.lit(" or "), F.array_join(F.slice("ws", half + 1, F.size("ws")), " ")),
    )
    return w.select("query_id", "twin_id", F.posexplode(F.array(*forms)).alias("form", "text")).select((F.col("query_id") * 5 + F.col("form")).alias("query_id"), "twin_id", F.col("text").alias("query"))


def ranked(asked, ready):
    """(query_id, chunk_id, source_ref, score, rank) of the best full-text rows of each (query_id, twin_id, query)."""
    scored = search.cover_density(asked, ready).select("query_id", "chunk_id", "source_ref", search.lexical_score(F.col("density")).alias("score"))
    return rt.top_per_query(scored, [F.desc("score"), F.col("chunk_id")], rt.LEXICAL_BUDGET)


@query("i01_search_terms", with_views(_LAYERS + _SYNTAX + _FULL_TEXT + " SELECT query_id, twin_id, grp::INT AS grp, (item - 1)::INT AS item, neg AS negative, array_to_string(ws, ' ') AS words FROM itm"))
def search_terms(spark, sf_dir):
    """What each search asks for: alternative groups of required and excluded terms."""
    return search.terms(_syntax(_parts(spark, sf_dir)[0])).select("query_id", "twin_id", "grp", "item", "negative", F.array_join("words", " ").alias("words"))


@query("i01_web_search", with_views(_LAYERS + _SYNTAX + _FULL_TEXT + " SELECT query_id, chunk_id, covers, round(density, 6)::DOUBLE AS density FROM cd"))
def web_search(spark, sf_dir):
    """All chunks that match searches with phrases, alternatives and exclusions, and how densely."""
    asked, ready = _parts(spark, sf_dir)
    return search.cover_density(_syntax(asked), ready).select("query_id", "chunk_id", "covers", F.round("density", 6).alias("density"))


@query("i02_cover_density", with_views(_LAYERS + _WHOLE + _FULL_TEXT + " SELECT query_id, chunk_id, covers, round(density, 6)::DOUBLE AS density FROM cd"))
def cover_density(spark, sf_dir):
    return search.cover_density(*_parts(spark, sf_dir)).select("query_id", "chunk_id", "covers", F.round("density", 6).alias("density"))


@query("f02_lexical_topk", with_views(_LAYERS + _SYNTAX + _FULL_TEXT + " SELECT query_id, chunk_id, source_ref, score, rank::INT AS rank FROM ft"))
def lexical_topk(spark, sf_dir):
    asked, ready = _parts(spark, sf_dir)
    return ranked(_syntax(asked), ready).select("query_id", "chunk_id", "source_ref", "score", "rank")


@query(
    "j05_lexical_or_substring",
    with_views(_LAYERS + _WHOLE + _FULL_TEXT + """ SELECT query_id, chunk_id, source_ref, score, rank::INT AS rank, 'full_text' AS found_by FROM ft
    UNION ALL SELECT query_id, chunk_id, source_ref, score, rank::INT, 'substring' FROM sub WHERE query_id NOT IN (SELECT query_id FROM ft)"""),
)
def lexical_or_substring(spark, sf_dir):
    """Full-text rows of each whole question; of questions that have none, substring rows."""
    return lexical(*_parts(spark, sf_dir)).withColumn("found_by", F.when(F.col("full"), "full_text").otherwise("substring")).drop("full")


def lexical(asked, ready):
    columns = ["query_id", "chunk_id", "source_ref", "score", "rank"]
    full = stored(ranked(asked, ready).select(*columns), "full")
    other = rt.substring_candidates(asked.join(full.select("query_id").distinct(), "query_id", "left_anti"), ready).select(*columns)
    return full.withColumn("full", F.lit(True)).unionByName(other.withColumn("full", F.lit(False)))
