"""Query analysis: intent, path hints, retrieval modes, budgets, and flags of conversational questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_rules
from scriptorium.plans.registry import query
from scriptorium.plans.views import table

# Expressions that decide intent, mode and flags.
SPECIFIC = r"""(?i)(?:(?:the\s+)?\S+\.(?:pdf|docx?|md|txt|pptx?|xlsx?|csv)\b|\b(?:in|from|about|regarding|see|check|find)\s+the\s+["']?\w[\w\s-]{2,40}["']?)"""
PATH_HINT = r"(?i)\b(week\s*\d+|finale|guides?|community[_\s]contributions?)\b"
IDENTITY = r"(?i)\b(?:what\s+(?:is|'s)\s+your\s+name\b|who\s+are\s+you\b)\b"
COMPARE = r"\b(across\s+all|across\s+projects|all\s+projects|compare|which\s+projects|covered\s+projects)\b"
ENGINE = r"\b(engine|engines|intake|documents?|task\s+intelligence|verification|audit)\b"
BROAD = r"(?i)\b(tell me about|what is|what are|what does|what do|overview|explain|describe|summarize|summarise|walk me through|give me|show me|how does|how do|who are|who is|why does|why is|what can|introduce)\b"
HEDGE = r"(?i)\b(I don'?t have|I don'?t know|no information about|not have specific|only covers? (week|month|chapter|section)|I can'?t find|not available in|outside (of )?my knowledge|no data about)\b"
GREETING = r"(?i)^\s*(hi|hello|hey|hiya|yo|good\s+(morning|afternoon|evening))\b"
ANY_PROJECT = r"(?i)\b(any of|any one|one of|pick any|pick one|either one|whichever)\b"

# Candidates of each layer by mode.
BUDGETS = {"workspace_comparison": 7, "recruiter_summary": 7, "project_status": 6, "implementation": 8, "general": 6}

_TURN = "CASE turn % 6 WHEN 0 THEN concat('Tell me about the ', text) WHEN 1 THEN concat('compare week 3 engine ', text) WHEN 2 THEN concat('hello ', text) WHEN 3 THEN concat('see notes.pdf ', text) WHEN 4 THEN 'who are you' ELSE text END"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TURN).alias("q"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "i04_query_flags",
    f"""WITH t AS (SELECT conv_id, turn, {_TURN} AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, {_sql(SPECIFIC)}) THEN 'specific' ELSE 'general' END AS intent,
      replace(lower(nullif(regexp_extract(q, {_sql(PATH_HINT)}, 1), '')), ' ', '') AS path_hint, regexp_matches(q, {_sql(IDENTITY)}) AS is_identity,
      len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda x: x <> '')) <= 5 OR regexp_matches(q, {_sql(BROAD)}) AS is_broad, regexp_matches(q, {_sql(GREETING)}) AS is_greeting,
      regexp_matches(q, {_sql(HEDGE)}) AS is_hedge, regexp_matches(q, {_sql(ANY_PROJECT)}) AS is_any FROM t""",
)
def query_flags(spark, sf_dir):
    q = F.col("q")
    return _turns(spark, sf_dir).select(
        "conv_id", "turn",
        F.when(q.rlike(ascii_rules(SPECIFIC)), "specific").otherwise("general").alias("intent"),
        F.replace(F.lower(F.nullif(F.regexp_extract(q, ascii_rules(PATH_HINT), 1), F.lit(""))), F.lit(" "), F.lit("")).alias("path_hint"),
        q.rlike(ascii_rules(IDENTITY)).alias("is_identity"),
        ((F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda x: x != "")) <= 5) | q.rlike(ascii_rules(BROAD))).alias("is_broad"),
        q.rlike(ascii_rules(GREETING)).alias("is_greeting"), q.rlike(ascii_rules(HEDGE)).alias("is_hedge"), q.rlike(ascii_rules(ANY_PROJECT)).alias("is_any"),
    )


def mode(q: F.Column, workspace: F.Column) -> F.Column:
    """The first mode whose rule a question meets."""
    low = F.lower(q)
    loads = low.contains("dashboard") & low.rlike("load|query|fetch")
    return F.when(workspace & low.rlike(ascii_rules(COMPARE)), "workspace_comparison").when(loads | low.rlike(ascii_rules(ENGINE)), "implementation").otherwise("general")


@query(
    "j01_retrieval_plan",
    f"""WITH t AS (SELECT conv_id, turn, {_TURN} AS q FROM conversations),
    m AS (SELECT *, CASE WHEN conv_id % 2 = 0 AND regexp_matches(lower(q), '{COMPARE}') THEN 'workspace_comparison'
      WHEN (contains(lower(q), 'dashboard') AND regexp_matches(lower(q), 'load|query|fetch')) OR regexp_matches(lower(q), '{ENGINE}') THEN 'implementation' ELSE 'general' END AS mode,
      CASE WHEN regexp_matches(q, {_sql(SPECIFIC)}) THEN 12 ELSE 8 END AS top_k FROM t)
    SELECT conv_id, turn, mode, top_k, greatest(top_k, 8) AS dense_budget, CASE mode WHEN 'workspace_comparison' THEN 7 WHEN 'implementation' THEN 8 ELSE 6 END AS lexical_budget,
      CASE WHEN mode = 'implementation' THEN greatest(top_k * 3, 16) ELSE greatest(top_k * 2, 12) END AS rerank_budget, length(trim(q)) <= 280 AS whole_query FROM m""",
)
def retrieval_plan(spark, sf_dir):
    planned = _turns(spark, sf_dir).select("conv_id", "turn", "q", mode(F.col("q"), F.col("conv_id") % 2 == 0).alias("mode"), F.when(F.col("q").rlike(ascii_rules(SPECIFIC)), 12).otherwise(8).alias("top_k"))
    lexical = F.create_map(*[F.lit(x) for pair in BUDGETS.items() for x in pair])
    rerank = F.when(F.col("mode") == "implementation", F.greatest(F.col("top_k") * 3, F.lit(16))).otherwise(F.greatest(F.col("top_k") * 2, F.lit(12)))
    return planned.select("conv_id", "turn", "mode", "top_k", F.greatest("top_k", F.lit(8)).alias("dense_budget"), lexical[F.col("mode")].alias("lexical_budget"), rerank.alias("rerank_budget"), (F.length(F.trim("q")) <= 280).alias("whole_query"))
