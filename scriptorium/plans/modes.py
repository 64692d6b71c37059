"""Retrieval modes of questions, what each mode searches, the words added to a question, and flags of its scope."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions.text import ascii_rules
from scriptorium.plans.planning import COMPARE, ENGINE, SPECIFIC
from scriptorium.plans.registry import query
from scriptorium.plans.views import table

# Expressions, in lower case, that decide the mode and the added words.
RECRUITER = r"\b(experience\s+with|experience\s+(?:is|are|demonstrated)|demonstrated\s+.*experience|candidate|recruiter|capabilit(?:y|ies)|can\s+do\s+today|skills?|used\s+(python|fastapi|react|terraform|docker|aws))\b"
STATUS = r"\b(what\s+is\s+left|what['’]s\s+left|remaining|done|progress|status|week\s+\d+|sprint|next\s+step)\b"
IMPLEMENTATION = r"\b(where\s+(does|do)\b|where\s+is\b|where\s+are\b|which\s+file|which\s+files|walk\s+me\s+through|tests?|how\s+is\s+.+\bimplemented\b|how\s+does\s+.+\bwork\b|add\s+.+\b(feature|flow|functionality)\b|logout|sign[\s-]?up|sign[\s-]?in|login|auth(entication|orization)?)\b"
AUTH = r"\b(auth|authentication|authorization|login|logout|register|sign[\s-]?up|sign[\s-]?in|refresh|token|session|jwt|current[_\s-]?user|protected|guard|middleware)\b"
DASHBOARD = r"\b(dashboard|load|loaded|loading|query|fetch|usequery|page)\b"
PROJECT_FLOW = r"\b(projects?|project\s+lifecycle|owner(?:ship)?|create\s+project|list\s+projects?)\b"
DATA_MODEL = r"\b(data\s+model|models?|schema|entities|database\s+model)\b"
FRONTEND = r"\b(frontend|front-end|react|ui|browser|page|component|route\s+guard)\b"
TEST = r"\b(tests?|test\s+strategy|e2e|regression|pytest|coverage|prove)\b"
SNIPPET = r"\b(code\s+snippet|code\s+sample|show\s+me\s+the\s+code|provide\s+code)\b"

_TECHNICAL = ("implementation", "workspace_comparison")
# The words added to a question, by the modes in which an expression adds them.
ALIASES = (
    (_TECHNICAL, AUTH, ("auth", "authentication", "authorization", "login", "logout", "register", "signup", "signin", "refresh token", "access token", "session", "jwt", "protected route", "guard", "middleware", "current_user")),
    (_TECHNICAL, DASHBOARD, ("dashboard", "load dashboard", "dashboard page", "query", "fetch", "useQuery", "useProjects", "projectsApi", "list projects", "api route")),
    (_TECHNICAL, PROJECT_FLOW, ("project", "projects", "create_project", "get_project", "list projects", "projectsApi", "owner_id", "current_user")),
    (_TECHNICAL, DATA_MODEL, ("data model", "models", "Project", "Task", "User", "owner_id", "status")),
    (_TECHNICAL, FRONTEND, ("frontend", "React", "App.tsx", "DashboardPage", "LoginPage", "ProtectedRoute", "useProjects", "PageShell", "api.ts")),
    (_TECHNICAL, TEST, ("tests", "test_e2e_flow.py", "register", "login", "project", "audit", "regression")),
    (_TECHNICAL, ENGINE, ("engine", "engines", "intake engine", "document engine", "task intelligence engine", "verification engine", "audit engine", "scaffold/engines/intake", "scaffold/engines/documents", "scaffold/engines/tasks",
                          "scaffold/engines/verification", "scaffold/engines/audit", "run_intake", "generate_document", "recommend_assignments", "process_commit", "evaluate_all_controls")),
    (_TECHNICAL, SNIPPET, ("code snippet", "implementation file", "function", "route", "module")),
    (("recruiter_summary",), "python", ("python", "backend", "fastapi", "api", "service")),
    (("recruiter_summary",), FRONTEND, ("frontend", "React", "App.tsx", "DashboardPage", "useProjects", "authApi", "guides/7_frontend.md")),
    (("project_status",), "", ("remaining", "todo", "pending", "next step", "progress")),
    (("project_status",), r"\bweek\s+(\d+)\b", ("week{}", "planning", "milestone", "planning/week{}.md")),
    (("project_status",), AUTH, ("auth", "authentication", "authorization", "logout", "login")),
    (("project_status",), DASHBOARD, ("dashboard", "table", "load dashboard")),
)
# By mode, the layers searched, those that bound a denial, and the candidates of lexical, file, symbol and graph search.
MODES = {
    "implementation": ("vector lexical path symbol file graph", "symbol file lexical path", 8, 6, 8, 5),
    "workspace_comparison": ("vector lexical path file symbol graph", "symbol file lexical path", 7, 5, 6, 4),
    "recruiter_summary": ("vector lexical file symbol", "symbol file lexical", 7, 5, 7, 2),
    "project_status": ("vector lexical file graph", "file lexical graph", 6, 5, 3, 5),
    "general": ("vector lexical path", "path lexical", 6, 4, 6, 4),
}

_ASKED = """CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN concat('Compare login pages ', substr(text, 1, 60)) WHEN 1 THEN concat('experience with python and react? ', substr(text, 1, 60)) WHEN 2 THEN concat('what is left in week 3 for auth ', text)
  WHEN 3 THEN concat('dashboard loading ', substr(text, 1, 60)) WHEN 4 THEN concat('where is the data model test ', substr(text, 1, 60)) WHEN 5 THEN concat('audit engine code snippet ', substr(text, 1, 60)) WHEN 6 THEN concat('list your projects ', text) WHEN 7 THEN 'how many twins' ELSE text END"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.expr(_ASKED)).alias("q"), (F.col("conv_id") % 2 == 0).alias("workspace"))


def mode(q: Column, workspace: Column) -> Column:
    """The first mode whose rule a question meets."""
    low = F.lower(q)
    loads = low.contains("dashboard") & low.rlike("load|query|fetch")
    return (
        F.when(workspace & low.rlike(ascii_rules(COMPARE)), "workspace_comparison").when(low.rlike(ascii_rules(RECRUITER)), "recruiter_summary").when(low.rlike(ascii_rules(STATUS)), "project_status")
        .when(loads | low.rlike(ascii_rules(ENGINE)) | low.rlike(ascii_rules(IMPLEMENTATION)), "implementation").otherwise("general")
    )


def search_query(q: Column, mode_: Column) -> Column:
    """The question followed by the words that its mode and wording add, each once."""
    low = F.lower(q)
    week = F.regexp_extract(low, ascii_rules(r"\bweek\s+(\d+)\b"), 1)
    word = lambda a: F.concat(F.lit(a.partition("{}")[0]), week, F.lit(a.partition("{}")[2])) if "{}" in a else F.lit(a)
    none = F.array().cast("array<string>")
    added = [F.when(mode_.isin(*modes) & low.rlike(ascii_rules(pattern)), F.array(*map(word, aliases))).otherwise(none) for modes, pattern, aliases in ALIASES]
    every = F.array_distinct(F.concat(*added))
    return F.when(F.size(every) > 0, F.concat(q, F.lit(" "), F.array_join(every, " "))).otherwise(q)


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_MODE_SQL = f"""a AS (SELECT conv_id, turn, trim({_ASKED}) AS q, conv_id % 2 = 0 AS workspace FROM conversations),
m AS (SELECT *, lower(q) AS low, CASE WHEN workspace AND regexp_matches(lower(q), {_quoted(COMPARE)}) THEN 'workspace_comparison' WHEN regexp_matches(lower(q), {_quoted(RECRUITER)}) THEN 'recruiter_summary' WHEN regexp_matches(lower(q), {_quoted(STATUS)}) THEN 'project_status'
  WHEN (contains(lower(q), 'dashboard') AND regexp_matches(lower(q), 'load|query|fetch')) OR regexp_matches(lower(q), {_quoted(ENGINE)}) OR regexp_matches(lower(q), {_quoted(IMPLEMENTATION)}) THEN 'implementation' ELSE 'general' END AS mode FROM a)"""


def _alias_sql(alias: str) -> str:
    before, slot, after = alias.partition("{}")
    return f"concat('{before}', regexp_extract(low, '\\bweek\\s+(\\d+)\\b', 1), '{after}')" if slot else _quoted(alias)


_ADDED = " || ".join(f"CASE WHEN mode IN ({', '.join(map(_quoted, modes))}) AND regexp_matches(low, {_quoted(pattern)}) THEN [{', '.join(map(_alias_sql, aliases))}] ELSE []::VARCHAR[] END" for modes, pattern, aliases in ALIASES)
_SEARCH_SQL = _MODE_SQL + f""", w AS (SELECT *, {_ADDED} AS every FROM m), d AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS added FROM w),
s AS (SELECT *, CASE WHEN len(added) > 0 THEN concat(q, ' ', array_to_string(added, ' ')) ELSE q END AS search FROM d)"""


@query("i07_question_modes", "WITH " + _MODE_SQL + " SELECT conv_id, turn, mode FROM m")
def question_modes(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", mode(F.col("q"), F.col("workspace")).alias("mode"))


@query("i08_search_queries", "WITH " + _SEARCH_SQL + " SELECT conv_id, turn, search AS search_query, CASE WHEN length(search) <= 280 THEN search ELSE q END AS lexical_query FROM s")
def search_queries(spark, sf_dir):
    """What dense and lexical search ask for: the longer form serves both unless it exceeds 280 characters."""
    rows = _asked(spark, sf_dir).withColumn("mode", mode(F.col("q"), F.col("workspace")))
    found = rows.select("conv_id", "turn", "q", search_query(F.col("q"), F.col("mode")).alias("search_query"))
    return found.select("conv_id", "turn", "search_query", F.when(F.length("search_query") <= 280, F.col("search_query")).otherwise(F.col("q")).alias("lexical_query"))


_MODE_ROWS = ", ".join(f"('{name}', '{layers}', '{bounds}', {', '.join(map(str, rest))})" for name, (layers, bounds, *rest) in MODES.items())


@query(
    "j01_search_plans",
    "WITH " + _MODE_SQL + f""", b AS (SELECT * FROM (VALUES {_MODE_ROWS}) AS b(mode, layers, bounds, lexical, files, symbols, graph)), k AS (SELECT *, CASE WHEN regexp_matches(q, {_quoted(SPECIFIC)}) THEN 12 ELSE 8 END AS top_k FROM m)
    SELECT conv_id, turn, mode, layers, bounds, greatest(top_k, 8)::INT AS dense, lexical::INT AS lexical, files::INT AS files, symbols::INT AS symbols, graph::INT AS graph, (CASE WHEN mode = 'implementation' THEN greatest(top_k * 3, 16) ELSE greatest(top_k * 2, 12) END)::INT AS reranked FROM k JOIN b USING (mode)""",
)
def search_plans(spark, sf_dir):
    """Layers and budgets of each question, by its mode."""
    rows = _asked(spark, sf_dir).select("conv_id", "turn", mode(F.col("q"), F.col("workspace")).alias("mode"), F.when(F.col("q").rlike(ascii_rules(SPECIFIC)), 12).otherwise(8).alias("top_k"))
    budgets = spark.createDataFrame([(name, *row) for name, row in MODES.items()], "mode string, layers string, bounds string, lexical int, files int, symbols int, graph int")
    reranked = F.when(F.col("mode") == "implementation", F.greatest(F.col("top_k") * 3, F.lit(16))).otherwise(F.greatest(F.col("top_k") * 2, F.lit(12)))
    return rows.join(F.broadcast(budgets), "mode").select("conv_id", "turn", "mode", "layers", "bounds", F.greatest("top_k", F.lit(8)).alias("dense"), "lexical", "files", "symbols", "graph", reranked.alias("reranked"))  # a row for each mode


# Expressions of questions about sources, coverage, and several projects.
SOURCES = r"(?i)\b(what do you have|what sources?|which sources?|attached sources?|what do you know|what knowledge|do you have (?:any |some )?(?:sources?|documents?|files?|knowledge|data|context|twins?|info(?:rmation)?))\b"
COVERAGE = r"(?i)\b(how many twins|how many projects|which twins|what twins|(?:which|what) projects (?:do you (?:have|cover|serve|support)|can you (?:help|cover|answer)|are (?:available|in this workspace))|what can you help with|what can you cover|what do you cover|what are you serving|what projects can you help with)\b"
SEVERAL = r"\b(your|all|any|each|every|what|which|how many)\s+projects\b|\bprojects\s+you(\s+have|\s+'ve|'ve)?\b|\blist\s+(your\s+)?projects\b"


@query("i22_scope_flags", "WITH " + _MODE_SQL + f" SELECT conv_id, turn, regexp_matches(q, {_quoted(SOURCES)}) AS is_source, regexp_matches(q, {_quoted(COVERAGE)}) AS is_coverage FROM m")
def scope_flags(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", F.col("q").rlike(ascii_rules(SOURCES)).alias("is_source"), F.col("q").rlike(ascii_rules(COVERAGE)).alias("is_coverage"))


@query("i23_prefers_aggregate", "WITH " + _MODE_SQL + f" SELECT conv_id, turn, regexp_matches(low, {_quoted(SEVERAL)}) AS several FROM m")
def prefers_aggregate(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", F.lower("q").rlike(ascii_rules(SEVERAL)).alias("several"))
