"""Verification of answers against the evidence they may cite, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The expressions and word lists that decide what counts as a reference or a claim.
PLAIN_FILE = r"\b(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+\b|\b[A-Za-z0-9_.-]+\.(?:py|ts|tsx|js|jsx|json|yaml|yml|sql|md|toml|go|java|rb|php|rs)\b"
BACKTICK = r"`([^`\n]{1,160})`"
FENCED = r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```"
BOUNDED = r"(?i)\b(did not find grounded evidence|could not find grounded evidence|couldn't verify|can't verify)\b"
NEGATIVE = r"(?i)\b(there is no|there are no|does not use|doesn't use|not present|is absent|without any?|without an?)\b"
PLACEHOLDER = r"(?i)(\.\.\.|omitted|additional\s+(?:logic|checks)|logic\s+to|form rendering|to be implemented)"
COMMON_TERMS = ("api", "fastapi", "http", "https", "json", "jwt", "jwterror", "oauth", "oauth2", "oauth2passwordbearer", "orm", "rbac", "sql", "sso")
ANCHORED_MODES = ("implementation", "architecture", "onboarding", "project_status", "recruiter_summary")
DENIALS = (
    (("route", "route_config"), ("no routes", "no route ", "no http routes", "without routes", "without any routes")),
    (("handler",), ("no handler", "no handlers")),
    (("auth_check",), ("no auth check", "no authentication check", "no authentication middleware")),
    (("api_call", "call"), ("no api call", "no api calls", "no outbound api")),
    (("background_job",), ("no background job", "no background jobs", "no worker", "no queue")),
    (("dependency", "injection_site", "service_edge"), ("no dependency injection", "no di container", "no service locator")),
    (("data_model", "model_edge"), ("no data model", "no persistence layer")),
    (("ui_action",), ("no ui action", "no client handler")),
)


def looks_like_file(token: Column) -> Column:
    whole = token.rlike(f"^(?:{PLAIN_FILE})$")
    return (token != "") & ~token.contains("@") & (~token.contains(":") | whole) & (token.contains("/") | whole)


def looks_like_symbol(token: Column) -> Column:
    return (token != "") & ~looks_like_file(token) & token.rlike(r"[_.(@:]|^.[^A-Z]*[A-Z]")


def _backticked(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(BACKTICK), 1), lambda x: F.trim(x))


def file_refs(answer: Column) -> Column:
    """The files that an answer names, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(answer, F.lit(PLAIN_FILE), 0), F.filter(_backticked(answer), looks_like_file))))


def symbol_refs(answer: Column) -> Column:
    """The symbols that an answer names in backticks, sorted."""
    return F.array_sort(F.array_distinct(F.filter(_backticked(answer), looks_like_symbol)))


def with_leaves(files: Column) -> Column:
    """File paths and their last parts."""
    return F.array_distinct(F.concat(files, F.transform(files, lambda x: F.element_at(F.split(x, "/"), -1))))


def unsupported_files(answer: Column, files: Column) -> Column:
    return F.array_except(file_refs(answer), with_leaves(files))


def unsupported_symbols(answer: Column, files: Column, symbols: Column, evidence: Column) -> Column:
    """Symbols that are neither allowed, nor common terms, nor in the evidence, even with other white space."""
    blob = F.lower(evidence)
    compact = F.regexp_replace(blob, r"\s+", "")
    known = lambda x: blob.contains(F.lower(x)) | compact.contains(F.regexp_replace(F.lower(x), r"\s+", ""))
    return F.filter(F.array_except(symbol_refs(answer), F.concat(symbols, with_leaves(files))), lambda x: ~F.lower(x).isin(*COMMON_TERMS) & ~known(x))


def has_anchor(answer: Column, files: Column, symbols: Column) -> Column:
    low = F.lower(answer)
    return F.exists(F.concat(with_leaves(files), symbols), lambda x: (x != "") & low.contains(F.lower(x)))


def claims_absence(answer: Column) -> Column:
    """Whether an answer denies something without saying how far was searched."""
    return answer.rlike(NEGATIVE) & ~answer.rlike(BOUNDED)


def with_bounds(answer: Column, layers: Column) -> Column:
    """The answer, with the bounds of its denials added where it has unbounded ones."""
    scope = F.when(F.size(layers) > 0, F.array_join(layers, ", ")).otherwise("(unbounded)")
    note = F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\n## Bounds\nAny absence claims above are bounded to the searched layers for this turn: "), scope, F.lit("."))
    return F.when(claims_absence(answer), note).otherwise(answer)


def drop_lines(answer: Column, terms: Column) -> Column:
    """The answer without lines that hold one of the terms, in any case."""
    kept = F.filter(F.split(answer, "\n"), lambda line: ~F.exists(terms, lambda t: (t != "") & F.lower(line).contains(F.lower(t))))
    return F.when(F.size(terms) == 0, answer).otherwise(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""), "\n{3,}", "\n\n"))


def denies_present(line: Column, facts: Column) -> Column:
    """Whether a line denies a kind of fact that the evidence has."""
    low = F.lower(line)
    found = F.lit(False)
    for kinds, phrases in DENIALS:
        has = F.arrays_overlap(facts, F.array(*map(F.lit, kinds)))
        found = found | (has & F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p)))
    return found


def code_line(line: Column) -> Column:
    """A line of code with single blanks; empty for comments and fillers."""
    bare = F.trim(line)
    plain = F.regexp_replace(bare, r"\s+", " ")
    return F.when(bare.isin("", "```", "pass") | bare.rlike(r"^(#|//|/\*|\*)"), "").otherwise(plain)


def _code_lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), code_line), lambda x: x != "")


def is_grounded_block(block: Column, snippets: Column) -> Column:
    """Whether at least two of a block's lines, or its only one, stand in retrieved snippets, and none of them is an invented placeholder."""
    blobs = F.transform(snippets, lambda s: F.array_join(_code_lines(s), "\n"))
    stands = lambda x: F.exists(blobs, lambda b: b.contains(x))
    stands_low = lambda x: F.exists(blobs, lambda b: F.lower(b).contains(x))
    lines = _code_lines(block)
    hollow = F.exists(F.filter(F.split(block, "\n"), lambda x: x.rlike(PLACEHOLDER)), lambda x: (code_line(x) == "") | ~stands_low(F.lower(code_line(x))))
    enough = F.size(F.filter(lines, stands)) >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(lines)))
    return (F.size(snippets) > 0) & ~hollow & ((F.size(lines) == 0) | enough)


def unsupported_code(answer: Column, snippets: Column) -> Column:
    return F.exists(F.regexp_extract_all(answer, F.lit(FENCED), 1), lambda b: ~is_grounded_block(b, snippets))


def _tidy(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, r"^\s+|\s+$", ""), "\n{3,}", "\n\n")


def drop_code(answer: Column, snippets: Column) -> Column:
    """The answer without fenced blocks that stand in no snippet."""
    parts = F.split(F.regexp_replace(answer, FENCED, "\u0001$0\u0001"), "\u0001")  # every other part is a block
    kept = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & ~is_grounded_block(F.regexp_extract(p, FENCED, 1), snippets), "").otherwise(p))
    return _tidy(F.array_join(kept, ""))


def is_denial(line: Column, facts: Column) -> Column:
    """Whether a line denies, bounded or not, a kind of fact that the evidence has."""
    return (line.rlike(NEGATIVE) | line.rlike(BOUNDED)) & denies_present(line, facts)


def drop_denials(answer: Column, facts: Column) -> Column:
    return _tidy(F.array_join(F.filter(F.split(answer, "\n"), lambda line: ~is_denial(line, facts)), "\n"))


def with_bounds_and_gaps(answer: Column, layers: Column, gaps: Column) -> Column:
    """:func:`with_bounds`, followed by what retrieval says it lacks, six items at most."""
    # fixed values: the headings and the closing remark
    told = F.slice(F.filter(F.transform(gaps, lambda g: F.trim(g)), lambda g: g != ""), 1, 6)
    lines = F.array_join(F.transform(told, lambda g: F.concat(F.lit("- "), g)), "\n")
    more = F.concat(F.lit("\n\n## Grounded gaps (from retrieval)\n"), lines, F.lit("\n\nTreat these as unknown within the current packet—not as proof something does not exist globally."))
    return F.when(claims_absence(answer), F.concat(with_bounds(answer, layers), F.when(F.size(told) > 0, more).otherwise(""))).otherwise(answer)


def rewritten(answer: Column, issues: Column, bad_refs: Column, snippets: Column, facts: Column) -> Column:
    """What is left of an answer with issues: no line that cites what the evidence lacks, no invented code, no denial of what is there."""
    clean = drop_code(drop_lines(answer, bad_refs), snippets)
    return F.when(F.size(issues) == 0, answer).when(F.array_contains(issues, "contradicted_absence_claim"), drop_denials(clean, facts)).otherwise(clean)


def leaks(body: Column, others: Column) -> Column:
    """Whether a project's section names another project, as a whole word in any case."""
    quoted = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.exists(others, lambda x: F.rlike(body, F.concat(F.lit(r"(?i)\b"), quoted(x), F.lit(r"\b"))))


def sections(answer: Column) -> Column:
    """A map from the names of an answer's second-level headings to the text below; of repeated names the last counts."""
    marked = F.regexp_replace(answer, r"(?m)^##[ \t]+(\S.*?)[ \t]*$", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.contains("\u0002"))
    entries = F.transform(parts, lambda p: F.struct(F.element_at(F.split(p, "\u0002"), 1).alias("name"), F.regexp_replace(F.element_at(F.split(p, "\u0002"), 2), r"^\s+|\s+$", "").alias("body")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]))
    return F.map_from_entries(last)
