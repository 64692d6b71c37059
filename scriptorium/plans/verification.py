"""Verification of answers, their metrics, and the golden evaluation, over the assistants' turns of the conversations.

Each answer gets a tail by its number that cites files and symbols, denies things or shows code, and a packet of
evidence by its conversation: a mode, files, symbols, facts, searched layers and a snippet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import verification as vf
from scriptorium.plans.registry import query
from scriptorium.plans.views import table

_TAIL = r"""CASE (conv_id + turn) % 6
  WHEN 0 THEN concat(chr(10), 'See `docs/a1.md` and `fooBar` in src/b.py.') WHEN 1 THEN concat(chr(10), 'There is no cache, but `Auth.login` helps.', chr(10), 'No queue: there are no routes here.')
  WHEN 2 THEN concat(chr(10), 'I did not find grounded evidence of `x_y`; there is no `JWT` in notes.md') WHEN 3 THEN concat(chr(10), '```py', chr(10), 'run( 1 )', chr(10), '# note', chr(10), 'stop()', chr(10), '```')
  WHEN 4 THEN concat(chr(10), '```', chr(10), 'run( 1 )', chr(10), 'omitted', chr(10), '```', chr(10), 'guide.toml and `GET:/x`') ELSE '' END"""
_PACKET = f"""SELECT conv_id, turn, concat(text, {_TAIL}) AS answer, CASE conv_id % 3 WHEN 0 THEN 'implementation' WHEN 1 THEN 'general' ELSE 'project_status' END AS mode,
  CASE WHEN conv_id % 2 = 0 THEN {{files}} ELSE {{other}} END AS files, {{symbols}} AS symbols, {{facts}} AS facts, CASE WHEN conv_id % 4 < 3 THEN {{layers}} ELSE {{no_layers}} END AS layers,
  concat('def helper():', chr(10), '  run( 1 )', chr(10), '  stop()', chr(10), 'uses x_y') AS snippet FROM conversations WHERE role = 'assistant'"""


def _packet(spread: str) -> str:
    listed = lambda *xs: spread.format(", ".join(f"'{x}'" for x in xs))
    return _PACKET.format(files=listed("docs/a1.md", "src/b.py"), other=listed("lib/c.ts"), symbols=listed("Auth.login", "login"), facts=listed("route", "background_job"), layers=listed("path", "lexical"), no_layers=listed("file"))


def _answers(spark, sf_dir):
    return spark.sql(_packet("array({})").replace("FROM conversations", "FROM {turns}").replace("chr(10)", "char(10)"), turns=table(spark, sf_dir, "conversations"))


_q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_IS_FILE = f"(x <> '' AND NOT contains(x, '@') AND (NOT contains(x, ':') OR regexp_full_match(x, {_q(vf.PLAIN_FILE)})) AND (contains(x, '/') OR regexp_full_match(x, {_q(vf.PLAIN_FILE)})))"
_DENIES = " OR ".join(f"(list_has_any(facts, {list(kinds)}) AND len(list_filter({list(phrases)}, lambda p: contains(lower(l), p))) > 0)" for kinds, phrases in vf.DENIALS)
_CODE_LINE = "CASE WHEN trim(l) IN ('', '```', 'pass') OR regexp_matches(trim(l), '^(#|//|/\\*|\\*)') THEN '' ELSE regexp_replace(trim(l), '\\s+', ' ', 'g') END"
_CODE = f"list_filter(list_transform(string_split({{}}, chr(10)), lambda l: {_CODE_LINE}), lambda l: l <> '')"
_BLOB = f"array_to_string({_CODE.format('snippet')}, chr(10))"
_GROUNDED = f"""(len(list_filter(string_split({{0}}, chr(10)), lambda l: regexp_matches(l, {_q(vf.PLACEHOLDER)}) AND ({_CODE_LINE} = '' OR NOT contains(lower({_BLOB}), lower({_CODE_LINE}))))) = 0
  AND (len({_CODE.format('{0}')}) = 0 OR len(list_filter({_CODE.format('{0}')}, lambda l: contains({_BLOB}, l))) >= greatest(1, least(2, len({_CODE.format('{0}')})))))"""
_SQL = f"""WITH p AS ({_packet("[{}]")}),
r AS (SELECT *, list_transform(regexp_extract_all(answer, {_q(vf.BACKTICK)}, 1), lambda x: trim(x)) AS ticks, list_distinct(files || list_transform(files, lambda x: string_split(x, '/')[-1])) AS allowed FROM p),
s AS (SELECT *, list_sort(list_distinct(regexp_extract_all(answer, {_q(vf.PLAIN_FILE)}) || list_filter(ticks, lambda x: {_IS_FILE}))) AS file_refs,
  list_sort(list_distinct(list_filter(ticks, lambda x: x <> '' AND NOT {_IS_FILE} AND regexp_matches(x, '[_.(@:]|^.[^A-Z]*[A-Z]')))) AS symbol_refs FROM r),
t AS (SELECT *, list_filter(file_refs, lambda x: NOT list_contains(allowed, x)) AS bad_files,
  list_filter(symbol_refs, lambda x: NOT list_contains(symbols, x) AND NOT list_contains(allowed, x) AND lower(x) NOT IN {vf.COMMON_TERMS} AND NOT contains(lower(snippet), lower(x)) AND NOT contains(regexp_replace(lower(snippet), '\\s+', '', 'g'), regexp_replace(lower(x), '\\s+', '', 'g'))) AS bad_symbols,
  len(list_filter(allowed || symbols, lambda x: contains(lower(answer), lower(x)))) > 0 AS anchored,
  regexp_matches(answer, {_q(vf.NEGATIVE)}) AND NOT regexp_matches(answer, {_q(vf.BOUNDED)}) AS unbounded,
  len(list_filter(string_split(answer, chr(10)), lambda l: (regexp_matches(l, {_q(vf.NEGATIVE)}) OR regexp_matches(l, {_q(vf.BOUNDED)})) AND ({_DENIES}))) > 0 AS contradicted,
  len(list_filter(regexp_extract_all(answer, {_q(vf.FENCED)}, 1), lambda b: NOT {_GROUNDED.format("b")})) > 0 AS bad_code FROM s)"""


@query("i25_references", _SQL + " SELECT conv_id, turn, array_to_string(file_refs, ',') AS files, array_to_string(symbol_refs, ',') AS symbols FROM t")
def references(spark, sf_dir):
    answer = F.col("answer")
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(vf.file_refs(answer), ",").alias("files"), F.array_join(vf.symbol_refs(answer), ",").alias("symbols"))


@query("j16_grounded_code", _SQL + " SELECT conv_id, turn, bad_code AS unsupported_code FROM t WHERE contains(answer, '```')")
def grounded_code(spark, sf_dir):
    """Of answers with fenced code: whether a block of it stands in no snippet."""
    return _answers(spark, sf_dir).where("contains(answer, '```')").select("conv_id", "turn", vf.unsupported_code(F.col("answer"), F.array("snippet")).alias("unsupported_code"))


@query("g06_denied_facts", _SQL + " SELECT conv_id, turn FROM t WHERE contradicted")
def denied_facts(spark, sf_dir):
    """Answers with a line that denies a kind of fact that the packet holds."""
    denies = F.exists(F.split("answer", "\n"), lambda line: (line.rlike(vf.NEGATIVE) | line.rlike(vf.BOUNDED)) & vf.denies_present(line, F.col("facts")))
    return _answers(spark, sf_dir).where(denies).select("conv_id", "turn")


@query(
    "j13_verified_answer",
    _SQL + """, v AS (SELECT *, list_filter([CASE WHEN len(bad_files) > 0 THEN 'unsupported_file_reference' END, CASE WHEN len(bad_symbols) > 0 THEN 'unsupported_symbol_reference' END, CASE WHEN bad_code THEN 'unsupported_code_block' END,
      CASE WHEN contradicted THEN 'contradicted_absence_claim' END, CASE WHEN mode <> 'general' AND NOT anchored THEN 'missing_grounded_anchor' END], lambda x: x IS NOT NULL) AS issues, bad_files || bad_symbols AS bad FROM t),
    d AS (SELECT *, CASE WHEN len(bad) = 0 THEN answer ELSE regexp_replace(regexp_replace(array_to_string(list_filter(string_split(answer, chr(10)), lambda l: len(list_filter(bad, lambda b: contains(lower(l), lower(b)))) = 0), chr(10)), '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') END AS kept FROM v)
    SELECT conv_id, turn, array_to_string(issues, ',') AS issues, len(issues) = 0 AS verified, sha256(kept) AS kept_sha256,
      len(issues) > 0 AND len(list_filter(allowed || symbols, lambda x: contains(lower(kept), lower(x)))) = 0 AS falls_back FROM d""",
)
def verified_answer(spark, sf_dir):
    """The issues of each answer, what is left of it without lines that cite what the packet lacks, and whether that leaves no anchor."""
    answer, files, symbols = F.col("answer"), F.col("files"), F.col("symbols")
    rows = _answers(spark, sf_dir).withColumn("bad_files", vf.unsupported_files(answer, files)).withColumn("bad_symbols", vf.unsupported_symbols(answer, files, symbols, F.col("snippet")))
    denies = F.exists(F.split("answer", "\n"), lambda line: (line.rlike(vf.NEGATIVE) | line.rlike(vf.BOUNDED)) & vf.denies_present(line, F.col("facts")))
    flags = {
        "unsupported_file_reference": F.size("bad_files") > 0,
        "unsupported_symbol_reference": F.size("bad_symbols") > 0,
        "unsupported_code_block": vf.unsupported_code(answer, F.array("snippet")),
        "contradicted_absence_claim": denies,
        "missing_grounded_anchor": F.col("mode").isin(*vf.ANCHORED_MODES) & ~vf.has_anchor(answer, files, symbols),
    }
    issues = F.array_compact(F.array(*[F.when(found, name) for name, found in flags.items()]))
    rows = rows.withColumn("issues", issues).withColumn("kept", vf.drop_lines(answer, F.concat("bad_files", "bad_symbols")))
    falls = (F.size("issues") > 0) & ~vf.has_anchor(F.col("kept"), files, symbols)
    return rows.select("conv_id", "turn", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("verified"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), falls.alias("falls_back"))


_TIDY = "regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_GAPS = "CASE WHEN conv_id % 5 < 2 THEN {} ELSE {} END"


@query(
    "j13_rewritten_answer",
    _SQL + f""", v AS (SELECT *, bad_files || bad_symbols AS bad, len(bad_files) > 0 OR len(bad_symbols) > 0 OR bad_code OR contradicted OR (mode <> 'general' AND NOT anchored) AS faulty FROM t),
    d AS (SELECT *, CASE WHEN len(bad) = 0 THEN answer ELSE {_TIDY.format("array_to_string(list_filter(string_split(answer, chr(10)), lambda l: len(list_filter(bad, lambda b: contains(lower(l), lower(b)))) = 0), chr(10))")} END AS no_refs FROM v),
    b AS (SELECT *, string_split(regexp_replace(no_refs, {_q(vf.FENCED)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d),
    c AS (SELECT *, {_TIDY.format(f"array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 AND NOT {_GROUNDED.format('regexp_extract(x, ' + _q(vf.FENCED) + ', 1)')} THEN '' ELSE x END), '')")} AS no_code FROM b),
    e AS (SELECT *, CASE WHEN NOT faulty THEN answer WHEN contradicted THEN {_TIDY.format(f"array_to_string(list_filter(string_split(no_code, chr(10)), lambda l: NOT ((regexp_matches(l, {_q(vf.NEGATIVE)}) OR regexp_matches(l, {_q(vf.BOUNDED)})) AND ({_DENIES}))), chr(10))")} ELSE no_code END AS kept,
      list_filter(list_transform({_GAPS.format("['lexical', '  ', ' no_embedding_profiles']", "[]::VARCHAR[]")}, lambda g: trim(g)), lambda g: g <> '') AS gaps FROM c),
    o AS (SELECT *, CASE WHEN regexp_matches(kept, {_q(vf.NEGATIVE)}) AND NOT regexp_matches(kept, {_q(vf.BOUNDED)}) THEN concat(regexp_replace(kept, '\\s+$', ''), chr(10), chr(10), '## Bounds', chr(10), 'Any absence claims above are bounded to the searched layers for this turn: ', array_to_string(layers, ', '), '.',
      CASE WHEN len(gaps) > 0 THEN concat(chr(10), chr(10), '## Grounded gaps (from retrieval)', chr(10), array_to_string(list_transform(gaps, lambda g: concat('- ', g)), chr(10)), chr(10), chr(10), 'Treat these as unknown within the current packet—not as proof something does not exist globally.') ELSE '' END) ELSE kept END AS final FROM e)
    SELECT conv_id, turn, final <> answer AS rewritten, length(final) AS chars, sha256(final) AS answer_sha256 FROM o""",
)
def rewritten_answer(spark, sf_dir):
    """Each answer as it may stand: without what its packet doesn't support, its denials bounded, with the packet's gaps."""
    answer, files, symbols, facts = F.col("answer"), F.col("files"), F.col("symbols"), F.col("facts")
    rows = _answers(spark, sf_dir).withColumn("bad_files", vf.unsupported_files(answer, files)).withColumn("bad_symbols", vf.unsupported_symbols(answer, files, symbols, F.col("snippet")))
    flags = {
        "unsupported_file_reference": F.size("bad_files") > 0,
        "unsupported_symbol_reference": F.size("bad_symbols") > 0,
        "unsupported_code_block": vf.unsupported_code(answer, F.array("snippet")),
        "contradicted_absence_claim": F.exists(F.split(answer, "\n"), lambda line: vf.is_denial(line, facts)),
        "missing_grounded_anchor": F.col("mode").isin(*vf.ANCHORED_MODES) & ~vf.has_anchor(answer, files, symbols),
    }
    rows = rows.withColumn("issues", F.array_compact(F.array(*[F.when(found, name) for name, found in flags.items()])))
    kept = rows.withColumn("kept", vf.rewritten(answer, F.col("issues"), F.concat("bad_files", "bad_symbols"), F.array("snippet"), facts))
    gaps = F.expr(_GAPS.format("array('lexical', '  ', ' no_embedding_profiles')", "cast(array() as array<string>)"))
    final = kept.withColumn("final", vf.with_bounds_and_gaps(F.col("kept"), F.col("layers"), gaps))
    return final.select("conv_id", "turn", (F.col("final") != answer).alias("rewritten"), F.length("final").cast("long").alias("chars"), F.sha2("final", 256).alias("answer_sha256"))


@query(
    "j18_bounded_negatives",
    _SQL + r""" SELECT conv_id, turn, unbounded AS needs_bounds, sha256(CASE WHEN unbounded THEN concat(regexp_replace(answer, '\s+$', ''), chr(10), chr(10), '## Bounds', chr(10), 'Any absence claims above are bounded to the searched layers for this turn: ', array_to_string(layers, ', '), '.') ELSE answer END) AS answer_sha256 FROM t""",
)
def bounded_negatives(spark, sf_dir):
    answer = F.col("answer")
    return _answers(spark, sf_dir).select("conv_id", "turn", vf.claims_absence(answer).alias("needs_bounds"), F.sha2(vf.with_bounds(answer, F.col("layers")).cast("binary"), 256).alias("answer_sha256"))


_METRICS = """ SELECT conv_id, turn, mode, len(layers)::INT AS searched_layers, (len(list_filter(file_refs, lambda x: list_contains(allowed, x))) + len(list_filter(symbol_refs, lambda x: list_contains(symbols, x) OR list_contains(allowed, x))))::INT AS citations,
  anchored AS anchor_present, unbounded AS false_not_present_risk FROM t"""


def _metrics(spark, sf_dir):
    answer, files, symbols = F.col("answer"), F.col("files"), F.col("symbols")
    cited = F.size(F.array_intersect(vf.file_refs(answer), vf.with_leaves(files))) + F.size(F.array_intersect(vf.symbol_refs(answer), F.concat(symbols, vf.with_leaves(files))))
    return _answers(spark, sf_dir).select("conv_id", "turn", "mode", F.size("layers").alias("searched_layers"), cited.alias("citations"), vf.has_anchor(answer, files, symbols).alias("anchor_present"), vf.claims_absence(answer).alias("false_not_present_risk"))


@query("j20_quality_metrics", _SQL + _METRICS)
def quality_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("j21_golden_evaluation", _SQL + " SELECT mode, count(*) AS cases, count_if(NOT unbounded) AS passed, count_if(unbounded) AS unbounded_negative FROM t GROUP BY mode")
def golden_evaluation(spark, sf_dir):
    """By mode: a case fails only where a denial is unbounded."""
    failed = F.col("false_not_present_risk")
    return _metrics(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("cases"), F.count_if(~failed).alias("passed"), F.count_if(failed).alias("unbounded_negative"))


_NAMES = "concat('alpha', conv_id % 3)"
_SECTIONED = f"concat('intro', chr(10), '## ', {_NAMES}, '  ', chr(10), text, chr(10), CASE WHEN turn % 3 = 0 THEN concat('like Beta there, see lib/z.py', chr(10)) ELSE '' END, '### sub', chr(10), '## beta', chr(10), 'in docs/a1.md', CASE WHEN turn % 4 = 1 THEN concat(chr(10), '## ', {_NAMES}, chr(10), 'again `src/b.py`') ELSE '' END)"


def _sectioned(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.expr(_NAMES.replace("chr(10)", "char(10)")).alias("own"), F.expr(_SECTIONED.replace("chr(10)", "char(10)")).alias("answer"))


_SECTIONS = rf"""WITH a AS (SELECT conv_id, turn, {_NAMES} AS own, {_SECTIONED} AS answer FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, own, list_filter(string_split(regexp_replace(answer, '(?m)^##[ \t]+(\S.*?)[ \t]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2))) AS ps FROM a),
u AS (SELECT conv_id, turn, own, unnest(ps) AS p, generate_subscripts(ps, 1) AS no FROM m),
s AS (SELECT conv_id, turn, own, string_split(p, chr(2))[1] AS name, regexp_replace(string_split(p, chr(2))[2], '^\s+|\s+$', '', 'g') AS body FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, turn, name ORDER BY no DESC) = 1)"""


@query("j15_answer_sections", _SECTIONS + " SELECT conv_id, turn, name, sha256(body) AS body_sha256 FROM s")
def answer_sections(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select("conv_id", "turn", F.explode(vf.sections(F.col("answer"))).alias("name", "body"))
    return rows.select("conv_id", "turn", "name", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


@query(
    "j14_workspace_answer",
    _SECTIONS + rf""", f AS (SELECT conv_id, turn, name, CASE WHEN regexp_matches(body, '(?i)\b' || CASE WHEN name = 'beta' THEN own ELSE 'beta' END || '\b') THEN 'cross_project_leakage:' || name END AS leak,
      CASE WHEN len(list_filter(regexp_extract_all(body, {_q(vf.PLAIN_FILE)}), lambda x: x NOT IN ('docs/a1.md', 'a1.md', 'src/b.py', 'b.py'))) > 0 THEN 'unsupported_file_reference:' || name END AS ref FROM s),
    i AS (SELECT conv_id, turn, leak AS issue FROM f WHERE leak IS NOT NULL UNION ALL SELECT conv_id, turn, ref FROM f WHERE ref IS NOT NULL UNION ALL SELECT conv_id, turn, 'missing_project_labels' FROM a)
    SELECT conv_id, turn, string_agg(issue, ',' ORDER BY issue) AS issues FROM i GROUP BY ALL""",
)
def workspace_answer(spark, sf_dir):
    """The issues of answers with a section for each project; of the projects asked for, one never has a section."""
    rows = _sectioned(spark, sf_dir).withColumn("sections", vf.sections(F.col("answer")))
    expected = F.array("own", F.lit("beta"), F.lit("gamma"))
    missing = F.when(F.size(F.array_except(expected, F.map_keys("sections"))) > 0, F.lit("missing_project_labels"))
    parts = rows.select("conv_id", "turn", "own", missing.alias("missing"), F.explode("sections").alias("name", "body"))
    other = F.when(F.col("name") == "beta", F.col("own")).otherwise(F.lit("beta"))
    leak = F.when(F.rlike("body", F.concat(F.lit(r"(?i)\b"), other, F.lit(r"\b"))), F.concat(F.lit("cross_project_leakage:"), "name"))
    files = F.array(*map(F.lit, ("docs/a1.md", "src/b.py")))
    ref = F.when(F.size(vf.unsupported_files(F.col("body"), files)) > 0, F.concat(F.lit("unsupported_file_reference:"), "name"))
    found = parts.groupBy("conv_id", "turn").agg(F.collect_set("missing").alias("m"), F.collect_set(leak).alias("l"), F.collect_set(ref).alias("r"))
    return found.select("conv_id", "turn", F.array_join(F.array_sort(F.concat("m", "l", "r")), ",").alias("issues"))
