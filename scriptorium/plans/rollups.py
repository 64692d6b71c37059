"""Rollups: coverage, inventories, sessions, health, answer metrics, and log metrics in periods."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scriptorium.operators import conversation as cv
from scriptorium.plans.registry import query
from scriptorium.plans.views import chunks, sources, table, with_views
from scriptorium.sources.folders import shared_folder
from scriptorium.streaming import metrics


@query(
    "d01_source_coverage",
    with_views("SELECT s.source_id, s.status, count(chunk_id) AS chunks, count(embedding) AS embedded, count_if(chunk_id IS NOT NULL AND embedding IS NULL) AS bare FROM sources s LEFT JOIN chunks c USING (source_id) GROUP BY ALL"),
)
def source_coverage(spark, sf_dir):
    counts = chunks(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("bare"))
    return sources(spark, sf_dir).select("source_id", "status").join(counts, "source_id", "left").fillna(0, ["chunks", "embedded", "bare"])


@query("d02_type_histogram", with_views("SELECT twin_id, chunk_type, count(*) AS n, count(embedding) AS with_embedding FROM chunks JOIN sources USING (source_id) WHERE status = 'ready' AND source_ref NOT LIKE '__memory__%' GROUP BY ALL"))
def type_histogram(spark, sf_dir):
    ready = chunks(spark, sf_dir).where("source_ref not like '__memory__%'").join(sources(spark, sf_dir).where("status = 'ready'"), "source_id")
    return ready.groupBy("twin_id", "chunk_type").agg(F.count("*").alias("n"), F.count("embedding").alias("with_embedding"))


@query("d03_debug_samples", with_views("SELECT twin_id, chunk_id, source_id, chunk_type, row_number() OVER (PARTITION BY twin_id ORDER BY source_id, chunk_type, chunk_id)::INT AS no FROM chunks JOIN sources USING (source_id) WHERE chunk_type <> 'memory_brief' QUALIFY no <= 5"))
def debug_samples(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).where("chunk_type <> 'memory_brief'").join(sources(spark, sf_dir), "source_id")
    first = Window.partitionBy("twin_id").orderBy("source_id", "chunk_type", "chunk_id")
    return rows.withColumn("no", F.row_number().over(first)).where("no <= 5").select("twin_id", "chunk_id", "source_id", "chunk_type", "no")


@query("d04_platform_counters", with_views("SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations) AS messages, (SELECT count_if(status = 'ready') FROM sources) AS ready"))
def platform_counters(spark, sf_dir):
    one = sources(spark, sf_dir).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ready").alias("ready"))
    two = table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks"))
    three = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("messages"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@query("d05_session_summary", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 120) AS preview FROM conversations GROUP BY conv_id")
def session_summary(spark, sf_dir):
    user = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(F.min_by("text", user), 1, 120).alias("preview"))


@query("d08_workspace_summary", with_views("SELECT workspace_id, twin_id, count(*) AS sources, count_if(status = 'ready') AS ready, coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'ready'), '') AS ready_names FROM sources GROUP BY ALL"))
def workspace_summary(spark, sf_dir):
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "ready", F.col("name")))), ",")
    return sources(spark, sf_dir).groupBy("workspace_id", "twin_id").agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "ready").alias("ready"), names.alias("ready_names"))


@query(
    "d09_evidence_health",
    with_views("""h AS (SELECT source_id, status, source_type IN ('google_drive', 'pdf') AS strict, CASE WHEN source_id % 3 > 0 THEN (source_id % 7) / 7.0 END AS ratio FROM sources)
    SELECT status, count(*) AS sources, count_if(strict) AS strict_sources, round(min(ratio), 6)::DOUBLE AS least_ratio, bool_or(strict AND status <> 'ready') AS strict_not_ready FROM h GROUP BY status"""),
)
def evidence_health(spark, sf_dir):
    strict = F.col("source_type").isin("google_drive", "pdf")
    rows = sources(spark, sf_dir).withColumn("strict", strict).withColumn("ratio", F.when(F.col("source_id") % 3 > 0, (F.col("source_id") % 7) / 7.0))
    return rows.groupBy("status").agg(F.count("*").alias("sources"), F.count_if("strict").alias("strict_sources"), F.round(F.min("ratio"), 6).alias("least_ratio"), F.bool_or(F.col("strict") & (F.col("status") != "ready")).alias("strict_not_ready"))


@query("d13_inventory_merge", with_views("SELECT twin_id, split_part(source_ref, '/', 1) AS folder, count(DISTINCT source_ref) AS files FROM chunks JOIN sources USING (source_id) WHERE status = 'ready' GROUP BY ALL"))
def inventory_merge(spark, sf_dir):
    ready = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where("status = 'ready'"), "source_id").select("twin_id", "source_ref").distinct()
    return ready.groupBy("twin_id", F.substring_index("source_ref", "/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("d24_structure_overview", with_views("SELECT twin_id, count(DISTINCT source_ref) AS files FROM chunks JOIN sources USING (source_id) WHERE status IN ('ready', 'processing') GROUP BY twin_id"))
def structure_overview(spark, sf_dir):
    live = chunks(spark, sf_dir, vectors=False).join(sources(spark, sf_dir).where(F.col("status").isin("ready", "processing")), "source_id")
    return live.groupBy("twin_id").agg(F.count_distinct("source_ref").alias("files"))


@query(
    "d15_evaluator_average",
    """WITH s AS (SELECT doc_id, [least(5, greatest(1, quality * 6)), least(5, greatest(1, 4 - toxic * 9)), CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 + 1 END] AS v FROM labels)
    SELECT doc_id, round(list_avg(v), 6) AS average, round(list_avg(v), 6) < 2.5 AS warn FROM s""",
)
def evaluator_average(spark, sf_dir):
    clamp = lambda c: F.least(F.lit(5), F.greatest(F.lit(1), c)).cast("double")
    given = F.array_compact(F.array(clamp(F.col("quality") * 6), clamp(4 - F.col("toxic") * 9), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5 + 1).cast("double"))))
    mean = F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given), 6)
    return table(spark, sf_dir, "labels").select("doc_id", mean.alias("average"), (mean < 2.5).alias("warn"))


@query("d16_golden_summary", "SELECT quality, toxic, count(*) AS cases FROM labels GROUP BY ALL UNION ALL SELECT quality, NULL, count(*) FROM labels GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*) FROM labels")
def golden_summary(spark, sf_dir):
    return table(spark, sf_dir, "labels").rollup("quality", "toxic").agg(F.count("*").alias("cases"))


@query("d17_concat_in_order", "SELECT conv_id, sha256(substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 120000)) AS merged_sha256 FROM conversations GROUP BY conv_id")
def concat_in_order(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.substring(F.array_join(texts, "\n\n"), 1, 120000).cast("binary"), 256).alias("merged_sha256"))


@query("d21_languages", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source")
def languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query("d23_source_modes", with_views("SELECT twin_id, count_if(source_id % 3 = 0) AS legacy, count_if(source_id % 3 <> 0) AS strict, round(avg(source_id % 7), 0)::BIGINT AS mean_coverage FROM sources GROUP BY twin_id"))
def source_modes(spark, sf_dir):
    return sources(spark, sf_dir).groupBy("twin_id").agg(F.count_if(F.col("source_id") % 3 == 0).alias("legacy"), F.count_if(F.col("source_id") % 3 != 0).alias("strict"), F.round(F.avg(F.col("source_id") % 7), 0).cast("long").alias("mean_coverage"))


@query(
    "e04_history_window",
    """WITH m AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || ' …[truncated]' ELSE text END AS text FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20),
    r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM m) SELECT conv_id, turn, role, text FROM r WHERE spent <= 12000""",
)
def history_window(spark, sf_dir):
    return cv.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query(
    "e05_budget_prefix",
    with_views("""o AS (SELECT source_id, chunk_id, length(content) AS n, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS position FROM chunks QUALIFY position <= 200),
    s AS (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY position) AS spent FROM o) SELECT source_id, chunk_id, position::INT AS position, spent::BIGINT AS spent FROM s WHERE spent <= 80000"""),
)
def prefix(spark, sf_dir):
    rows = chunks(spark, sf_dir, vectors=False).select("source_id", "chunk_id", F.length("content").alias("n"))
    return cv.budget_prefix(rows, "source_id", [F.col("chunk_id")], F.col("n"), 200, 80_000).select("source_id", "chunk_id", "position", "spent")


@query(
    "e08_priority_cap",
    with_views("""p AS (SELECT source_id, chunk_id, row_number() OVER (PARTITION BY source_id ORDER BY CASE chunk_type WHEN 'documentation' THEN 0 WHEN 'code_snippet' THEN 1 ELSE 2 END, chunk_id) AS rn FROM chunks)
    SELECT source_id, chunk_id, ((rn - 1) // 30)::BIGINT AS batch FROM p WHERE rn <= 150"""),
)
def priority_cap(spark, sf_dir):
    order = F.when(F.col("chunk_type") == "documentation", 0).when(F.col("chunk_type") == "code_snippet", 1).otherwise(2)
    ranked = chunks(spark, sf_dir, vectors=False).withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy(order, "chunk_id")))
    return ranked.where("rn <= 150").select("source_id", "chunk_id", F.floor((F.col("rn") - 1) / 30).alias("batch"))


@query(
    "e11_judge_excerpt",
    "WITH m AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 14) SELECT conv_id, right(string_agg(role || ': ' || substr(text, 1, 900), chr(10) ORDER BY turn), 2500) AS excerpt FROM m GROUP BY conv_id",
)
def judge_excerpt(spark, sf_dir):
    return cv.excerpt(table(spark, sf_dir, "conversations"))


_PERIODS = "SELECT time_bucket(INTERVAL '5 minutes', ts) AS period, event_type, count(*) AS events, round(sum(value), 4) AS total, round(avg(value), 4) AS average, max(value) AS highest FROM events GROUP BY ALL"


def _rounded(df):
    return df.select(F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "events", F.round("total", 4).alias("total"), F.round("average", 4).alias("average"), "highest")


@query("d20_log_metrics", _PERIODS)
def log_metrics(spark, sf_dir):
    return _rounded(metrics.period_metrics(table(spark, sf_dir, "events")))


@query("s01_log_metrics_stream", _PERIODS)
def log_metrics_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    # a folder of files is streamed as it is, a single file by its name
    folder, _, leaf = f"{sf_dir}/events.parquet".rpartition("/")
    return _rounded(metrics.stream_metrics(spark, f"{folder}/{leaf[:-1]}[{leaf[-1]}]", events.schema, shared_folder(spark, "log_metrics")))


@query(
    "e10_alarms",
    """WITH p AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS period, event_type, avg(value) AS average FROM events GROUP BY ALL),
    r AS (SELECT event_type, period, count_if(average > 20) OVER (PARTITION BY event_type ORDER BY period RANGE BETWEEN INTERVAL '5 minutes' PRECEDING AND CURRENT ROW) AS breaches FROM p)
    SELECT event_type, period, breaches FROM r WHERE breaches = 2""",
)
def log_alarms(spark, sf_dir):
    found = metrics.alarms(metrics.period_metrics(table(spark, sf_dir, "events")), F.col("average") > 20, 2)
    return found.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(
    "h10_latency_budgets",
    """WITH l AS (SELECT event_id, value * 100 AS ms, event_id % 2 = 0 AS workspace FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN ms > 3000 THEN 'retrieval' END, CASE WHEN ms * 2 > 9000 THEN 'generation' END, CASE WHEN ms / 4 > 1000 THEN 'verification' END, CASE WHEN ms * 3 > CASE WHEN workspace THEN 18000 ELSE 12000 END THEN 'total' END], lambda x: x IS NOT NULL), ',') AS breaches FROM l""",
)
def latency_budgets(spark, sf_dir):
    ms = F.col("value") * 100
    over = lambda name, spent, limit: F.when(spent > limit, name)
    total = F.when(F.col("event_id") % 2 == 0, 18000).otherwise(12000)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_compact(F.array(over("retrieval", ms, 3000), over("generation", ms * 2, 9000), over("verification", ms / 4, 1000), over("total", ms * 3, total))), ",").alias("breaches"))


REFERENCE = r"[A-Za-z0-9_/-]+\.(?:md|py|ts|tsx|json|pdf|txt)"


@query(
    "i25_file_references",
    f"""WITH a AS (SELECT conv_id, turn, concat(text, ' see docs/a', turn, '.md and src/b.py') AS answer FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '{REFERENCE}'))), ',') AS refs,
      array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(answer, '{REFERENCE}')), lambda x: x NOT IN ('docs/a1.md', 'docs/a3.md'))), ',') AS unsupported FROM a""",
)
def file_references(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" see docs/a"), "turn", F.lit(".md and src/b.py")).alias("answer"))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(REFERENCE), 0)))
    allowed = F.array(F.lit("docs/a1.md"), F.lit("docs/a3.md"))
    return answers.select("conv_id", "turn", F.array_join(refs, ",").alias("refs"), F.array_join(F.array_except(refs, allowed), ",").alias("unsupported"))
