"""Streams over change feeds and late events; the batches that they read are derived from the tables and published as files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scriptorium.plans import helpers  # noqa: F401  (its query's SQL is used here)
from scriptorium.plans.registry import ORACLE_SQL, query
from scriptorium.plans.views import table
from scriptorium.sources import feed
from scriptorium.sources.folders import shared_folder
from scriptorium.streaming import metrics

_CHANGE = T.StructType([T.StructField("k", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("gone", T.BooleanType()), T.StructField("value", T.DoubleType())])
ROUNDS = 3


@query("s05_change_feed_stream", ORACLE_SQL["s04_change_feed"])
def change_feed_stream(spark, sf_dir):
    """The state of ``s04_change_feed`` from a stream over numbered batches, taken in by two runs of it; the third batch sends the first again."""
    events = table(spark, sf_dir, "events")
    deletion = events.agg(F.min("event_type").alias("deletion"))  # one row
    changes = events.join(F.broadcast(deletion)).select(F.col("user_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("seq"), (F.col("event_type") == F.col("deletion")).alias("gone"), F.col("value").cast("double").alias("value"))
    place = shared_folder(spark, "change_feed")
    state = feed.ChangeTable(spark, place + "/table", _CHANGE, ["k"], ["seq"])
    for number, part in enumerate((0, 1, 0, 2), 1):
        feed.publish(changes.where(F.col("seq") % ROUNDS == part), place + "/feed", number)
        if number != 1:
            feed.follow(spark, place + "/feed", _CHANGE, place + "/checkpoint", state.apply)
    return state.rows().where("not gone").select("k", "seq", "value")


_SYNCS = """f AS (SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS path, doc_id // 20 AS n, text, substr(source, 4)::INT AS s FROM documents),
v AS (SELECT source_id, path, n, s, CASE WHEN n % 4 = 1 THEN concat(text, ' changed') ELSE text END AS content FROM f WHERE n % 4 <> 0)
SELECT source_id, CASE WHEN s % 3 = 0 THEN 'third' WHEN n % 4 IN (1, 3) THEN 'second' ELSE 'first' END AS snapshot_id, path, sha256(CASE WHEN s % 3 = 0 THEN concat(content, ' again') ELSE content END) AS content_sha256
FROM v WHERE s % 3 <> 0 OR n % 2 = 1"""


@query("s06_source_sync_stream", "WITH " + _SYNCS)
def source_sync_stream(spark, sf_dir):
    """The files of each source after a full sync, a delta with deletions, changes and new files, a second full sync of a third of the sources, and the delta once more."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.floor(F.col("doc_id") / 20).alias("n"), F.col("text").alias("content"), F.substring("source", 4, 9).cast("int").alias("s"))
    kind = F.col("n") % 4

    def rows(files, snapshot, number, what="upsert", content=F.col("content")):
        return files.select("source_id", F.lit(snapshot).alias("snapshot_id"), F.lit(what).alias("kind"), "path", content.alias("content"), F.lit(number).cast("long").alias("batch"))

    def whole(files, snapshot, number, content=F.col("content")):
        mark = files.select("source_id").distinct().select("source_id", F.lit("").alias("path"), F.lit(None).cast("string").alias("content"))
        return rows(mark, snapshot, number, "full").unionByName(rows(files, snapshot, number, content=content))

    def delta(number):
        changed = F.when(kind == 1, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
        return rows(docs.where(kind == 0), "second", number, "delete", F.lit(None).cast("string")).unionByName(rows(docs.where(kind.isin(1, 3)), "second", number, content=changed))

    later = F.concat("content", F.when(kind == 1, " changed").otherwise(""), F.lit(" again"))
    batches = (whole(docs.where(kind != 3), "first", 1), delta(2), whole(docs.where("s % 3 = 0 and n % 2 = 1"), "third", 3, later), delta(4))
    place = shared_folder(spark, "source_sync")
    state = feed.SourceTable(spark, place + "/table")
    for number, batch in enumerate(batches, 1):
        feed.publish(batch, place + "/feed", number)
    feed.follow(spark, place + "/feed", feed.FILE_CHANGE, place + "/checkpoint", state.apply)
    return state.rows().select("source_id", "snapshot_id", "path", F.sha2("content", 256).alias("content_sha256"))


_QUARTERS = """e AS (SELECT ts, event_type, value, event_id % 50 = 0 AS late, least(3, floor(4 * (epoch_us(ts) - lo)::DOUBLE / greatest(1, hi - lo)))::INT AS quarter
  FROM events, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)),
p AS (SELECT *, time_bucket(INTERVAL '5 minutes', ts) AS period, CASE WHEN late THEN 3 ELSE quarter END AS batch FROM e),
w AS (SELECT max(ts) FILTER (batch <= 1) - INTERVAL 1 HOUR AS before, max(ts) - INTERVAL 1 HOUR AS after FROM p),
c AS (SELECT period, event_type, value FROM p, w WHERE (batch < 3 OR period + INTERVAL '5 minutes' > before) AND period + INTERVAL '5 minutes' <= after)"""


def _closed(spark, sf_dir):
    """Four micro-batches: the quarters of the time that the events cover, less every fiftieth event, which comes with the last quarter."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))  # one row
    quarter = F.least(F.lit(3), F.floor(4 * (micros - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))).cast("int"))
    dealt = events.join(F.broadcast(span)).select("ts", "event_type", "value", F.when(F.col("event_id") % 50 == 0, 3).otherwise(quarter).alias("batch"))
    place = shared_folder(spark, "late_events")
    for number in range(4):
        dealt.where(F.col("batch") == number).drop("batch").coalesce(1).write.parquet(f"{place}/events/{number}")
    return metrics.stream_closed(spark, place + "/events/*", dealt.drop("batch").schema, place)


@query("s07_closed_periods", "WITH " + _QUARTERS + " SELECT period, event_type, count(*) AS events, round(sum(value), 4) AS total FROM c GROUP BY ALL")
def closed_periods(spark, sf_dir):
    """Periods that a stream with late events has closed: each once, without what came too late."""
    return _closed(spark, sf_dir).select(F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "events", F.round("total", 4).alias("total"))


@query("s08_closed_p95")
def closed_p95(spark, sf_dir):
    """The 95th percentile of each hour and type of event, from the merged sketches of its closed periods."""
    found = metrics.percentile_of(_closed(spark, sf_dir), [F.date_trunc("hour", "period").alias("hour"), F.col("event_type")])
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.col("percentile").alias("p95"))
