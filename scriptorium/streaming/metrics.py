"""Metrics of log events in five-minute periods, in batch and as a stream, and alarms over consecutive periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PERIOD = "5 minutes"
LATENESS = "1 hour"
RATE_PERIOD, RATE_LIMIT = "1 minute", 300


def period_metrics(events: DataFrame) -> DataFrame:
    """(period, event_type, events, total, average, highest) of (ts, event_type, value)."""
    grouped = events.groupBy(F.window("ts", PERIOD).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.avg("value").alias("average"), F.max("value").alias("highest"))
    return grouped.select(F.col("w.start").alias("period"), "event_type", "events", "total", "average", "highest")


def event_rates(events: DataFrame, who: str, limit: int = RATE_LIMIT) -> DataFrame:
    """(who, period, events, limited, over) by minute: whether there are more events than the limit, and how many more. Events without a time don't count."""
    counts = events.groupBy(who, F.window("ts", RATE_PERIOD).alias("w")).agg(F.count("*").alias("events"))
    return counts.select(who, F.col("w.start").alias("period"), "events", (F.col("events") > limit).alias("limited"), F.greatest(F.lit(0), F.col("events") - limit).alias("over"))


def stream_metrics(spark: SparkSession, path: str, schema, folder: str) -> DataFrame:
    """The same from a stream over files of events, run until all that is there is counted.

    Each micro-batch writes the periods that it changed below ``folder``, under its number, so that a batch that is run
    again replaces its own rows; of a period the last batch counts. Events later than ``LATENESS`` are not counted any more.
    No state or result passes through the driver.
    """
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    counted, place = period_metrics(events), folder + "/batches"
    spark.createDataFrame([], counted.schema).write.mode("overwrite").parquet(f"{place}/batch=-1")
    put = lambda rows, number: rows.write.mode("overwrite").parquet(f"{place}/batch={number}")
    counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(counted.schema.add("batch", "long")).parquet(place)
    values = [c for c in counted.columns if c not in ("period", "event_type")]
    last = written.groupBy("period", "event_type").agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select("period", "event_type", "last.*")


def stream_closed(spark: SparkSession, path: str, schema, folder: str, files: int = 1) -> DataFrame:
    """(period, event_type, events, total, sketch) of the periods that are over, each written once and for good.

    Files are taken ``files`` at a time, oldest first. A period closes when the watermark, the latest time seen less ``LATENESS``,
    has passed its end; its state goes then, and an event that comes for it later is dropped. The sketch of its values can be merged
    with those of other periods (:func:`percentile_of`). Each micro-batch writes the periods that it closed under its number.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    grouped = events.groupBy(F.window("ts", PERIOD).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.kll_sketch_agg_double("value").alias("sketch"))
    closed, place = grouped.select(F.col("w.start").alias("period"), "event_type", "events", "total", "sketch"), folder + "/closed"
    spark.createDataFrame([], closed.schema).write.mode("overwrite").parquet(f"{place}/batch=-1")
    put = lambda rows, number: rows.write.mode("overwrite").parquet(f"{place}/batch={number}")
    closed.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{place}/batch=*")


def percentile_of(periods: DataFrame, keys: list[Column | str], share: float = 0.95) -> DataFrame:
    """``keys``, events and the percentile of all values of the periods, from their merged sketches: exact up to some 200 values, within about 1.3 % of ranks beyond."""
    merged = periods.groupBy(*keys).agg(F.sum("events").alias("events"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumn("percentile", F.kll_sketch_get_quantile_double("sketch", F.lit(share))).drop("sketch")


def alarms(metrics: DataFrame, breach: Column, periods: int, seconds: int = 300) -> DataFrame:
    """Periods that end a run of ``periods`` consecutive breaches; a period without events is no breach."""
    order = Window.partitionBy("event_type").orderBy("at")
    marked = metrics.withColumn("at", F.unix_seconds(F.col("period").cast("timestamp"))).withColumn("breach", breach.cast("int"))
    recent = order.rangeBetween(-seconds * (periods - 1), 0)
    return marked.withColumn("breaches", F.sum("breach").over(recent)).where(F.col("breaches") == periods).select("event_type", "period", "breaches")
