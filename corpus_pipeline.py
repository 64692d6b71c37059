"""Corpus cleaning: stages over ``documents``, each written and read again before the next.

1. ``language_id``: texts without a letter, or whose language is predicted with a score below ``MIN_SCORE``, go.
2. ``near_duplicates``: of each group of linked documents one stays.
3. ``decontamination``: documents with a verified benchmark item go.
4. ``secrets``: each secret in a text is replaced by a marker; ``n_chars`` follows where a text changed.
5. ``bpe``: token ids of the clean texts, and whether decoding them gives the text back.

Each stage but the last returns the columns of its input, extra ones included. Null and empty texts go with
the first stage; empty tables pass through; what a stage does with nulls in other columns, repeated rows and
very long texts is that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.bpe import compile_lexicon, encode
from scriptorium.llm.decontaminate import drop_contaminated
from scriptorium.llm.jaccard import keep_one
from scriptorium.llm.langid import fit, predict_language
from scriptorium.llm.secrets import scan_secrets
from scriptorium.llm.shared import new_folder, small_batches, table

MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = predict_language(docs, fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan_secrets(docs, redact=True)
    changed = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = encode(docs, compile_lexicon(docs), decode=True)
    return found.select("row.doc_id", "row.lang", "row.source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("row.text")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
