"""Quality classification by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text. Its tables, written to a shared folder in shards, are counts: of words,
of bigrams by context, and of the distinct contexts of each word. A document's distinct bigrams are joined with
the sorted count shards, its words with theirs, slice by slice of the scan; no document is shuffled.

p(w | c) = (n(c w) - D) / n(c) + backoff(c) * p(w), where p(w) comes from the number of contexts of w, discounted too. At each
order D is one of three discounts, for counts of 1, 2 and more, from the counts of counts. The mass that discounting takes from p(w) is spread over as many unknown words as the
vocabulary has known ones, so that a text of unknown words is improbable.

A document is kept if its perplexity is no more than its language's threshold: ``MARGIN`` times the ``QUANTILE``
of the perplexities of trusted texts that were held out of training (one fold in five). The approximate
quantile has a fixed accuracy, and a bounded sketch for each language.

Defined results: a null or empty text is its end alone; a language, null included, without held-out trusted text has no threshold
and keeps all its documents, as does a model without trusted text; rows with a null key aren't trusted; repeated rows are
judged alike; an empty table gives an empty table; other columns don't take part. Texts of any length count whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.llm.langid import fold
from scriptorium.llm.lm import discounts
from scriptorium.llm.lookup import filter_rows, write_lookup
from scriptorium.llm.ngrams import PACKED, Vocabulary, _gather, count_pairs, count_shards, count_words, merged, open_vocabulary, pair_shard, tokens, vocabulary_offsets
from scriptorium.llm.shared import map_file, new_folder, put_file, stored, table

QUANTILE = 0.99
MARGIN = 1.25
ACCURACY = 10_000
FOLDS, HELD_FOLD = 5, 0
HEAVY_SHARE = 0.1
LARGE = 2**32 - 1  # counts from here on take more than four bytes


@dataclass(frozen=True)
class CountModel:
    folder: str
    offsets: tuple[int, ...]
    pairs: int  # distinct bigrams
    discount: tuple[float, float, float]
    lower_discount: tuple[float, float, float]
    unknown: float  # p(w) of one of the unknown words
    heavy: tuple[int, ...]
    heavy_back: tuple[float, ...]
    heavy_sums: tuple[int, ...]
    filled: frozenset[int]  # the shards that have bigrams


def _contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of sorted bigrams; their tokens; their bigrams with counts 1, 2 and 3 or more."""
    context = (keys >> np.uint64(32)).astype(np.int64)
    opens = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    kinds = np.stack([np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), opens) for k in (1, 2, 3)], 1)
    return context[opens], np.add.reduceat(counts, opens), kinds


def train(texts: DataFrame, shards: int) -> CountModel | None:
    """Counts a one-column frame of trusted texts; None if it has no rows."""
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession, "quality")
    stats = {r.shard: r for r in count_words(texts, folder, shards)}
    if not stats:
        return None
    offsets = vocabulary_offsets(stats, shards)
    limit = HEAVY_SHARE * sum(r.tokens for r in stats.values()) / shards

    def heavy_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(folder, offsets)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(vocabulary.counts_of(shard) > limit) + offsets[shard], pa.int64())], names=["id"])

    found = spark.createDataFrame([(k,) for k in sorted(stats)], "shard int").mapInArrow(heavy_words, "id long").collect()  # at most 1 / HEAVY_SHARE a shard
    heavy = tuple(sorted({*(r.id for r in found), offsets[-1]}))
    lists = ("n", "contexts", "sums", "ones", "twos", "threes")

    def write(table_: pa.Table) -> pa.Table:
        shard = table_.column("shard")[0].as_py()
        keys, counts = merged(table_)
        large = np.flatnonzero(counts >= LARGE)  # their counts follow whole
        short = np.minimum(counts, LARGE).astype(np.uint32).tobytes()
        pieces = [np.array([len(keys), len(large)], np.int64).tobytes(), keys.tobytes(), large.tobytes(), counts[large].tobytes(), short]
        put_file(f"{folder}/pairs-{shard:05d}.bin", pieces)
        context, sums, kinds = _contexts(keys, counts)
        put_file(f"{folder}/sums-{shard:05d}.bin", [np.array([len(context)], np.int64).tobytes(), context.tobytes(), np.column_stack([sums, kinds]).astype(np.int64).tobytes()])
        which = np.flatnonzero(np.isin(context, np.array(heavy)))
        row = {"shard": shard, "n": [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))], "contexts": context[which].tolist(), "sums": sums[which].tolist()}
        row |= {name: kinds[which, k].tolist() for k, name in enumerate(lists[3:])}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((k, pa.list_(pa.int64())) for k in lists)]))

    counts = count_pairs(texts, folder, offsets, heavy).groupBy("shard").applyInArrow(write, "shard int, " + ", ".join(f"{k} array<long>" for k in lists))
    counts = stored(counts, "counts")
    filled = frozenset(r.shard for r in counts.select("shard").collect())
    n = np.sum([r.n for r in counts.select("n").collect()], axis=0).tolist()  # a row for each shard
    d = discounts(n[1:])
    parts = counts.select(F.explode(F.arrays_zip(*lists[1:])).alias("x")).select("x.*").groupBy("contexts").agg(*[F.sum(k).alias(k) for k in lists[2:]])
    known = {r.contexts: (r.sums, (d[0] * r.ones + d[1] * r.twos + d[2] * r.threes) / r.sums) for r in parts.collect()}  # the heavy contexts

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    yield np.unique(np.asarray(Pairs(folder, shard).keys) & np.uint64(0xFFFFFFFF), return_counts=True)

        cuts = np.array(offsets)
        yield from _gather(each(), lambda k: np.searchsorted(cuts, k.astype(np.int64), "right") - 1)

    def write_continuations(table_: pa.Table) -> pa.Table:
        shard = table_.column("shard")[0].as_py()
        keys, values = merged(table_)
        out = np.zeros(offsets[shard + 1] - offsets[shard], np.int64)
        out[keys.astype(np.int64) - offsets[shard]] = values
        put_file(f"{folder}/contexts-{shard:05d}.bin", [out.tobytes()])
        return pa.Table.from_pylist([{"shard": shard, "n": [*(int((values == k).sum()) for k in (1, 2, 3, 4)), len(values)]}], schema=pa.schema([("shard", pa.int32()), ("n", pa.list_(pa.int64()))]))

    lower = counts.select("shard").repartition(shards, "shard").mapInArrow(continuations, PACKED).groupBy("shard").applyInArrow(write_continuations, "shard int, n array<long>").collect()
    m = np.sum([r.n for r in lower], axis=0).tolist()
    e = discounts(m[:4])
    taken = e[0] * m[0] + e[1] * m[1] + e[2] * (m[4] - m[0] - m[1])
    return CountModel(
        folder, offsets, n[0], d, e, taken / n[0] / offsets[-1], heavy,
        tuple(known.get(c, (1, 1.0))[1] for c in heavy), tuple(known.get(c, (1, 1.0))[0] for c in heavy), filled,
    )


class Pairs:
    """A shard's bigrams and their counts; its contexts and, for each, its tokens and its bigrams by count."""

    def __init__(self, folder: str, shard: int):
        data, sums = map_file(f"{folder}/pairs-{shard:05d}.bin"), map_file(f"{folder}/sums-{shard:05d}.bin")
        (size, large), many = data[:16].view(np.int64).tolist(), int(sums[:8].view(np.int64)[0])
        at = 16 + 8 * size
        self.keys, self.large, self.wholes = data[16:at].view(np.uint64), data[at : at + 8 * large].view(np.int64), data[at + 8 * large : at + 16 * large].view(np.int64)
        self.short = data[at + 16 * large :].view(np.uint32)
        self.contexts, self.sums = sums[8 : 8 + 8 * many].view(np.int64), sums[8 + 8 * many :].view(np.int64).reshape(-1, 4)

    def count(self, at: np.ndarray) -> np.ndarray:
        out = self.short[at].astype(np.int64)
        big = np.flatnonzero(out == LARGE)
        out[big] = self.wholes[np.searchsorted(self.large, at[big])]
        return out


class Tables:
    """The count shards of a model, opened as they are needed."""

    def __init__(self, model: CountModel):
        self.model, self.vocabulary = model, Vocabulary(model.folder, model.offsets)
        self.offsets, self.heavy = np.array(model.offsets), np.array(model.heavy, np.int64)
        self._pairs: dict[int, Pairs] = {}
        self._contexts: dict[int, np.ndarray] = {}

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted numbers, from the contexts that each word has; -1 is one of the unknown words."""
        model, out = self.model, np.zeros(len(ids))
        shard = np.searchsorted(self.offsets, ids, "right") - 1
        for k in np.unique(shard[ids >= 0]).tolist():
            if k not in self._contexts:
                self._contexts[k] = map_file(f"{model.folder}/contexts-{k:05d}.bin").view(np.int64)
            at = np.flatnonzero((shard == k) & (ids >= 0))
            n = self._contexts[k][ids[at] - self.offsets[k]]  # 1 at least: a word of the vocabulary follows another or opens a text
            out[at] = (n - np.array(model.lower_discount)[np.minimum(n, 3) - 1]) / model.pairs
        return np.where(ids >= 0, out, model.unknown)

    def join(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability and back-off weight for sorted distinct bigrams whose contexts are known."""
        model = self.model
        shard = pair_shard(pairs, self.offsets, self.heavy)
        chance, back = np.zeros(len(pairs)), np.ones(len(pairs))
        context = (pairs >> np.uint64(32)).astype(np.int64)
        heavy_at = np.minimum(np.searchsorted(self.heavy, context), len(self.heavy) - 1)
        is_heavy = self.heavy[heavy_at] == context
        for k in np.unique(shard).tolist():
            if k not in model.filled:
                continue
            if k not in self._pairs:
                self._pairs[k] = Pairs(model.folder, k)
            keys, contexts, sums = self._pairs[k].keys, self._pairs[k].contexts, self._pairs[k].sums
            at = np.flatnonzero(shard == k)
            place = np.minimum(np.searchsorted(keys, pairs[at]), len(keys) - 1)
            hit = keys[place] == pairs[at]
            n = np.where(hit, self._pairs[k].count(place), 0)
            place = np.minimum(np.searchsorted(contexts, context[at]), len(contexts) - 1)
            seen = contexts[place] == context[at]
            whole = np.where(seen, sums[place, 0], 1).astype(np.float64)
            weight = np.where(seen, sums[place, 1:] @ np.array(model.discount) / whole, 1.0)
            whole = np.where(is_heavy[at], np.array(model.heavy_sums)[heavy_at[at]], whole)
            back[at] = np.where(is_heavy[at], np.array(model.heavy_back)[heavy_at[at]], weight)
            off = np.array([0.0, *model.discount])[np.minimum(n, 3)]
            chance[at] = (n - off) / whole
        return chance, back

    def log_probabilities(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(hashes, return_inverse=True)
        ids = self.vocabulary.look_up(distinct)[0]
        order = np.argsort(ids)
        lower = np.empty(len(ids))
        lower[order] = self.lower(ids[order])
        ids, lower = ids[place], lower[place]
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[np.cumsum(sizes) - sizes] = self.model.offsets[-1]
        pair = np.where(context >= 0, context << 32 | (ids & 0xFFFFFFFF), -1)
        distinct, place = np.unique(pair, return_inverse=True)
        chance, back = np.zeros(len(distinct)), np.ones(len(distinct))
        live = distinct >= 0
        chance[live], back[live] = self.join(distinct[live].astype(np.uint64))
        return np.log10(np.minimum(1.0, chance[place] + back[place] * lower))


@functools.lru_cache(maxsize=2)
def open_tables(model: CountModel) -> Tables:
    return Tables(model)


def perplexities(df: DataFrame, model: CountModel, text: str = "text") -> DataFrame:
    """``row``, ``n_tokens`` and ``perplexity`` of every whole text."""
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("n_tokens", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = open_tables(model)
        for batch in batches:
            for lo, hi, hashes, sizes in tokens(batch.column(0).field(at)):
                total = np.add.reduceat(tables.log_probabilities(hashes, sizes), np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(10 ** np.minimum(300, -total / sizes))], names=schema.names)

    at = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(run, schema)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and keep for each row of (doc_id, text, lang); ``trusted`` has the trusted ids."""
    sure = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("is_trusted", F.lit(True))
    held = fold(F.col("doc_id"), FOLDS) == HELD_FOLD
    learned = write_lookup(sure.where(~held).select(F.col("doc_id").cast("long").alias("key"), F.lit(1).cast("long").alias("value")), "trusted")
    model = train(filter_rows(docs.select("doc_id", "text"), "doc_id", learned).select("text"), count_shards(docs.select("text")))
    if model is None:
        return docs.select("doc_id", "lang", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    scored = stored(perplexities(docs.select("doc_id", "lang", "text"), model).select("row.doc_id", "row.lang", "n_tokens", "perplexity"), "scored")
    known = scored.join(sure.where(held), "doc_id", "left_semi")
    limits = known.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)).alias("at")).select("lang", (F.col("at") * MARGIN).alias("threshold"))  # a row for each language
    out = scored.join(F.broadcast(limits), scored["lang"].eqNullSafe(limits["lang"]), "left").select(scored["*"], "threshold")
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision for every row of ``documents``; trusted are those labelled of good quality and not toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"))
