"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model with modified absolute discounting over the unigrams.
Its trie has two levels, in shards of a shared folder that tasks memory-map:

* words: an Elias-Fano sequence of hashes, one of running sums of their counts (:mod:`scriptorium.llm.ngrams`),
  and two bytes for each word's quantised probability;
* successors: for the contexts of a shard, an Elias-Fano sequence of context numbers, one of
  pointers to where each context's successors start, and one of all successors, each relative to its
  context (context rank * vocabulary + word), with a byte for its quantised discounted probability and two for
  each context's back-off weight.

A bigram is found by a successor search relative to its context, between the pointers of that context. Bigram counts
are kept in files of their own only until their shard of the trie is whole. p(w | c) is the successor's probability,
if it has one, plus the context's back-off weight times p(w). Discounted unigram mass goes to the one class of
unknown words, so that the probabilities of the vocabulary and that class add up to 1. An unknown word as context
backs off with weight 1. Quantisation is uniform in the logarithm.

Defined results: a null or empty text is its end alone; rows with a null key are never learned from and are not
held out; repeated rows are scored alike; without training rows every token is unknown, with probability 1;
an empty table gives an empty table; other columns don't take part. Texts of any length are scored whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.llm.eliasfano import Monotone, pack_monotone
from scriptorium.llm.langid import fold
from scriptorium.llm.ngrams import count_pairs, count_shards, count_words, distinct_of, gathered, merged, open_vocabulary, pair_shard, vocabulary_offsets
from scriptorium.llm.shared import drop_file, has_file, map_file, new_folder, put_file, stored, table

LEVELS = 255  # of a quantised probability
LEAST = -12.0  # its least base-10 logarithm
WORD_LEVELS, WORD_LEAST = 65535, -20.0  # the same of a word's
HEAVY_SHARE = 0.1  # a context with more than this part of a mean shard's tokens is dealt out


@dataclass(frozen=True)
class Model:
    folder: str
    offsets: tuple[int, ...]  # of the vocabulary's shards
    tokens: int
    heavy: tuple[int, ...]
    heavy_weight: tuple[float, ...]
    once_discount: float  # of unigrams
    filled: frozenset[int] = frozenset()  # the shards that have bigrams

    @property
    def words(self) -> int:
        return self.offsets[-1]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by count, before it is quantised; a count of 0 is the class of unknown words."""
        total = max(1, self.tokens)
        unknown = self.once_discount * self.words / total if self.tokens else 1.0
        return np.where(counts > 0, (counts - self.once_discount) / total, unknown)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4; fixed ones where those can't tell."""
    if min(n) <= 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(out, (1, 2, 3)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct contexts of sorted pairs, where each starts, and the number of each pair's context."""
    context = keys >> np.uint64(32)
    opens = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    return context[opens], opens, np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(keys))))


def train(texts: DataFrame) -> Model:
    """Learns from a one-column frame of texts."""
    spark = texts.sparkSession
    folder, shards = new_folder(spark, "trie"), count_shards(texts)
    stats = {r.shard: r for r in count_words(texts, folder, shards)}
    offsets = vocabulary_offsets(stats, shards)
    total, once, twice = (sum(getattr(r, name) for r in stats.values()) for name in ("tokens", "once", "twice"))
    once_discount = once / (once + 2 * twice) if once and twice else 0.5
    limit = HEAVY_SHARE * total / shards
    model = Model(folder, offsets, total, (), (), once_discount)

    def heavy_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(folder, offsets)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = vocabulary.counts_of(shard)
                level = np.round(np.maximum(np.log10(model.unigram(counts)), WORD_LEAST) / WORD_LEAST * WORD_LEVELS)
                put_file(f"{folder}/chances-{shard:05d}.bin", [level.astype("<u2").tobytes()])
                at = np.flatnonzero(counts > limit)
                yield pa.RecordBatch.from_arrays([pa.array(at + offsets[shard], pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    shard_list = spark.createDataFrame([(k,) for k in sorted(stats)], "shard int").repartition(max(1, min(shards, 64))) if stats else None
    # at most 1 / HEAVY_SHARE contexts for each shard
    found = {r.id: r.n for r in shard_list.mapInArrow(heavy_words, "id long, n long").collect()} if stats else {}
    heavy = tuple(sorted({*found, offsets[-1]}))  # the start of a text is one

    def write_counts(table_: pa.Table) -> pa.Table:
        shard = table_.column("shard")[0].as_py()
        keys, counts = merged(table_)
        put_file(f"{folder}/pairs-{shard:05d}.bin", [np.array([len(keys)], np.int64).tobytes(), keys.tobytes(), counts.tobytes()])
        context, opens, _ = _runs(keys)
        which = np.flatnonzero(np.isin(context.astype(np.int64), np.array(heavy)))
        kinds = [np.add.reduceat((counts == k).astype(np.int64) if k < 3 else (counts >= 3).astype(np.int64), opens)[which].tolist() for k in (1, 2, 3)]
        sums = np.add.reduceat(counts, opens)[which].tolist()
        row = {"shard": shard, "n": [int((counts == k).sum()) for k in (1, 2, 3, 4)], "contexts": context[which].astype(np.int64).tolist(), "sums": sums, "ones": kinds[0], "twos": kinds[1], "threes": kinds[2]}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((k, pa.list_(pa.int64())) for k in ("n", "contexts", "sums", "ones", "twos", "threes"))]))

    counts = count_pairs(texts, folder, offsets, heavy).groupBy("shard").applyInArrow(write_counts, "shard int, " + ", ".join(f"{k} array<long>" for k in ("n", "contexts", "sums", "ones", "twos", "threes")))
    counts = stored(counts, "counts")
    n = [sum(r.n[k] for r in counts.select("n").collect()) for k in range(4)]  # a row for each shard
    d = discounts(n) if counts is not None and any(n) else (0.5, 0.75, 0.9)
    parts = counts.select(F.explode(F.arrays_zip("contexts", "sums", "ones", "twos", "threes")).alias("x")).select("x.*").groupBy("contexts").agg(*[F.sum(k).alias(k) for k in ("sums", "ones", "twos", "threes")])
    known = {r.contexts: (r.sums, (d[0] * r.ones + d[1] * r.twos + d[2] * r.threes) / r.sums) for r in parts.collect()}  # the heavy contexts
    sums, weights = tuple(known.get(c, (1, 1.0))[0] for c in heavy), tuple(known.get(c, (1, 1.0))[1] for c in heavy)
    words = offsets[-1]

    def write_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, many_sums = np.array(heavy, np.uint64), np.array(sums, np.int64)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                raw = f"{folder}/pairs-{shard:05d}.bin"
                if has_file(f"{folder}/trie-{shard:05d}.bin"):  # by an attempt of this task before, which may have dropped the counts
                    drop_file(raw)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])
                    continue
                data = map_file(raw)
                size = int(data[:8].view(np.int64)[0])
                keys, counts = data[8 : 8 + 8 * size].view(np.uint64), data[8 + 8 * size :].view(np.int64)
                context, opens, number = _runs(keys)
                off = np.choose(np.minimum(counts, 3) - 1, d)
                whole = np.add.reduceat(counts, opens)
                back = np.add.reduceat(off, opens) / whole
                at = np.minimum(np.searchsorted(many, context), len(many) - 1)
                whole = np.where(many[at] == context, many_sums[at], whole)
                level = np.round(np.maximum(np.log10((counts - off) / whole[number]), LEAST) / LEAST * LEVELS).astype(np.uint8)
                relative = number.astype(np.uint64) * np.uint64(words) + (keys & np.uint64(0xFFFFFFFF))
                pieces = [pack_monotone(context, words + 1), pack_monotone(np.append(opens, size), size + 1), pack_monotone(relative, len(context) * words)]
                extra = [np.round(back * 65535).astype("<u2").tobytes(), level.tobytes()]
                put_file(f"{folder}/trie-{shard:05d}.bin", [x + b"\0" * (-len(x) % 8) for x in [*pieces, *extra]])
                del data, keys, counts
                drop_file(raw)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    built = counts.select("shard").repartition(shards, "shard").mapInArrow(write_trie, "shard int").collect()  # a row for each shard
    return Model(folder, offsets, total, heavy, weights, once_discount, frozenset(r.shard for r in built))


class Trie:
    """One shard's contexts, pointers and successors."""

    def __init__(self, uri: str, words: int):
        data, self.words = map_file(uri), np.uint64(words)
        at, parts = 0, []
        for _ in range(3):
            parts.append(Monotone(data, at))
            at = parts[-1].end + (-parts[-1].end % 8)
        self.contexts, self.pointers, self.successors = parts
        self.back = data[at : at + 2 * self.contexts.n].view("<u2")
        at += 2 * self.contexts.n + (-2 * self.contexts.n % 8)
        self.level = data[at : at + self.successors.n]

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted probability of each bigram, 0 if unseen, and the back-off weight of its context, 1 if unseen. A word of -1 is unseen."""
        rank = self.contexts.find(context.astype(np.uint64))
        back = np.where(rank >= 0, self.back[np.maximum(rank, 0)] / 65535 if len(self.back) else 1.0, 1.0)
        chance = np.zeros(len(context))
        try_ = np.flatnonzero((rank >= 0) & (word >= 0))
        first, end = (self.pointers.get(rank[try_] + k).astype(np.int64) for k in (0, 1))
        at = self.successors.find(rank[try_].astype(np.uint64) * self.words + word[try_].astype(np.uint64), first, end)
        hit = at >= 0
        chance[try_[hit]] = 10 ** (self.level[at[hit]] / LEVELS * LEAST)
        return chance, back


@functools.lru_cache(maxsize=4096)
def open_trie(folder: str, shard: int, words: int) -> Trie:
    return Trie(f"{folder}/trie-{shard:05d}.bin", words)


@functools.lru_cache(maxsize=4096)
def open_chances(folder: str, shard: int) -> np.ndarray:
    return map_file(f"{folder}/chances-{shard:05d}.bin").view("<u2")


def word_probabilities(model: Model, ids: np.ndarray) -> np.ndarray:
    """The quantised p(w) of words by number; of -1, that of the class of unknown words."""
    out = np.full(len(ids), float(model.unigram(np.zeros(1, np.int64))[0]))
    offsets = np.array(model.offsets)
    shard = np.searchsorted(offsets, ids, "right") - 1
    for k in np.unique(shard[ids >= 0]).tolist():
        at = np.flatnonzero((shard == k) & (ids >= 0))
        out[at] = 10 ** (open_chances(model.folder, k)[ids[at] - offsets[k]] / WORD_LEVELS * WORD_LEAST)
    return out


def token_probabilities(model: Model, ids: np.ndarray, lower: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """p(token | token before) for texts of ``sizes`` tokens, given numbers and probabilities of the tokens."""
    if not model.tokens:
        return np.ones(len(ids))
    offsets, heavy = np.array(model.offsets), np.array(model.heavy, np.int64)
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[np.cumsum(sizes) - sizes] = model.words
    pair = np.where(context >= 0, context << 32 | (ids & 0xFFFFFFFF), -1)
    distinct, place = distinct_of(pair)
    chance, back = np.zeros(len(distinct)), np.ones(len(distinct))
    live = np.flatnonzero(distinct >= 0)
    shard = pair_shard(distinct[live].astype(np.uint64), offsets, heavy)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(len(offsets)))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        if k not in model.filled:
            continue
        at = live[order[cuts[k] : cuts[k + 1]]]
        word = distinct[at] & 0xFFFFFFFF
        chance[at], back[at] = open_trie(model.folder, k, model.words).query(distinct[at] >> 32, np.where(word == 0xFFFFFFFF, -1, word))
    of = distinct >> 32
    at = np.minimum(np.searchsorted(heavy, of), len(heavy) - 1)
    back = np.where((heavy[at] == of) & (distinct >= 0), np.array(model.heavy_weight)[at], back)
    return np.minimum(1.0, chance[place] + back[place] * lower)


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row``, ``n_tokens``, ``n_known``, ``base_score`` (add-one unigrams) and ``score``, the base-10 logarithm of the text's probability."""
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(model.folder, model.offsets)
        for batch in batches:
            for lo, hi, hashes, sizes in gathered(batch.column(0).field(at)):
                distinct, place = distinct_of(hashes)
                numbers, counts = vocabulary.look_up(distinct)
                lower = word_probabilities(model, numbers)[place]
                ids, counts = numbers[place], counts[place]
                opens = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((counts + 1) / (model.tokens + model.words + 1)), opens)
                score = np.add.reduceat(np.log10(token_probabilities(model, ids, lower, sizes)), opens)
                columns = [sizes, np.add.reduceat((counts > 0).astype(np.int64), opens), base, score]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in columns)], names=schema.names)

    at = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(run, schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents`` under a model of those outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2).select("text"))
    return score_texts(docs, model).select(
        "row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


