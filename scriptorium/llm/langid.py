"""Language identification by hierarchical discrimination.

A text's family is predicted first; one-versus-one linear support vector machines then
separate the languages of that family. Features are hashed byte 1-, 2- and 3-grams of the
lower-cased letters (all other characters count as a space), square-rooted and normalised.

``fit`` learns from a bounded sample, ``SAMPLE_PER_LANGUAGE`` labelled texts of each of at most ``LANGUAGES``
languages, those with the smallest hash of their key, one text for each key. Feature vectors are made by the
executors from whole texts; the driver gets at most that many vectors of ``DIMENSIONS`` numbers and solves
the small squared-hinge problems.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every
text when nothing could be learned; a language outside ``FAMILIES`` is a family of its own;
repeated rows are predicted alike; rows with a null key are never learned from; an empty
table gives an empty table; other columns are carried along untouched in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from scriptorium.llm.shared import drop_table, lean, stored, table
from scriptorium.llm.textscan import slices, utf8

SAMPLE_PER_LANGUAGE = 1000
LANGUAGES = 200
SLICE_ROWS = 512
DIMENSIONS = 2048
STEEPNESS = 6.0  # of the logistic curve that turns a margin into a score
# Families of the languages that the corpus may hold.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg"),
}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector for each row of text; zeros where a row has no bytes."""
    rows = len(offsets) - 1
    letters = _LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets)) * DIMENSIONS
    counts, code = np.zeros(rows * DIMENSIONS), letters.copy()
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] << np.uint32(8) | letters[n - 1 :]
        if not len(code):
            break
        inside = row[: len(code)] == row[n - 1 :]
        inside &= letters[n - 1 :] + letters[: len(code)] != 64  # no n-gram from space to space
        at = row[: len(code)] + (((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> _SHIFT)
        counts += np.bincount(at[inside], minlength=len(counts))
    out = np.sqrt(counts.reshape(rows, DIMENSIONS))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _machine(x: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 300) -> np.ndarray:
    """The weights of a linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * cost * 2
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1 / (1 + 2 * top)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - step * (ahead - 2 * x.T @ (share * sign * slack))
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _duel(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won duels for each row, ties to the larger sum of margins, and the winner's least score."""
        if len(names) < 2 or not len(x):
            return np.zeros(len(x), np.int64), np.ones(len(x))
        wins, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        worst = np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[a, b]
            margin = x @ w[:-1] + w[-1]
            for k, m in ((i, margin), (j, -margin)):
                wins[:, k] += m > 0
                total[:, k] += m
                worst[:, k] = np.minimum(worst[:, k], m)
        best = (wins * 1e6 + total).argmax(1)
        return best, 1 / (1 + np.exp(-STEEPNESS * worst[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(x), "und", object), np.zeros(len(x))
        if not self.families:
            return names.tolist(), scores
        family, sure = self._duel(x, self.families)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            best, inner = self._duel(x[rows], self.languages[name])
            names[rows] = np.array(self.languages[name], object)[best]
            scores[rows] = sure[rows] * inner
        return names.tolist(), scores


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for lo, hi in slices(offsets, most=SLICE_ROWS):
            x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            packed = pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), packed], names=["key", "lang", "x"])


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from the rows of ``df`` that have a key, a language and some text."""
    labelled = df.select(df[key].alias("key"), df[lang].alias("lang"), df[text].alias("text")).where("key is not null and lang is not null and text is not null and text <> ''")
    version = F.xxhash64("text")
    keys = stored(labelled.groupBy("lang", "key").agg(F.min(version).alias("version")), "keys")
    many = keys.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(many) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")
    # a bar on the hash leaves little more than the sample of each language to be ranked
    bar, bars = sample + 8 * sample**0.5 + 32, F.lit(1.0)
    for row in many:
        bars = F.when(F.col("lang") == row.lang, bar / row["count"]).otherwise(bars)
    passed = keys.where(F.xxhash64("key") / 2.0**64 + 0.5 <= bars)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = passed.withColumn("no", F.row_number().over(first)).where(F.col("no") <= sample).select("lang", "key", "version")  # at most `sample` times LANGUAGES rows
    rows = labelled.withColumn("version", version).join(F.broadcast(chosen), ["key", "lang", "version"], "left_semi")
    vectors = rows.select("key", "lang", "text").mapInArrow(_vectors, "key " + labelled.schema["key"].dataType.simpleString() + ", lang string, x binary")
    found = sorted(((r.lang, r.key, bytes(r.x)) for r in vectors.groupBy("lang", "key").agg(F.first("x").alias("x")).toLocalIterator()))
    drop_table(keys)
    model = Model()
    if not found:
        return model
    x = np.array([np.frombuffer(v, "<f4") for *_, v in found], np.float64)
    named = np.array([n for n, *_ in found])
    kin = np.array([family_of(n) for n in named])
    model.families = sorted(set(kin))
    groups = [(model.families, kin)]
    for name in model.families:
        model.languages[name] = sorted(set(named[kin == name]))
        groups.append((model.languages[name], named))
    for names, of in groups:
        for a, b in combinations(names, 2):
            pair = (of == a) | (of == b)
            model.machines[a, b] = _machine(x[pair], np.where(of[pair] == a, 1.0, -1.0))
    return model


def predict_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` (0 to 1) for every row, from its whole text."""
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows = batch.column(0)
            data, offsets = utf8(rows.field(place))
            for lo, hi in slices(offsets, most=SLICE_ROWS):
                part, edges = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                names, scores = model.predict(features(part, edges))
                seen = np.concatenate([[0], np.cumsum((_LETTER[part] != 32) & (part < 128))])
                plain = seen[edges[1:]] > seen[edges[:-1]]  # a letter of A-Z
                for i in np.flatnonzero(~plain).tolist():
                    if not has_letter(part[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace")):
                        names[i], scores[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    place = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(run, schema)


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from the texts outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
