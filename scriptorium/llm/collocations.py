"""Phrases of words that keep company, by hash-pruned passes over the corpus (PCY, with DHP's pruning of the next length).

Pass k counts the candidate phrases of k words exactly and, in the same scan, adds the phrases of k + 1 words up in
hash buckets. A phrase is a candidate of pass k if its first and its last k - 1 words are both frequent (Apriori) and its
bucket reached the support (the bitmap of pass k - 1); in pass 1 every word is one. Only phrases whose two parts are
candidates go to the buckets. Bitmaps and Apriori only leave out what can't be frequent; counts are exact.

* Tasks add up their own slices first. Buckets travel packed: sorted places as differences, counts cut at the support,
  one row for each range of places.
* A bitmap takes a bit for every 16 bytes of text, at most ``MOST_BITS`` (128 MB), and lies in one file of the
  shared folder that tasks memory-map. Beyond that size buckets fill up, and Apriori alone prunes.
* Scores and the test of longer phrases are joins by phrase. The best of a language are picked in salted shares first.

Within a task phrases are told apart by 64-bit hashes, between tasks by their text.

Defined results: a null or empty text has no words; a null language counts as ``und``, together with rows that say so;
repeated rows and ids count as often as they occur; nulls elsewhere and other columns don't matter; ties go to the
phrase that comes first in UTF-8; texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.shared import drop_folder, drop_table, lean, map_file, new_folder, put_file, stored, table
from scriptorium.llm.textscan import lower, mix, ragged, slices, utf8, word_hashes, word_spans

SUPPORT = 30
LONGEST = 4
COVERED = 80  # percent of a phrase's occurrences within a longer one that make it redundant
BEST = 2000
SHARES = 16
BYTES_PER_BIT, LEAST_BITS, MOST_BITS = 16, 16, 30
RANGE_BITS = 20  # places of a bitmap that one task adds up
HELD_PHRASES, HELD_PLACES = 1 << 18, 1 << 22

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LETTER = ~_BREAK
_LETTER[[0x20, 0x09]] = False


class Phrases:
    """The words of a slice of rows, and the hashes of its phrases by length."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        self.data = lower(data)
        self.starts, self.ends, counts = word_spans(self.data, offsets, _LETTER)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.hashes = [mix(self.words + languages[self.row])]  # by length
        piece = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.whole = [np.ones(len(self.starts), bool), (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])]

    def hash_of(self, k: int) -> np.ndarray:
        """For each word that k - 1 follow in the slice, the hash of the phrase that it opens."""
        while len(self.hashes) < k:
            n = len(self.hashes)
            self.hashes.append(mix(self.hashes[-1][: max(0, len(self.words) - n)] + self.words[n:]))
        return self.hashes[k - 1]

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that open at the words ``at``, joined by a space."""
        parts = []
        for i in range(k):
            start, size = self.starts[at + i], self.ends[at + i] - self.starts[at + i]
            flat = self.data[np.repeat(start, size) + ragged(size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            parts.append(pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(flat)))
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]).cast(pa.string())


class Bitmap:
    """Marks of 64-bit hashes, by their highest bits."""

    def __init__(self, uri: str, bits: int):
        self.marks, self.bits = map_file(uri), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


@functools.lru_cache(maxsize=2)
def open_bitmap(uri: str, bits: int) -> Bitmap:
    return Bitmap(uri, bits)


def _planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte, lowest bytes first, so that compression finds the zeros."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, where each is found first, and its whole count."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    opens = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(opens, len(keys))) if counts is None else np.add.reduceat(counts[order], opens) if len(keys) else counts
    return sorted_[opens], order[opens], total


PACKED = "range int, places binary, counts binary"
COUNTED = f"lang string, phrase string, hash long, a long, {PACKED}"


def _packed_rows(places: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Sorted places and their counts, as columns of PACKED."""
    of = (places >> np.uint64(RANGE_BITS)).astype(np.int64)
    low = (places & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])).tolist() if len(of) else [0]
    spans = list(zip(cuts[:-1], cuts[1:]))
    return [
        pa.array([int(of[x]) for x, _ in spans], pa.int32()),
        pa.array([_planes(np.diff(low[x:y], prepend=0)) for x, y in spans], pa.binary()),
        pa.array([_planes(counts[x:y]) for x, y in spans], pa.binary()),
    ]


def _rows_of(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("a", pa.int64()), ("range", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


def count_pass(docs: DataFrame, k: int, bits: int, support: int, last: bool, frequent: str | None = None, hopeful: str | None = None, most: tuple[int, int] = (HELD_PHRASES, HELD_PLACES)) -> DataFrame:
    """Rows of COUNTED: the phrases of k words that each task counted, and packed buckets of those of k + 1; in pass 1 also all words by language, with no phrase. A task sends on what it holds beyond ``most`` phrases and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        parts = open_bitmap(frequent, bits) if frequent else None
        buckets = open_bitmap(hopeful, bits) if hopeful else None
        phrases: list[tuple] = []
        places: list[tuple] = []
        held = [0, 0]

        def send_phrases() -> Iterator[pa.RecordBatch]:
            if phrases:
                keys, counts = (np.concatenate([p[i] for p in phrases]) for i in (0, 1))
                key, first, total = _distinct(keys, counts)
                at = pa.array(first)
                lang, text = (pa.chunked_array([p[i] for p in phrases]).combine_chunks().take(at) for i in (2, 3))
                yield _rows_of(_SCHEMA, {"lang": lang, "phrase": text, "hash": pa.array(key.view(np.int64)), "a": pa.array(total)})
                phrases.clear()
            held[0] = 0

        def send_places() -> Iterator[pa.RecordBatch]:
            if places:
                keys, counts = (np.concatenate([p[i] for p in places]) for i in (0, 1))
                key, _, total = _distinct(keys, counts)
                columns = _packed_rows(key, np.minimum(total, support))
                yield _rows_of(_SCHEMA, dict(zip(("range", "places", "counts"), columns)))
                places.clear()
            held[1] = 0

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            lang = batch.column(1).fill_null("und").dictionary_encode()
            names, code = lang.dictionary, lang.indices.to_numpy()
            names_data, names_at = utf8(names)
            salt = mix(word_hashes(names_data, names_at[:-1], names_at[1:]))  # mixed once more: a language may be spelt like a word
            if k == 1:
                totals = np.zeros(len(names), np.int64)
            for lo, hi in slices(offsets):
                found = Phrases(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], salt[code[lo:hi]])
                own = code[lo:hi][found.row]
                if k == 1:
                    totals += np.bincount(own, minlength=len(names))
                    good = found.whole[0]
                else:
                    shorter = parts.has(found.hash_of(k - 1))
                    good = shorter[:-1] & shorter[1:] & _joined(found, k)
                    if good.any():
                        good[good] = buckets.has(found.hash_of(k)[good])
                at = np.flatnonzero(good)
                if len(at):
                    key, first, count = _distinct(found.hash_of(k)[at])
                    phrases.append((key, count, names.take(pa.array(own[at[first]])), found.text(at[first], k)))
                    held[0] += len(key)
                if not last and len(at):
                    longer = at[:-1][(at[1:] == at[:-1] + 1) & _joined(found, k + 1)[at[:-1]]] if len(found.words) > k else at[:0]
                    place, _, count = _distinct(found.hash_of(k + 1)[longer] >> np.uint64(64 - bits))
                    places.append((place, count))
                    held[1] += len(place)
                if held[0] > most[0]:
                    yield from send_phrases()
                if held[1] > most[1]:
                    yield from send_places()
            if k == 1:
                yield _rows_of(_SCHEMA, {"lang": names, "a": pa.array(totals)})
        yield from send_phrases()
        yield from send_places()

    return docs.mapInArrow(run, COUNTED)


def _joined(found: Phrases, k: int) -> np.ndarray:
    """For each word that k - 1 follow in the slice, whether they are in one piece with it."""
    while len(found.whole) < k:
        found.whole.append(found.whole[-1][:-1] & found.whole[1][len(found.whole) - 1 :])
    return found.whole[k - 1]


def write_bitmap(packed: DataFrame, folder: str, name: str, bits: int, support: int) -> str:
    """Marks the places of PACKED whose counts add up to the support; one file in the folder."""
    spark, ranges, size = packed.sparkSession, 1 << bits - min(bits, RANGE_BITS), 1 << min(bits, RANGE_BITS)

    def add_up(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for places, counts in zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist()):
            if places:
                total[np.cumsum(_numbers(places))] += _numbers(counts)  # a place occurs once in a row
        put_file(f"{folder}/{name}-{rows.column('range')[0].as_py():05d}.bin", [np.packbits(total >= support, bitorder="little").tobytes()])
        return rows.slice(0, 1).select(["range"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                put_file(f"{folder}/{name}.bin", (map_file(f"{folder}/{name}-{r:05d}.bin").tobytes() for r in range(ranges)))
            yield batch

    # a range without entries has a file too, so that a missing one is an error
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("counts"))
    packed.select("range", "places", "counts").unionByName(every).groupBy("range").applyInArrow(add_up, "range int").count()
    spark.range(1, numPartitions=1).mapInArrow(join, "id long").count()  # MOST_BITS bound what this task copies
    return f"{folder}/{name}.bin"


def mark(hashes: DataFrame, bits: int, support: int) -> DataFrame:
    """Rows of PACKED that mark every hash of a one-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays(_packed_rows(place, np.full(len(place), support)), names=["range", "places", "counts"])

    return hashes.mapInArrow(run, PACKED)


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) for every phrase of up to ``longest`` words that occurs ``support`` times or more, and (lang, n) of all words."""
    spark, docs = df.sparkSession, df.select(df[text].alias("text"), df[lang].alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BIT).bit_length()))
    folder, found, words = new_folder(spark, "bitmaps"), [], None
    frequent = hopeful = None
    for k in range(1, longest + 1):
        raw = stored(count_pass(docs, k, bits, support, k == longest, frequent, hopeful), "pass")
        counted = raw.where("lang is not null").groupBy("lang", "phrase").agg(F.sum("a").alias("a"), F.min("hash").alias("hash"))
        kept = stored(counted.where((F.col("a") >= support) | F.col("phrase").isNull()), "phrases")
        if k == 1:
            words = kept.where("phrase is null and a > 0").select("lang", F.col("a").alias("n"))
        found.append(kept.where("phrase is not null").select("lang", "phrase", F.lit(k).alias("k"), "a"))
        if k < longest:
            frequent = write_bitmap(mark(kept.where("phrase is not null").select("hash"), bits, support), folder, f"frequent-{k}", bits, support)
            hopeful = write_bitmap(raw.where("range is not null"), folder, f"hopeful-{k + 1}", bits, support)
        drop_table(raw)
    drop_folder(folder)
    return functools.reduce(DataFrame.unionByName, found), words


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, scored by their weakest cut."""
    found, words = frequent_phrases(df, text, lang, support, longest)
    longer = found.where("k >= 2").withColumn("words", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = longer.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    count_of = lambda key, name: found.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    scored = cuts.join(count_of("first", "l"), ["lang", "first"]).join(count_of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div cast(l + r as decimal(20, 0))")
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))

    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    within = longer.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    covered = F.col("over").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * COVERED
    left = weakest.join(within, ["lang", "phrase"], "left").where(F.col("over").isNull() | ~covered)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    plain = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share"))
    few = plain.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), o AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM o GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), g AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 30
), c AS (
  SELECT x.lang, x.phrase, x.a, x.k, x.w, x.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM g WHERE k >= 2) x
  JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
  JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')
), b AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), s AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM g, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2
), q AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase
  WHERE s.over IS NULL OR 100::HUGEINT * s.over < 80::HUGEINT * b.a
)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n ON n.lang = q.lang WHERE q.rank <= 2000
"""
