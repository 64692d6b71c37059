"""Near duplicates by circulant MinHash, banding and exact verification.

A set's shingles fall on a ring of 2**20 places. A first permutation deals them over the ring; the second is turned by
one place for each coordinate, and a coordinate is the least number that the turned permutation gives the set. So two
permutations make all ``BANDS * ROWS`` coordinates, and a shingle reads them as one stretch of memory. Sets that agree in
all coordinates of a band meet in a bucket.

* Documents of equal sets are one class from the start. A bucket holds each class once, and no bucket gives all its pairs:
  in a few rounds each class is verified with the members that its buckets name as centres, first the best-connected ones,
  of those the ones that most of its buckets name. The components of the links are known then, and only buckets across components go on.
* Of those, buckets of up to ``COLD`` classes give their pairs across components. The classes of larger ones are compared
  without the buckets, by an exact prefix filter: similar sets share one of the smaller one's rarest ninth of shingles, so
  sets that only have a long common passage never meet; pairs whose odd sketches differ too much are dropped, which no link is.
* Pairs are verified on the whole texts (``jaccard.verify``), and components found by star rounds (``jaccard.components``).

A pair of similarity 0.8 is in no common bucket with a probability of (1 - 0.8**5) ** 40, about 1.3e-7, a nearer pair with
less; the texts of all others are compared. Sets that fill much of the ring seem nearer than they are, so they are
compared too often, never too seldom.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing; a null key is
reported with a null component, links with nothing, and ``kept`` is null; rows that repeat a key are each reported, by
their own texts; an empty table gives an empty table; other columns don't take part. Texts of any length are taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.jaccard import components, fingerprints, near_across, sketches, text_sets, verify
from scriptorium.llm.lookup import Lookup, write_lookup
from scriptorium.llm.shared import drop_folder, drop_table, map_file, new_folder, put_file, stored, table
from scriptorium.llm.textscan import mix, ragged

WORDS, PERCENT = 2, 80
BANDS, ROWS = 40, 5
RING_BITS = 20
CHUNK = 1 << 11  # shingles whose coordinates are looked at together
SEEN_SETS = 1 << 18
COLD = 8
ROUNDS, PARTNERS = 3, 3
SLOT_BITS = 20  # slots that shingles are counted in, to tell rare ones


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation of the ring, and at each place of the ring the stretch of the second that its coordinates read."""
    ring = np.arange(1 << RING_BITS, dtype=np.uint64)
    first = np.argsort(mix(ring + np.uint64(0xA24BAED4963EE407))).astype(np.int64)
    second = np.argsort(mix(ring + np.uint64(0x9FB21C651E98DF25))).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: BANDS * ROWS - 1]]), BANDS * ROWS)


def coordinates(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The signature of each row's set; of an empty set, the largest numbers."""
    first, stretch = permutations()
    place = first[(values & np.uint64((1 << RING_BITS) - 1)).astype(np.int64)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(place), CHUNK):
        of = row[lo : lo + CHUNK]
        opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        least = np.minimum.reduceat(stretch[place[lo : lo + CHUNK]], opens, axis=0)
        out[of[opens]] = np.minimum(out[of[opens]], least)  # a row that goes on from the last chunk
    return out


def buckets(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each row in each band."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(key, n, cls, buckets) for each row of (key, text): size and fingerprint of its set, and buckets the first time that a task meets the set under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keyed = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, values, sizes in text_sets(batch.column(1), words):
                cls = fingerprints(values, sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, c in enumerate(cls.tolist()):
                    if sizes[i] and keyed[lo + i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > SEEN_SETS:
                    seen.clear()
                found = buckets(coordinates(values[np.repeat(fresh, sizes)], sizes[fresh]))
                ends = np.concatenate([[0], np.cumsum(np.where(fresh, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(cls, pa.int64()), lists], names=["key", "n", "cls", "buckets"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, cls long, buckets array<long>")


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``shared`` with the component of each class, as far as it is known."""
    if roots is None:
        return shared.withColumn("root", F.col("cls"))
    return shared.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def star_pairs(shared: DataFrame, roots: DataFrame | None, number: int) -> DataFrame:
    """(a, b): each class with those centres of its buckets, of other components, that most of its buckets name.

    At first a bucket's centre is the class that meets most others in all its buckets, as the text that others are copies
    of does; later, one by a hash.
    """
    placed = _rooted(shared, roots)
    first = F.struct(-F.col("met") if number == 0 else F.lit(0), F.xxhash64(F.lit(number), "cls"))
    centre = F.min_by(F.struct(F.col("cls").alias("centre"), F.col("root").alias("its")), first)
    centres = placed.groupBy("grp").agg(centre.alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("grp", "c.*")
    named = placed.join(centres, "grp").where("root <> its").groupBy("cls", "centre").agg(F.count("*").alias("times"))
    best = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("times"), "centre"))  # a class has BANDS centres at most
    return named.withColumn("no", best).where(F.col("no") <= PARTNERS).select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()


def draw_sets(docs: DataFrame, wanted: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) of the classes ``wanted`` (cls), from the texts of their representatives."""
    place = write_lookup(members.join(wanted, "cls", "left_semi").select(F.col("key_hash").alias("key"), F.col("cls").alias("value")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(place)
        for batch in batches:
            row, expected = lookup.find(batch.column(0).to_numpy())
            for lo, hi, values, sizes in text_sets(batch.column(1).take(pa.array(row)), words):
                cls, ends = fingerprints(values, sizes), np.cumsum(sizes)
                right = np.flatnonzero(cls == expected[lo:hi])  # a row that repeats the key may hold another text
                yield pa.RecordBatch.from_arrays([pa.array(cls[right]), pa.array([values[ends[k] - sizes[k] : ends[k]].tobytes() for k in right.tolist()], pa.binary())], names=["cls", "shingles"])

    found = docs.where("key is not null").select(F.xxhash64("key").alias("key_hash"), "text").mapInArrow(run, "cls long, shingles binary")
    out = stored(found.groupBy("cls").agg(F.first("shingles").alias("shingles")), "drawn")
    drop_folder(place[0])
    return out


def prefix_pairs(drawn: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): the pairs across components that share one of their rarest shingles, as every similar pair does, and whose sketches allow a link.

    Similar sets of sizes m <= n have at least p / (100 + p) * (m + n) shingles in common, hence 2 p / (100 + p) * m and
    p / 100 * n. So one of the smaller set's first m - 2 p m / (100 + p) + 1 is among the larger one's first n - p n / 100 + 1.
    Shingles are ordered by how often their slot of a bounded table is hit, then by hash; any one order is right.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(x, np.uint64) >> np.uint64(64 - SLOT_BITS), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "times"])

    spark, folder = drawn.sparkSession, new_folder(drawn.sparkSession, "rarity")
    sums = drawn.select("shingles").mapInArrow(count, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()  # 2 ** SLOT_BITS rows at most
    times = np.zeros(1 << SLOT_BITS, np.int64)
    times[sums.column("slot").to_numpy()] = sums.column("times").to_numpy()
    put_file(f"{folder}/times.bin", [times.tobytes()])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = map_file(f"{folder}/times.bin").view(np.int64)
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            rare = [x[np.lexsort((x, often[x >> np.uint64(64 - SLOT_BITS)]))][: len(x) - -(-percent * len(x) // 100) + 1] for x in sets]
            if sets:
                each, n = np.array([len(x) for x in rare]), np.array([len(x) for x in sets])
                first = ragged(each) <= np.repeat(n + -2 * percent * n // (100 + percent), each)
                columns = np.concatenate(rare).view(np.int64), np.repeat(batch.column(0).to_numpy(), each), np.repeat(n, each), first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["grp", "cls", "n", "first"])

    placed = stored(drawn.mapInArrow(prefix, "grp long, cls long, n long, first boolean"), "prefixes")
    drop_folder(folder)
    shared = placed.groupBy("grp").agg(F.max("first").alias("any"), F.min("cls").alias("x"), F.max("cls").alias("y")).where("any and x <> y").select("grp")
    kept = placed.join(shared, "grp", "left_semi").select(F.col("grp").alias("bucket"), F.lit(0).cast("long").alias("code"), "cls", "n")
    known = drawn.select("cls", F.col("cls").alias("root")).limit(0) if roots is None else roots
    return near_across(kept, draw_sketches(drawn), known, percent).select("a", "b").distinct()


def draw_sketches(drawn: DataFrame) -> DataFrame:
    """(cls, n, sketch) of (cls, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            found = sketches(np.concatenate(sets), n) if sets else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(found, pa.binary())], names=["cls", "n", "sketch"])

    return drawn.select("cls", "shingles").mapInArrow(run, "cls long, n long, sketch binary")


def across(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes of different components and fitting sizes in each group of (grp, cls, root, n)."""
    of = lambda c: placed.select("grp", F.col("cls").alias(c), F.col("root").alias("root_" + c), F.col("n").alias("n_" + c))
    fitting = f"a < b and root_a <> root_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return of("a").join(of("b"), "grp").where(fitting).select("a", "b")


def link_near(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``df``."""
    docs = df.select(df[key].alias("key"), df[text].alias("text"))
    sized = stored(sign(docs, words), "signed")
    members = stored(sized.where("key is not null and n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("key").alias("key")).withColumn("key_hash", F.xxhash64("key")), "members")
    entries = sized.select("cls", F.explode("buckets").alias("grp"))
    crowds = entries.groupBy("grp").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("size")).where("x <> y").select("grp", "size")
    together = stored(entries.join(crowds, "grp").distinct(), "together")
    shared = stored(together.join(together.groupBy("cls").agg(F.sum("size").alias("met")), "cls").select("cls", "grp", "met"), "shared")

    used, roots, tried = [members, together, shared], None, shared.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    settle = lambda pairs: components(verify(pairs, docs, members, words, percent), roots)
    for number in range(ROUNDS):
        pairs = stored(star_pairs(shared, roots, number).join(tried, ["a", "b"], "left_anti"), "stars")
        used.append(pairs)
        if pairs.isEmpty():
            break
        roots, tried = settle(pairs), tried.unionByName(pairs)

    placed = _rooted(shared, roots).join(members.select("cls", "n"), "cls")
    mixed = placed.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("classes")).where("x <> y").select("grp", "classes")
    left = stored(placed.join(mixed, "grp"), "left")
    used.append(left)
    rest = across(left.where(F.col("classes") <= COLD), percent)
    crowd = left.where(F.col("classes") > COLD).select("cls").distinct()
    if not crowd.isEmpty():
        drawn = draw_sets(docs, crowd, members, words)
        used.append(drawn)
        rest = rest.unionByName(prefix_pairs(drawn, roots, percent))
    rest = stored(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = settle(rest)

    named = _rooted(members.select("cls", "key"), roots)
    first = named.groupBy("root").agg(F.min("key").alias("first"))
    of_class = stored(named.join(first, "root").select("cls", "first"), "named")
    for one in (*used, rest):
        drop_table(one)
    own = F.when(F.col("key").isNotNull(), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("key")))
    return sized.drop("buckets").join(of_class, "cls", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("key") == own).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every row of ``documents``, by 2-word shingles of Jaccard similarity 0.8 or more."""
    return link_near(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
         ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), f AS (
  SELECT x, count(*) AS times FROM e GROUP BY x
), o AS (
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY times, x) AS place FROM e JOIN f USING (x)
), r AS (
  SELECT doc_id, n, x FROM o WHERE place <= n - (80 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT p.doc_id AS a, q.doc_id AS b
  FROM r p JOIN r q ON p.x = q.x AND p.doc_id <> q.doc_id AND 100 * p.n >= 80 * q.n AND 100 * q.n >= 80 * p.n
), l AS (
  SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 180 * len(list_intersect(p.sh, q.sh)) >= 80 * (len(p.sh) + len(q.sh))
), t AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT t.a, l.b FROM t JOIN l ON t.b = l.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY a) m USING (doc_id)
"""
