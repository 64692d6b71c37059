"""Exact Jaccard self-join of word-shingle sets by partitioning the universe of shingles.

Two sets of sizes r and s with a similarity of at least 3/4 differ in at most (r + s) // 7 shingles.
Sizes are cut into bands, each with its own largest difference H. For a band, the hash space of
shingles is cut into m segments, of which the first m2 also index their one-deletion neighbourhoods
(:func:`band_plan` chooses m and m2 by expected cost). A segment has weight 1, or 2 with its neighbourhood,
and all weights together exceed H by a slack. By the pigeonhole principle, similar sets share signatures, and
a set can tell a number of them that every similar partner shares at least: the sum of weights, less the
largest difference at its own size, less the weight of its empty segments, which are never indexed.

* So each set may leave out that number, less one, of its signatures. It leaves out the most shared ones, of those
  that more than ``COLD`` sets share, in one order for all sets: of two sets that share more than each leaves out
  from the top of the order, some shared signature is kept by both (the prefix filter).
* A set whose empty segments take up its slack is indexed under another hash as well, up to ``HASHES`` in all. Of
  a pair, either one set fits under some hash, or both are indexed under all and keep their empty segments under the last.
* A pair that no much-shared signature can bring together has to share as many few-shared ones as the sets leave over.

Sets of up to ``SMALL`` shingles are one segment each, with the neighbourhood of all deletions that a similar
partner allows (a quarter of the set): the common part of two similar sets is in both neighbourhoods.

* Signatures are packed by task and bucket before they are shuffled, a set once for each task.
* Few-shared signatures give all their pairs. Shared by many, a signature pairs its sets with their neighbours by
  size at first.
* An odd sketch of 4 to 8 bits a shingle is made of every set in question. Two sets differ in at least as many
  shingles as their sketches do in bits, so that a candidate pair whose sketches differ too much is none, and texts
  are only read for the others.
* A candidate pair is verified on the whole sets. First come the few nearest partners of each set; after the components
  of those links are known, all pairs left between different components: of few-shared signatures, and of much-shared
  ones, whose sets meet block by block with their sketches. No component is paired within itself, and no link between
  components is lost.
* For that, texts are read again, and only those of candidates leave the scan, by a memory-mapped table of groups.
* Components are found by alternating large-star and small-star rounds, each a table in the shared folder that goes when
  the next is whole.

Sets are known by 64-bit fingerprints, and shingles by 64-bit hashes.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing;
documents of equal sets are one class from the start, whatever their number; a null key is reported with a
null component and links with nothing; rows that repeat a key are each reported, by their own texts; an empty
table gives an empty table; other columns don't take part. Texts of any length are taken whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.lookup import Lookup, filter_rows, write_lookup
from scriptorium.llm.shared import drop_folder, drop_table, stored, table
from scriptorium.llm.textscan import SHINGLE_WORDS, hashed_words, mix, ragged, shingle_sets

COLD = 8  # sets that share a signature whose pairs are all taken at once
BAND_RATIO = 1.5
SMALL = 11
HASHES = 4
COMMON = 0.05  # the part of a set's segments that passages shared by many may fill without being indexed
LAST_BAND = 63
FLUSH_ENTRIES = 1 << 21
BUCKET_ENTRIES = 1 << 19
SEEN_SETS = 1 << 18
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
GROUP_SHINGLES = 1 << 15
NEIGHBOURS, PARTNERS = 6, 3


class Plan(NamedTuple):
    number: int
    low: int  # sizes of the band
    high: int
    segments: int
    deletions: int  # segments that index their one-deletion neighbourhoods too


@functools.cache
def band_plan(number: int) -> Plan:
    """The cheapest allocation for a band: the fewest expected signatures of a set, where the slack covers what
    five sets in six of the smallest size leave out for emptiness."""
    low = SMALL + 1
    for _ in range(number):
        low = math.ceil(low * BAND_RATIO)
    high = math.ceil(low * BAND_RATIO) - 1
    most, least_size, size = 2 * high // 7, -(-3 * low // 4), (low + high) / 2
    best = None
    for m in range((most + 1) // 2, 4 * most + 8, max(1, most // 64)):
        for m2 in range(0, m + 1) if most < 40 else range(0, m + 1, max(1, m // 40)):
            if m + m2 > most and all(_fits(n, largest_difference(n, high), m, m2) for n in (least_size, low, high)):
                cost = m * (1 - math.exp(-size / m)) + m2 * size / m
                if best is None or cost < best[0]:
                    best = cost, Plan(number, low, high, m, m2)
                break
    return best[1] if best else Plan(number, low, high, 2 * most + 2, 0)


def largest_difference(n, high):
    """Of a set of size ``n`` and a similar one of up to ``high``."""
    return (n + np.minimum(high, 4 * n // 3)) // 7


def _fits(n: int, most: int, m: int, m2: int) -> bool:
    """Whether five sets in six of size ``n`` have weight to spare for their empty segments and as many much-shared ones as the plan allows for."""
    mean = n / m
    empty = m * (1 - 1 / m) ** n
    spread = math.sqrt(empty * max(0.0, 1 - mean * math.exp(-mean)))
    return m + m2 - most - 1 >= (empty + spread) * (m + m2) / m + m2 * mean * math.exp(-mean) + COMMON * (m + m2)


def band_of(sizes: np.ndarray) -> np.ndarray:
    """The band of each size; -1 for small sets."""
    lows, number = [], 0
    while not lows or lows[-1] <= sizes.max(initial=1):
        lows.append(band_plan(number).low)
        number += 1
    return np.searchsorted(lows, sizes, "right") - 1


def fingerprints(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set, as a signed integer; 0 for an empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5BD1E995)))])
    ends = np.cumsum(sizes)
    out = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(sizes > 0, out, np.uint64(0)).view(np.int64)


def small_signatures(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for rows of small sets: every subset that lacks no more than a quarter."""
    starts, rows, found = np.cumsum(sizes) - sizes, [], []
    for n in range(1, SMALL + 1):
        which = np.flatnonzero(sizes == n)
        if not len(which):
            continue
        each = mix(values[starts[which][:, None] + np.arange(n)] ^ np.uint64(0xA0761D6478BD642F))
        total = each.sum(1, dtype=np.uint64)
        for depth in range(n // 4 + 1):
            for gone in combinations(range(n), depth):
                part = total.copy()
                for i in gone:
                    part -= each[:, i]
                rows.append(which)
                found.append(mix(part + np.uint64(0xE7037ED1A0B428DB)))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def signatures(values: np.ndarray, sizes: np.ndarray, plan: Plan, hash_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, budget) for rows of sets under one hash of a band, and the rows whose empty segments exceed the slack.

    The budget is the number of signatures that the row may leave out: of those that every similar set shares with it, one has to stay.
    It is -1 for rows whose empty segments exceed the slack.
    """
    m, m2 = plan.segments, plan.deletions
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(values + np.uint64(hash_no * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if hash_no else values
    key = row * m + ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    if hash_no:
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    segment = key - row * m
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    each = mix(values ^ np.uint64(0xA0761D6478BD642F))
    total, size = np.add.reduceat(each, opens), np.diff(np.append(opens, len(key)))
    own_row, own_segment = row[opens], segment[opens]
    salt = mix((np.uint64((plan.number + 1) * HASHES + hash_no) << np.uint64(40)) + np.arange(m, dtype=np.uint64))
    two = own_segment < m2
    filled = np.bincount(own_row, minlength=len(sizes))
    filled2 = np.bincount(own_row[two], minlength=len(sizes))
    lone2 = np.bincount(own_row[two & (size == 1)], minlength=len(sizes))
    left_out = (m - m2 - filled + filled2) + 2 * (m2 - filled2) + lone2
    spare = m + m2 - 1 - largest_difference(sizes, plan.high) - left_out
    budget, over = spare // (2 if m2 else 1), spare < 0
    last = over if hash_no == HASHES - 1 else np.zeros(len(sizes), bool)
    rows, found = [own_row], [mix(total + salt[own_segment])]
    if m2:
        inner = np.repeat(np.arange(len(opens)), size)
        take = two[inner] & ((size[inner] > 1) | last[row])
        inner = inner[take]
        rows.append(row[take])
        found.append(mix(total[inner] - each[take] + salt[own_segment[inner]]))
    if last.any():  # these keep their empty segments
        which = np.flatnonzero(last)
        have, number = np.zeros((len(which), m), bool), np.full(len(sizes), -1)
        number[which] = np.arange(len(which))
        mine = last[own_row]
        have[number[own_row[mine]], own_segment[mine]] = True
        r, s = np.nonzero(~have)
        rows.append(which[r])
        found.append(mix(salt[s]))
    at = np.concatenate(rows)
    return at, np.concatenate(found), np.where(over, -1, np.minimum(budget, 32_000))[at].astype(np.int16), np.flatnonzero(over)


def text_sets(column: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first and last row, the distinct shingles of its texts, and the sizes of their sets."""
    for lo, hi, hashes, counts in hashed_words(column):
        yield lo, hi, *shingle_sets(hashes, counts, words)


def classes(docs: DataFrame) -> DataFrame:
    """(key, n, cls) for each row of (key, text): the size and fingerprint of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, sizes in text_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(fingerprints(values, sizes), pa.int64())], names=["key", "n", "cls"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, cls long")


def _indexed(values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(signatures, rows, band and hash in a byte, budgets) of all bands in which rows of sorted sets are indexed."""
    own, starts = band_of(sizes), np.cumsum(sizes) - sizes
    part = lambda rows: values[np.repeat(starts[rows], sizes[rows]) + ragged(sizes[rows])]
    small = np.flatnonzero(sizes <= SMALL)
    if len(small):
        row, sig = small_signatures(part(small), sizes[small])
        yield sig, small[row], 255, np.full(len(sig), -1, np.int16)
    for number in range(max(0, int(own.min())), int(own.max()) + 2):
        rows = np.flatnonzero((own == number) | (own < number) & (4 * sizes >= 3 * band_plan(number).low))
        for hash_no in range(HASHES):
            if not len(rows):
                break
            row, sig, budget, over = signatures(part(rows), sizes[rows], band_plan(number), hash_no)
            yield sig, rows[row], number * HASHES + hash_no, budget
            rows = rows[over]


def signature_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed signature entries by bucket: 6 bytes of hash and band, 8 of class, 2 of budget for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, cls, band, budget = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = (sig % np.uint64(buckets)).astype(np.int32)
            code = ((sig // np.uint64(buckets) & np.uint64((1 << 40) - 1)) << np.uint64(8)) | band.astype(np.uint64)
            order = np.argsort(bucket, kind="stable")
            bucket, cls, budget = bucket[order], cls[order], budget[order]
            code = np.ascontiguousarray(code[order].view(np.uint8).reshape(-1, 8)[:, :6])
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for lo in range(0, len(cuts) - 1, 256):
                spans = list(zip(cuts[lo : lo + 257].tolist(), cuts[lo + 1 : lo + 257].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a]) for a, _ in spans], pa.int32())] + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (code, cls, budget)],
                    names=["bucket", "code", "cls", "budget"],
                )

        for batch in batches:
            for _, _, values, sizes in text_sets(batch.column(0)):
                if not len(values):
                    continue
                cls = fingerprints(values, sizes)
                fresh = np.zeros(len(sizes), bool)
                for i, c in enumerate(cls.tolist()):
                    if sizes[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > SEEN_SETS:
                    seen.clear()
                if not fresh.any():
                    continue
                values, sizes, cls = values[np.repeat(fresh, sizes)], sizes[fresh], cls[fresh]
                for sig, of, band, budget in _indexed(values, sizes):
                    held.append((sig, cls[of], np.full(len(sig), band, np.uint8), budget))
                    count += len(sig)
                if count > FLUSH_ENTRIES:
                    yield from flush()
                    count = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, code binary, cls binary, budget binary")


def _shared(table_: pa.Table) -> pa.Table:
    """Of a bucket's entries: the pairs that few-shared signatures make, with the times they make them; and the entries of the others, whose code isn't -1."""
    column = lambda k: b"".join(table_.column(k).to_pylist())
    cls, budget = np.frombuffer(column("cls"), np.int64), np.frombuffer(column("budget"), np.int16)
    wide = np.zeros((len(cls), 8), np.uint8)
    wide[:, :6] = np.frombuffer(column("code"), np.uint8).reshape(-1, 6)
    code = wide.view(np.uint64).ravel()
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = code[1:] == code[:-1]
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # a signature of one entry pairs nothing
    code, cls, budget = code[keep], cls[order][keep], budget[order][keep]
    order = np.lexsort((cls, code))
    code, cls, budget = code[order], cls[order], budget[order]
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])]) if len(code) else np.zeros(0, bool)
    code, cls, budget = code[fresh], cls[fresh], budget[fresh]
    opens = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    size = np.diff(np.append(opens, len(code)))
    pairs = [np.zeros((0, 5), np.int64)]  # a, b, band, and the budgets of both
    for k in range(2, COLD + 1):
        members = opens[size == k][:, None] + np.arange(k)
        i, j = (members[:, x].ravel() for x in np.triu_indices(k, 1))
        pairs.append(np.stack([cls[i], cls[j], (code[i] & np.uint64(255)).astype(np.int64), budget[i].astype(np.int64), budget[j].astype(np.int64)], 1))
    pairs, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    hot = np.repeat(size > COLD, size)
    bucket = int(table_.column("bucket")[0].as_py())
    n, h = len(pairs), int(hot.sum())
    none = np.zeros(h, np.int64)
    column = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int64))
    return pa.table(
        {
            "a": column(pairs[:, 0], cls[hot]),
            "b": column(pairs[:, 1], none),
            "band": column(pairs[:, 2], (code[hot] & np.uint64(255)).astype(np.int64)),
            "budget_a": column(pairs[:, 3], budget[hot]),
            "budget_b": column(pairs[:, 4], none),
            "times": column(times, np.repeat(size, size)[hot]),
            "bucket": column(np.full(n, bucket), np.full(h, bucket)),
            "code": column(np.full(n, -1), code[hot].astype(np.int64)),
        }
    )


SHARED = "a long, b long, band long, budget_a long, budget_b long, times long, bucket long, code long"


def sketches(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """An odd sketch of each row's set: bit h mod M is the parity of the shingles with that hash, for M of 4 to 8 bits a shingle.

    Two sets differ in at least as many shingles as their sketches differ in bits, so a sketch never hides a similar pair.
    M is a power of two, so that the halves of a sketch, added, are a sketch of half the length.
    """
    words = 1 << np.maximum(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 4, 0)
    ends = np.cumsum(words)
    place = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    bit = (place & np.repeat((words * 64 - 1).astype(np.uint64), sizes)).astype(np.int64)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    np.bitwise_xor.at(flat, np.repeat(ends - words, sizes) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return [flat[x - w : x].tobytes() for x, w in zip(ends.tolist(), words.tolist())]


class Sketches:
    """A column of sketches; :meth:`near` says which of the pairs of its rows, or of its rows and another's, may be similar."""

    def __init__(self, sketch: pa.Array, n: pa.Array):
        sketch = sketch.cast(pa.large_binary())
        _, offsets, data = sketch.buffers()
        at = np.frombuffer(offsets, np.int64)[sketch.offset : sketch.offset + len(sketch) + 1]
        self.first, self.width = at[:-1] // 8, np.diff(at) // 8
        self.data = np.frombuffer(data, np.uint64, at[-1] // 8) if len(sketch) else np.zeros(0, np.uint64)
        self.n = n.to_numpy(zero_copy_only=False)

    def _rows(self, i: np.ndarray, width: int, to: int) -> np.ndarray:
        x = self.data[self.first[i][:, None] + np.arange(width)]
        while width > to:
            width //= 2
            x = x[:, :width] ^ x[:, width:]
        return x

    def near(self, i: np.ndarray, other: Sketches, j: np.ndarray, percent: int = 75) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pairs (i, j) that may be similar, and in how many bits they differ."""
        m, n = self.n[i], other.n[j]
        at = np.flatnonzero((100 * m >= percent * n) & (100 * n >= percent * m))
        shape = self.width[i[at]] << 32 | other.width[j[at]]
        found, off = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for both in np.unique(shape).tolist():
            w, v = both >> 32, both & 0xFFFFFFFF
            mine, step = at[shape == both], max(1, (1 << 18) // max(w, v))
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                d = np.bitwise_count(self._rows(i[part], w, min(w, v)) ^ other._rows(j[part], v, min(w, v))).sum(1, dtype=np.int64)
                ok = d <= (m[part] + n[part]) * (100 - percent) // (100 + percent)
                found.append(part[ok])
                off.append(d[ok])
        return np.concatenate(found), np.concatenate(off)


NEAR = "a long, b long, off long"


def _pairs(cls_i: np.ndarray, cls_j: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls_i, cls_j)), pa.array(np.maximum(cls_i, cls_j)), pa.array(off)], names=["a", "b", "off"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches that are sorted by their first column, cut only where its value changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column(0).to_numpy()
        changes = np.flatnonzero(grp[1:] != grp[:-1])
        last = int(changes[-1]) + 1 if len(changes) else 0
        if held and (last or held[-1].column(0)[-1].as_py() != grp[0]):
            if not last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = [batch]
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table_: pa.Table, name: str) -> pa.Array:
    chunks = table_.column(name)
    return chunks.chunk(0) if chunks.num_chunks == 1 else chunks.combine_chunks()


def near_pairs(pairs: DataFrame, drawn: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, off) for those of the pairs (a, b) whose sketches allow a link; ``drawn`` is (cls, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (Sketches(batch.column("sketch_" + c), batch.column("n_" + c)) for c in "ab")
            each = np.arange(batch.num_rows)
            at, off = a.near(each, b, each, percent)
            yield _pairs(batch.column("a").to_numpy()[at], batch.column("b").to_numpy()[at], off)

    of = lambda c: drawn.select(F.col("cls").alias(c), F.col("n").alias("n_" + c), F.col("sketch").alias("sketch_" + c))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(run, NEAR)


def near_neighbours(kept: DataFrame, drawn: DataFrame) -> DataFrame:
    """(a, b, off) for sets that share a signature of ``kept`` and follow each other by size in its block, where their sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            grp, cls = rows.column("grp").to_numpy(), rows.column("cls").to_numpy()
            own = Sketches(_column(rows, "sketch"), rows.column("n"))
            for step in range(1, NEIGHBOURS + 1):
                i = np.flatnonzero(grp[step:] == grp[:-step])
                at, off = own.near(i, own, i + step)
                yield _pairs(cls[i[at]], cls[i[at] + step], off)

    blocks = _blocks(kept).where("sets > 1")
    placed = kept.join(blocks, ["bucket", "code"]).select("cls", F.xxhash64("bucket", "code", F.pmod(F.xxhash64("cls"), "blocks")).alias("grp"))
    return placed.join(drawn, "cls").select("grp", "cls", "n", "sketch").repartition("grp").sortWithinPartitions("grp", "n", "cls").mapInArrow(run, NEAR)


def near_across(kept: DataFrame, drawn: DataFrame, roots: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, off) for all sets that share a signature of ``kept`` across components, where their sketches allow a link.

    Blocks of a signature's sets meet block by block; no group holds more than two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            grp, cls, root, block, crossed = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "cls", "root", "block", "crossed"))
            own = Sketches(_column(rows, "sketch"), rows.column("n"))
            cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for x in range(lo, hi, 64):
                    i, j = np.nonzero((root[x : min(x + 64, hi), None] != root[None, lo:hi]) & (np.arange(x, min(x + 64, hi))[:, None] < np.arange(lo, hi)))
                    i, j = i + x, j + lo
                    if crossed[lo]:
                        other = block[i] != block[j]
                        i, j = i[other], j[other]
                    at, off = own.near(i, own, j, percent)
                    if len(at):
                        yield _pairs(cls[i[at]], cls[j[at]], off)

    placed = kept.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = placed.groupBy("bucket", "code").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").join(_blocks(kept), ["bucket", "code"])
    met = placed.join(mixed, ["bucket", "code"]).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    grp = F.xxhash64("bucket", "code", F.least("block", "other"), F.greatest("block", "other"))
    dealt = met.select("cls", "root", "block", grp.alias("grp"), (F.col("block") != F.col("other")).alias("crossed"))
    return dealt.join(drawn, "cls").select("grp", "cls", "n", "root", "block", "crossed", "sketch").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, NEAR)


def _blocks(kept: DataFrame) -> DataFrame:
    """(bucket, code, sets, blocks): a block has about ``BLOCK_SETS`` sets, fewer of large ones."""
    cost = F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)
    return kept.groupBy("bucket", "code").agg(F.count("*").alias("sets"), F.ceil(cost).cast("long").alias("blocks"))


def draw(docs: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, n, sketch) of the classes ``wanted`` (cls), from the texts of their representatives."""
    place = write_lookup(members.join(wanted, "cls", "left_semi").select(F.col("key_hash").alias("key"), F.col("cls").alias("value")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(place)
        for batch in batches:
            row, expected = lookup.find(batch.column(0).to_numpy())
            for lo, hi, values, sizes in text_sets(batch.column(1).take(pa.array(row))):
                cls = fingerprints(values, sizes)
                right = np.flatnonzero(cls == expected[lo:hi])  # a row that repeats the key may hold another text
                drawn = sketches(values, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(cls[right]), pa.array(sizes[right], pa.int64()), pa.array([drawn[k] for k in right.tolist()], pa.binary())], names=["cls", "n", "sketch"])

    found = docs.where("key is not null").select(F.xxhash64("key").alias("key_hash"), "text").mapInArrow(run, "cls long, n long, sketch binary")
    out = stored(found.groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    drop_folder(place[0])
    return out


def verify(pairs: DataFrame, docs: DataFrame, members: DataFrame, words: int = SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """Links (a, b) of classes that join what the similar ones of the pairs (a, b) join: those with so many percent of their shingles in common.

    Classes with a common near one are cut into blocks, and a group takes the pairs of two blocks: a text goes once to
    each group that has a pair of it, however many those are. Any cut gives the same components.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("cls"), F.least("a", "b").alias("one"))
    family = least.join(least.select(F.col("cls").alias("one"), F.col("one").alias("two")), "one", "left").select("cls", F.coalesce("two", "one").alias("family"))
    nodes = stored(family.join(members.select("cls", "n", "key_hash"), "cls"), "nodes")
    blocks = nodes.groupBy("family").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("blocks"))
    placed = nodes.join(blocks, "family").select("cls", "key_hash", F.xxhash64("family", F.pmod(F.xxhash64("cls"), "blocks")).alias("block"))
    of = lambda c: placed.select(F.col("cls").alias(c), F.col("key_hash").alias("key_" + c), F.col("block").alias("block_" + c))
    dealt = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    dealt = stored(dealt.select("a", "b", "key_a", "key_b", F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("grp")), "dealt")
    drop_table(nodes)
    groups = write_lookup(dealt.select(F.explode(F.array("key_a", "key_b")).alias("key"), F.col("grp").alias("value")).distinct(), "groups")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(groups)
        for batch in batches:
            row, to = lookup.find(batch.column(0).to_numpy())
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(1).take(pa.array(row))], names=["grp", "text"])

    def links(texts: pa.Table, asked: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for _, _, values, sizes in text_sets(_column(texts, "text"), words):
            ends = np.cumsum(sizes).tolist()
            for c, x, y in zip(fingerprints(values, sizes).tolist(), [0, *ends], ends):
                sets[c] = values[x:y]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                p, q = sets[a], sets[b]
                shared = np.intersect1d(p, q, assume_unique=True).size
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    root[max(x, y)] = min(x, y)
        ends = [(c, find(c)) for c in root]
        return pa.table({"a": pa.array([c for c, r in ends if c != r], pa.int64()), "b": pa.array([r for c, r in ends if c != r], pa.int64())})

    picked = docs.where("key is not null").select(F.xxhash64("key").alias("key_hash"), "text").mapInArrow(pick, "grp long, text string")
    found = stored(picked.groupBy("grp").cogroup(dealt.groupBy("grp")).applyInArrow(links, "a long, b long"), "links")
    drop_folder(groups[0])
    drop_table(dealt)
    return found


def _stars(edges: DataFrame) -> DataFrame:
    """The edges (u, v), v < u, after one round of large stars and small stars."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(cls, root) for each node of the links (a, b) but the least of its component: the least node it can reach. Alternating star rounds until nothing changes.

    With ``roots``, the components of earlier links, the rounds go on from there. A round's table goes when the next is whole.
    """
    if roots is not None:
        links = links.unionByName(roots.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    edges, last = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        last, before = state, edges
        edges = stored(_stars(before), "edges", 2 * state[0])
        drop_table(before)


def link_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``df``."""
    docs = df.select(df[key].alias("key"), df[text].alias("text"))
    sized = stored(classes(docs), "sized")
    keyed = sized.where("key is not null and n > 0")
    members = stored(keyed.groupBy("cls").agg(F.min("n").alias("n"), F.min("key").alias("key")).withColumn("key_hash", F.xxhash64("key")), "members")
    sizes = members.select("cls", "n")
    # about BUCKET_ENTRIES signature entries in a bucket, where a set of n shingles has some n / 3
    entries = sizes.agg(F.sum(F.col("n") / 3 + 8)).first()[0] or 0
    blocks = signature_blocks(docs.where("key is not null"), max(1, math.ceil(entries / BUCKET_ENTRIES)))
    shared = stored(blocks.groupBy("bucket").applyInArrow(_shared, SHARED), "shared")

    # of its much-shared signatures under a band and hash, each set leaves out the most shared ones that it may
    order = Window.partitionBy("cls", "band").orderBy(F.desc("times"), "bucket", "code")
    hot = shared.where("code <> -1").select("bucket", "code", "band", F.col("a").alias("cls"), F.col("budget_a").alias("budget"), "times")
    kept = stored(hot.withColumn("no", F.row_number().over(order)).where("no > budget").select("bucket", "code", "cls").join(sizes, "cls"), "kept")

    # few-shared signatures count in the band of the larger set, where both are indexed
    lows = [band_plan(k).low for k in range(LAST_BAND)]
    larger = F.greatest("n_a", "n_b")
    own = F.when(larger <= SMALL, LAST_BAND).otherwise(F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in lows]), lambda x: x <= larger)) - 1)
    summed = shared.where("code = -1").groupBy("a", "b", "band", "budget_a", "budget_b").agg(F.sum("times").alias("times"))
    # a class comes with its size and how many much-shared signatures it has by band
    crowd = hot.groupBy("cls", "band").agg(F.count("*").alias("many")).groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("band", "many"))).alias("crowd"))
    known = sizes.join(crowd, "cls", "left")
    of = lambda c: known.select(F.col("cls").alias(c), F.col("n").alias("n_" + c), F.col("crowd").alias("crowd_" + c))
    fitting = summed.join(of("a"), "a").join(of("b"), "b").where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    many = lambda c: F.coalesce(F.try_element_at("crowd_" + c, F.col("band")), F.lit(0)).alias("many_" + c)
    cold = fitting.where(F.floor(F.col("band") / HASHES) == own).select("a", "b", "times", "budget_a", "budget_b", many("a"), many("b"))
    gone = lambda c: F.least(F.greatest(F.col("budget_" + c), F.lit(0)), F.col("many_" + c))
    # what either set leaves out is the top of one order, so that the longer of both tops holds all shared ones left out
    enough = F.greatest("budget_a", "budget_b") + 1 - F.greatest(gone("a"), gone("b"))
    both_keep = (F.col("many_a") > F.col("budget_a")) & (F.col("many_b") > F.col("budget_b")) & (F.col("many_a") > 0) & (F.col("many_b") > 0)
    cold = stored(cold.where(both_keep | (F.col("times") >= enough)).select("a", "b").distinct(), "cold")
    drop_table(shared)

    wanted = kept.select("cls").unionByName(cold.select(F.explode(F.array("a", "b")).alias("cls"))).distinct()
    drawn = draw(docs, wanted, members)
    close = stored(near_pairs(cold, drawn), "close")
    found = close.unionByName(near_neighbours(kept, drawn)).groupBy("a", "b").agg(F.min("off").alias("off"))

    # a few of the nearest partners of each set make most components; then all pairs left between components are verified
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("off", "a", "b"))
    ends = found.select("a", "b", "off", F.explode(F.array("a", "b")).alias("cls"))
    tried = stored(ends.withColumn("no", rank).where(F.col("no") <= PARTNERS).select("a", "b").distinct(), "tried")
    roots = components(verify(tried, docs, members))
    at = lambda c: roots.select(F.col("cls").alias(c), F.col("root").alias("root_" + c))
    apart = close.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = apart.unionByName(near_across(kept, drawn, roots).select("a", "b")).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = components(verify(rest, docs, members), roots)
    for used in (cold, kept, drawn, close, tried, rest):
        drop_table(used)

    named = members.join(roots, "cls", "left").select("cls", "key", F.coalesce("root", "cls").alias("root"))
    first = named.groupBy("root").agg(F.min("key").alias("first"))
    of_class = named.join(first, "root").select("cls", "first")
    out = sized.join(of_class, "cls", "left")
    own = F.when(F.col("key").isNotNull(), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("key")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df``, less all but one of each group of linked rows; every row is a document of its own, whatever its columns hold.

    Rows are known by a number that one job writes beside them to a table in the shared folder: later jobs may plan the
    scan of ``df`` in other partitions, and numbers made anew there would name other rows.
    """
    numbered = stored(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")
    packed = numbered.select("row", F.col("row")[text].alias("text"), "place")
    gone = link_documents(packed, "place").where("component_id <> place")
    place = write_lookup(gone.select(F.col("place").alias("key"), F.col("component_id").alias("value")), "gone")
    return filter_rows(packed.select("row", "place"), "place", place, keep=False).select("row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every row of ``documents`` under links of Jaccard similarity 0.75 or more on 5-word shingles."""
    return link_documents(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), l AS (
  SELECT p.doc_id AS a, q.doc_id AS b
  FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id
  GROUP BY p.doc_id, q.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
