"""Word and bigram counts of a corpus, in shards of a shared folder.

Words are known by 64-bit hashes. A shard of the vocabulary holds a range of hashes, so that the
shards in order are one sorted vocabulary, and a word's number is its place in it. Tasks count their
own words and bigrams first and send packed partial counts, a row for each shard. The bigrams of a
context are in the shard of its word; those of a context with more than its fair share of all
tokens are dealt out over all shards by their own hash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from scriptorium.llm.eliasfano import Monotone, pack_monotone
from scriptorium.llm.shared import map_file, put_file
from scriptorium.llm.textscan import hashed_words, mix

END = np.uint64(0x9AE16A3B2F90404F)  # the token after a text's last word
HELD = 1 << 20  # distinct entries that a task gathers before it sends them
SHARD_BYTES = 16 << 20  # of text, for which there is about a shard
PACKED = "shard int, keys binary, counts binary"
SLICES = 3  # of texts whose words are looked up together


def count_shards(texts: DataFrame) -> int:
    """How many shards the counts of a one-column frame of texts take: by the size of the texts, and at least as many as shuffles have partitions."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES))


def vocabulary_offsets(stats: dict[int, Row], shards: int) -> tuple[int, ...]:
    """The number of each shard's first word, and of all words; from the rows that :func:`count_words` gave."""
    offsets = tuple(np.cumsum([0, *(stats[k].words if k in stats else 0 for k in range(shards))]).tolist())
    if offsets[-1] >= 1 << 32:
        raise ValueError(f"{offsets[-1]} distinct words, more than 32 bits can number")
    return offsets


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first and last row, the token hashes with an END after each text, and tokens by row."""
    for lo, hi, words, counts in hashed_words(column):
        ends = np.cumsum(counts)
        yield lo, hi, np.insert(words, ends, END), counts + 1


def gathered(column: pa.Array, slices: int = SLICES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What :func:`tokens` gives, for up to ``slices`` slices at once: each shard is asked once for the words of all of them."""
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for part in tokens(column):
        held.append(part)
        if len(held) == slices:
            yield held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            held = []
    if held:
        yield held[0][0], held[-1][1], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them: only the distinct ones are sorted."""
    codes, found = pd.factorize(keys)
    found = np.asarray(found)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[codes]


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    # counts of up to 254 take a byte; the rest follow, whole
    small = np.minimum(counts, 255).astype(np.uint8)
    tails = [counts[a:b][small[a:b] == 255].tobytes() for a, b in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([small[a:b].tobytes() + t for (a, b), t in zip(spans, tails)], pa.binary())],
        names=["shard", "keys", "counts"],
    )


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a shard, sorted, and their whole counts."""
    keys, counts = [], []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        keys.append(np.frombuffer(k, np.uint64))
        n = np.frombuffer(c, np.uint8, len(keys[-1])).astype(np.int64)
        n[n == 255] = np.frombuffer(c, np.int64, offset=len(keys[-1]))
        counts.append(n)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[opens], np.add.reduceat(count, opens)


def _gather(parts: Iterator[tuple[np.ndarray, np.ndarray]], shard: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        key, count = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return _packed(shard(key[opens]), key[opens], np.add.reduceat(count, opens))

    for keys, counts in parts:
        if len(keys):
            held.append((keys, counts))
            size += len(keys)
        if size > 2 * HELD:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    return np.asarray(distinct, np.uint64), np.bincount(codes, minlength=len(distinct))


class Vocabulary:
    """Numbers and counts of words, from the shards in ``folder``."""

    def __init__(self, folder: str, offsets: tuple[int, ...]):
        self.folder, self.offsets, self.shards = folder, np.array(offsets, np.int64), len(offsets) - 1
        self._open: dict[int, tuple[Monotone, Monotone]] = {}

    def _shard(self, k: int) -> tuple[Monotone, Monotone]:
        """The words of a shard, and the running sums of their counts."""
        if k not in self._open:
            data = map_file(f"{self.folder}/words-{k:05d}.bin")
            words = Monotone(data)
            self._open[k] = words, Monotone(data, words.end + -words.end % 8)
        return self._open[k]

    def counts_of(self, k: int) -> np.ndarray:
        sums = self._shard(k)[1]
        return np.diff(sums.get(np.arange(sums.n)).astype(np.int64))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each word; ``hashes`` are sorted."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = shard_of(hashes, self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if self.offsets[k + 1] > self.offsets[k]:
                words, sums = self._shard(k)
                part = slice(cuts[k], cuts[k + 1])
                at = words.find(hashes[part] - shard_low(k, self.shards))
                known = at >= 0
                ids[part] = np.where(known, at + self.offsets[k], -1)
                at = np.maximum(at, 0)
                counts[part] = np.where(known, (sums.get(at + 1) - sums.get(at)).astype(np.int64), 0)
        return ids, counts


def shard_low(k: int, shards: int) -> np.uint64:
    """The least hash of a shard."""
    return np.uint64(-(-(k << 24) // shards) << 40)


@functools.lru_cache(maxsize=2)
def open_vocabulary(folder: str, offsets: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(folder, offsets)


def count_words(texts: DataFrame, folder: str, shards: int) -> list[Row]:
    """Writes the vocabulary of a one-column frame of texts into ``folder``; a row for each shard: words, tokens and once-counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather((counted(t) for batch in batches for _, _, t, _ in tokens(batch.column(0))), lambda k: shard_of(k, shards))

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = merged(table)
        low = shard_low(shard, shards)
        universe = int(shard_low(shard + 1, shards) - low) if shard + 1 < shards else (1 << 64) - int(low)
        sums = np.concatenate([[0], np.cumsum(counts)])
        pieces = [pack_monotone(keys - low, universe), pack_monotone(sums, int(sums[-1]) + 1)]
        put_file(f"{folder}/words-{shard:05d}.bin", [x + b"\0" * (-len(x) % 8) for x in pieces])
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})

    packed = texts.mapInArrow(run, PACKED)
    return packed.groupBy("shard").applyInArrow(write, "shard int, words long, tokens long, once long, twice long").collect()  # a row for each shard


def pairs_of(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """(context << 32 | word) of each token, for texts of ``sizes`` tokens; the first token's context is ``start``, -1 is unknown."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    firsts = np.cumsum(sizes) - sizes
    context[firsts] = start
    return np.where((context < 0) | (ids < 0), -1, context << 32 | ids)


def pair_shard(pairs: np.ndarray, offsets: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The shard of each pair: its context's, or for the sorted ``heavy`` contexts one by the pair's own hash."""
    context = (pairs >> np.uint64(32)).astype(np.int64)
    own = np.minimum(np.searchsorted(offsets, context, "right") - 1, len(offsets) - 2)
    spread = (mix(pairs) >> np.uint64(33)).astype(np.int64) % (len(offsets) - 1)
    if not len(heavy):
        return own
    at = np.minimum(np.searchsorted(heavy, context), len(heavy) - 1)
    return np.where(heavy[at] == context, spread, own)


def count_pairs(texts: DataFrame, folder: str, offsets: tuple[int, ...], heavy: tuple[int, ...]) -> DataFrame:
    """Packed bigram counts by shard, for a one-column frame of texts whose vocabulary is in ``folder``. Numbers stay below 2**32."""
    cuts, many, start = np.array(offsets), np.array(heavy, np.int64), offsets[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = open_vocabulary(folder, offsets)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, _, hashes, sizes in gathered(batch.column(0)):
                    distinct, place = distinct_of(hashes)
                    ids = vocabulary.look_up(distinct)[0][place]
                    yield counted(pairs_of(ids, sizes, start).astype(np.uint64))

        yield from _gather(parts(), lambda k: pair_shard(k, cuts, many))

    return texts.mapInArrow(run, PACKED)
