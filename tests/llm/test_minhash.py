"""Circulant MinHash near duplicates against all pairs, and on awkward rows."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import minhash
from scriptorium.llm.textscan import mix

SCHEMA = "doc_id long, text string, cls string, root string, grp string, n string, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    """(key, size, component, kept) of rows with distinct keys, by a shared rare shingle and then by whole sets."""
    sets = {k: shingle_set(t) for k, t in rows}
    often, by = defaultdict(int), defaultdict(list)
    for s in set(sets.values()):
        for x in s:
            often[x] += 1
    root = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    same = defaultdict(list)
    for k, s in sets.items():
        same[s].append(k)
    for s, keys in same.items():
        if s:
            for k in keys:
                root[k] = min(keys)
    done = set()
    for s, keys in sorted(same.items(), key=lambda x: min(x[1])):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]:
            for t in by[x]:
                if (s, t) not in done:
                    done.add((s, t))
                    if 100 * len(s & t) >= percent * len(s | t):
                        a, b = find(min(keys)), find(min(same[t]))
                        root[max(a, b)] = min(a, b)
            by[x].append(s)
    return [(k, len(s), find(k), find(k) == k) for k, s in sets.items()]


def family(rng, n, words, common, own):
    """Texts that share a passage and have words of their own."""
    passage = [f"w{x}" for x in rng.integers(0, 5000, common)]
    return [" ".join(passage + [f"u{k}x{x}" for x in range(own)]) for k in range(n)]


def texts():
    rng = np.random.default_rng(11)
    out = []
    for k in range(60):
        base = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(1, 120)))]
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            for at in rng.integers(0, len(copy), max(1, len(copy) // 18)):
                copy[at] = f"z{rng.integers(0, 50)}"
            out.append((" " * int(rng.integers(1, 3))).join(copy).upper())
    out += [" ".join(f"c{x}" for x in range(k, k + 100)) for k in range(0, 300, 5)]  # a chain: only neighbours are alike
    out += family(rng, 40, 100, 80, 20) + family(rng, 40, 100, 95, 5)
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(k, t, "c", "r", "g", "n", "k") for k, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, minhash.link_near(frame, **options).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = list(enumerate(texts())) + [(2000, None), (2001, ""), (2002, "\t\n "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "a b " * 30_000), (2007, "a  b " * 20_000 + "c")]
    want = sorted(brute(rows), key=repr)
    assert len({r[2] for r in want}) < len(rows) - 150
    assert found(spark, rows) == want


def test_a_large_bucket_gives_no_pairs_of_unlike_texts(spark):
    """Texts with a long passage in common and no link share buckets, but none of their rarest shingles."""
    rows = list(enumerate(family(np.random.default_rng(12), 600, 100, 86, 14)))
    assert not [r for r in found(spark, rows) if not r[3]]
    frame = spark.createDataFrame([(k, mix(np.array([hash(x) & (1 << 63) - 1 for x in shingle_set(t)], np.uint64)).tobytes()) for k, t in rows], "cls long, shingles binary")
    assert minhash.prefix_pairs(frame, None, 80).count() < 60


def test_null_and_repeated_keys(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (None, "a b c d e"), (3, "p q r s t"), (3, "p q r s t"), (0, "a b c d e")]
    assert found(spark, rows) == sorted([(1, 4, 0, False), (1, 4, 1, True), (None, 4, None, None), (3, 4, 1, False), (3, 4, 1, False), (0, 4, 0, True)], key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_link(spark, rows):
    assert found(spark, rows) == [(k, 0, k, True) for k, _ in rows]


def test_coordinates_are_least_of_turned_permutation():
    first, stretch = minhash.permutations()
    second, size = stretch[:, 0], 1 << minhash.RING_BITS
    assert sorted(first[:10].tolist()) != list(range(10)) and len(np.unique(first)) == len(np.unique(second)) == size
    rng = np.random.default_rng(13)
    values = mix(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    sizes = np.array([1, 0, 7, 4000, 992])
    got = minhash.coordinates(values, sizes)
    for k in (0, 1, 77, 199):
        turned = second[(first[(values % np.uint64(size)).astype(np.int64)] + k) % size]
        for row, (lo, hi) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
            assert got[row, k] == (turned[lo:hi].min() if hi > lo else np.iinfo(np.uint32).max)


def test_coordinates_agree_as_often_as_sets_do():
    values = mix(np.arange(1000, dtype=np.uint64))
    a, b = minhash.coordinates(np.concatenate([values[:900], values[100:]]), np.array([900, 900]))
    assert abs(np.mean(a == b) - 0.8) < 0.1
