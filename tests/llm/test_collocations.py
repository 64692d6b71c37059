"""Phrase mining against plain counting, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, hash string, range string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, best=2000, longest=4):
    count, n, out = Counter(), Counter(), []
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(words)
            count.update((lang or "und", words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found, over = defaultdict(list), Counter()
    good = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= support}
    for (lang, w), a in good.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                over[lang, w[i : i + m]] = max(over[lang, w[i : i + m]], a)
    for (lang, w), a in good.items():
        if over[lang, w] and 100 * over[lang, w] >= 80 * a:
            continue
        cuts = [(count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed=3, n=200):
    rng = np.random.default_rng(seed)
    words = ["The", "a", "b", "New", "YORK", "city", "ÉTÉ", "of", "x-y", "en", "es", "漢字", "fr", "de"]
    out = []
    for k in range(n):
        picked = rng.choice(words, int(rng.integers(0, 40)), p=np.array([6, 5, 4, 3, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1]) / 34)
        joins = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! "], len(picked), p=[0.6, 0.1, 0.05, 0.1, 0.05, 0.05, 0.05])
        out.append((k, "".join(w + j for w, j in zip(picked, joins)), ["en", "es", None, "und", "fr"][k % 5]))
    return out


def mine(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "p", "h", "r", "n") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.collocations(frame, **options).collect()))


def test_against_plain_counts(spark):
    rows = texts() + [(900, None, "en"), (901, "", None), (902, "\t ,;\r\n", "fr"), (903, "again and again " * 3000, "en"), (904, "z " * 50_000, None), (None, "New York city", "en"), (7, "New York city", "en")]
    want = brute(rows, 10)
    assert len(want) > 50
    assert mine(spark, rows, support=10) == want


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 5)
    monkeypatch.setattr(collocations, "MOST_BITS", 5)
    rows = texts(4, 90)
    assert mine(spark, rows, support=5) == brute(rows, 5)


def test_small_buffers(spark):
    docs = spark.createDataFrame(texts(5, 90), "doc_id long, text string, lang string").select("text", "lang").repartition(3)

    def passed(most):
        rows = collocations.count_pass(docs, 1, 22, 30, False, most=most).collect()
        words, buckets = Counter(), Counter()
        for r in rows:
            if r.range is None:
                words[r.lang, r.phrase] += r.a
            else:
                buckets.update(dict(zip([(r.range, x) for x in np.cumsum(collocations._numbers(r.places)).tolist()], collocations._numbers(r.counts).tolist())))
        return words, buckets

    assert passed((40, 40)) == passed((1 << 20, 1 << 20))


def test_best_with_ties(spark):
    rows = [(k, f"p{k % 9} q{k % 9}. r s t.", "en") for k in range(90)]
    found = mine(spark, rows, support=10, best=4)
    assert found == brute(rows, 10, best=4) and [r[2] for r in found] == ["r s t", "p0 q0", "p1 q1", "p2 q2"]


def test_a_language_spelt_like_a_word(spark):
    rows = [(k, "es en", "en") for k in range(20)] + [(k, "en es", "es") for k in range(15)] + [(k, "en", "es") for k in range(9)]
    assert mine(spark, rows, support=10) == brute(rows, 10)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "one two three", "en")]])
def test_nothing_frequent(spark, rows):
    assert mine(spark, rows) == []
