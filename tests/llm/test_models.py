"""The Jaccard join, language models and the pipeline on small tables, against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

import corpus_pipeline
from scriptorium.llm import jaccard, lm, ngrams, quality
from scriptorium.llm.eliasfano import Monotone, pack_monotone
from scriptorium.llm.shared import stored

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(900, None), (901, ""), (902, " \n"), (903, "One Two"), (904, "one two"), (905, "one two three"), (None, "one two"), (906, "w " * 20_000)]


def shingles(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def family(rng, size, copies, edits):
    base = [f"a{x}" for x in rng.integers(0, 10_000, size)]
    for _ in range(copies):
        own = list(base)
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            own[at] = f"b{rng.integers(0, 10_000)}"
        yield " ".join(own)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    texts = [t for size, copies, edits in ((8, 12, 1), (15, 20, 1), (30, 20, 2), (60, 40, 3), (200, 30, 8), (600, 10, 25), (40, 60, 0)) for t in family(rng, size, copies, edits)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"c{x}" for x in rng.integers(0, 10_000, n)) for n in rng.integers(10, 80, 60)]
    rows = [(int(k), texts[k]) for k in rng.permutation(len(texts))] + AWKWARD + [(3, texts[3])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in root}


@pytest.mark.parametrize("cold", [8, 2])
def test_jaccard_components(spark, corpus, cold, monkeypatch):
    monkeypatch.setattr(jaccard, "COLD", cold)
    rows, frame = corpus
    want = brute_components(rows)
    found = jaccard.link_documents(frame).collect()
    assert len(found) == len(rows)
    sizes = {k: len(shingles(t)) for k, t in rows}
    for r in found:
        assert r.n_shingles == sizes[r.doc_id]
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)


def test_signatures_meet():
    rng = np.random.default_rng(6)

    def of(x):
        return {(band, s) for sig, _, band, _ in jaccard._indexed(np.sort(x), np.array([len(x)])) for s in sig.tolist()}

    for n in [*range(1, 60), *rng.integers(60, 900, 60).tolist()]:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(4):
            gone = int(rng.integers(0, n // 4 + 1))
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                assert of(x) & of(y)


def test_jaccard_of_nothing(spark, corpus):
    assert jaccard.link_documents(corpus[1].limit(0)).count() == 0


def test_keep_one_with_other_partitions_by_job(spark, tmp_path, monkeypatch):
    """Jobs that plan the scan in other partitions than the one before, as after the loss of an executor, still mean the same rows."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"d{k}w{x}" for x in rng.integers(0, 10_000, 30)) for k in range(24)]
    rows = [(k, texts[k]) for k in range(24)] + [(100 + k, texts[k]) for k in range(0, 24, 2)] + [(200, None), (201, "")]
    spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    bytes_key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(bytes_key)

    def exact_links(df, key):
        spark.conf.set(bytes_key, "200")
        found = df.select(F.col(key), F.min(key).over(Window.partitionBy(F.coalesce(F.nullif("text", F.lit("")), F.col(key).cast("string")))).alias("component_id"))
        found = stored(found, "found")
        spark.conf.set(bytes_key, before)
        return found

    monkeypatch.setattr(jaccard, "link_documents", exact_links)
    try:
        left = [r.doc_id for r in jaccard.keep_one(spark.read.parquet(str(tmp_path / "docs"))).collect()]
    finally:
        spark.conf.set(bytes_key, before)
    assert sorted(k % 100 if k < 200 else k for k in left) == [*range(24), 200, 201]


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n, top in ((0, 9), (1, 5), (200, 300), (3000, 1 << 64), (500, 1 << 20)):
        values = np.sort(rng.integers(0, top - 1, n, dtype=np.uint64))
        read = Monotone(np.frombuffer(pack_monotone(values, top), np.uint8))
        assert (read.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top - 1, 100, dtype=np.uint64)])
        for x, i in zip(asked.tolist(), read.find(asked).tolist()):
            assert (i >= 0) == (x in values) and (i < 0 or values[i] == x)


def text_tokens(text):
    return [w.lower() for w in WORDS.findall(text or "")] + ["</s>"]


def test_words_of_several_slices_are_looked_up_at_once():
    column = pa.array([f"w{k} common" for k in range(9000)] + [None])
    parts = list(ngrams.gathered(column))
    assert [(lo, hi, len(sizes)) for lo, hi, _, sizes in parts] == [(0, 9001, 9001)]
    assert parts[0][2].tolist() == [h for _, _, hashes, _ in ngrams.tokens(column) for h in hashes.tolist()]
    keys = np.array([7, -1, 7, 3, -1], np.int64)
    distinct, place = ngrams.distinct_of(keys)
    assert distinct.tolist() == [-1, 3, 7] and distinct[place].tolist() == keys.tolist()


def test_language_model(spark):
    rng = np.random.default_rng(8)
    words = [f"v{k}" for k in range(40)]
    train = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(200)] + ["", None]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = [(k, t) for k, t in enumerate(train[:20] + ["v1 never v2", None, ""])]
    found = lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    counts = Counter(w for t in train for w in text_tokens(t))
    total = sum(counts.values())
    assert (model.tokens, model.words) == (total, len(counts))
    # the same model from plain counts
    pairs = Counter(p for t in train for p in zip(["<s>", *text_tokens(t)], text_tokens(t)))
    n = Counter(pairs.values())
    d = lm.discounts([n[1], n[2], n[3], n[4]])
    context, off = Counter(), Counter()
    for (a, _), c in pairs.items():
        context[a] += c
        off[a] += d[min(c, 3) - 1]
    once = Counter(counts.values())
    d1 = once[1] / (once[1] + 2 * once[2]) if once[1] and once[2] else 0.5
    lower = lambda w: (counts[w] - d1) / total if w in counts else d1 * len(counts) / total
    for r in found:
        words_ = text_tokens(r.row.text)
        assert (r.n_tokens, r.n_known) == (len(words_), sum(w in counts for w in words_))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words_), rel_tol=1e-9)
        want = 0.0
        for a, b in zip(["<s>", *words_], words_):
            back = off[a] / context[a] if a in context else 1.0
            c = pairs.get((a, b), 0)
            want += math.log10((c - d[min(c, 3) - 1]) / context[a] + back * lower(b) if c else back * lower(b))
        assert abs(r.score - want) <= 0.03 * len(words_)
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    empty = lm.train(spark.createDataFrame([], "text string"))
    assert lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == len(docs)


def test_quality(spark):
    rng = np.random.default_rng(9)
    words = [f"v{k}" for k in range(60)]
    good = [(k, " ".join(rng.choice(words, 60)), "en") for k in range(300)]
    junk = [(1000 + k, " ".join(f"z{x}!!" for x in rng.integers(0, 1 << 30, 60)), "en") for k in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (None, "v1 v2", "en"), (2002, "v1 v2", "xx"), (5, "v1 v1", "en")]
    docs = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(250)] + [(None,)], "doc_id long")
    found = quality.classify(docs, trusted).collect()
    assert len(found) == len(good + junk + odd)
    keep = {r.doc_id: r.keep for r in found}
    assert not any(keep[k] for k, *_ in junk) and np.mean([keep[k] for k in range(250, 300)]) > 0.95
    assert keep[2001] and keep[2002]
    assert all(r.keep for r in quality.classify(docs, trusted.limit(0)).collect())
    assert quality.classify(docs.limit(0), trusted).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(10)
    words = {"en": "the and with that of is was for".split(), "fr": "été où que le la déjà avec pour".split()}
    rows = [(k, " ".join(rng.choice(words[lang], 12)) + f" k{k} " + " ".join(f"q{x}" for x in rng.integers(0, 9999, 20)), lang, "s", 1) for k, lang in enumerate(["en", "fr"] * 20)]
    item = " ".join(f"item{k}" for k in range(30)) + ". The answer is forty two."
    extra = [(100, rows[0][1], "en", "s", 1), (101, rows[1][1] + " " + item, "fr", None, None), (102, rows[2][1] + " token = abcdefgh12345678", "en", "s", 5), (103, None, None, None, None), (104, "12 34", "en", "s", 5)]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit("x"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert out.columns == frame.columns
        docs = out
        left.append({r.doc_id for r in out.select("doc_id").collect()})
    assert left[0] == {k for k in range(40)} | {100, 101, 102}
    assert len(left[1] & {0, 100}) == 1 and 101 in left[1]
    assert left[2] == left[1] - {101} and left[3] == left[2] == left[4]
    clean = spark.read.parquet(str(tmp_path / "secrets"))
    if 102 in left[3]:
        r = clean.where("doc_id = 102").first()
        assert r.text.endswith("[secret]") and r.n_chars == len(r.text)
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
