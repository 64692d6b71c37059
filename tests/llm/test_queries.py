"""The registered queries on whole small tables with awkward rows: against SQL where there is some, else against brute force."""

from __future__ import annotations

import binascii
import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import bpe, decontaminate, jaccard, lm, quality, queries, tokencounts
from tests.llm.test_models import WORDS, shingles, text_tokens
from tests.llm.test_scans import base_spans

TABLES = ("documents", "pages", "embeddings", "benchmark", "labels")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, match string, key string, cls string, root string"
PAGES = "page_id long, url string, html string, payload string, digest string, owner string, file string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, rank string, weights string"


def documents():
    rng = np.random.default_rng(21)
    words = {"en": "the and with that of is was for from this", "fr": "été où que le la déjà avec pour dans cette", "de": "über für nicht und der die das auch wäre ein", "es": "ñandú así que el los años también para una muy"}
    out = []
    for k in range(160):
        lang = list(words)[k % 4]
        out.append((k, " ".join(rng.choice(words[lang].split(), int(rng.integers(5, 60)))) + f" k{k}\nline two {k} x", lang, "s", 1))
    out += [(200 + k, out[k][1] + " more", "en", None, 3) for k in range(0, 20, 3)]
    out += [(300, out[0][1], None, None, None), (301, None, None, None, None), (302, "", "en", "s", 0), (303, "\t\n ", "de", "s", 3), (304, "12 34 !", "fr", "s", 7), (305, 'API_KEY = "abcd1234efgh" AKIA' + "B" * 16 + " " + "0123456789abcdef" * 3, "en", "s", 1)]
    out += [(306, "Tiếng Việt 漢字 🎉 <|endoftext|> naïve", "xx", "s", 9), (307, "word " * 30_000, "en", "s", 150_000), (308, "eyJ" * 50_000, None, None, None)]
    return [r + ("r", "m", "k", "c", "o") for r in out]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(22)
    docs = documents()
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12. It is a1 a2 a3 a4 a5 a6"
    docs.append((400, docs[3][1] + " " + item.upper() + " " + docs[4][1], "en", "s", 1, "r", "m", "k", "c", "o"))
    frames = {
        "documents": (docs, DOCUMENTS),
        "pages": ([(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5), "p", "d", "o", "f") for k in range(60)] + [(100, None, None, None, None, None, None), (101, "u", "", None, None, None, None)], PAGES),
        "embeddings": ([(k, [float(x) for x in rng.normal(size=8)], 1, "s", "r", "w") for k in range(0, 700, 7)] + [(1, None, None, None, None, None), (2, [float("nan")] * 8, 1, "s", "r", "w"), (3, [None] * 8, 1, "s", "r", "w"), (8, [0.5] * 8, 1, "s", "r", "w"), (9, [0.5] * 8, 1, "s", "r", "w")], EMBEDDINGS),
        "benchmark": ([(1, item), (2, item), (3, None), (4, ""), (5, "quite another question stands here now? with an answer of its own words")], "item_id long, text string"),
        "labels": ([(k, int(k % 5 > 0), int(k % 7 == 0)) for k in range(160)] + [(None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(place / f"{name}.parquet"))
    return str(place), docs


def run(spark, name, place):
    frame = queries.QUERIES[name](spark, place)
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert isinstance(queries.ORACLE_SQL[name], str)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf[0]}/{table}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    found = run(spark, name, sf[0])
    assert sorted(found[0]) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == want


def fold(key, n):
    return binascii.crc32(str(key).encode()) % n


def test_secrets(spark, sf):
    found = {r["doc_id"]: r for r in run(spark, "op1_secret_scan", sf[0])}
    assert len(found) == len(sf[1])
    for key, text, *_ in sf[1]:
        base = base_spans(text or "")
        kinds = Counter(s[2] for s in base)
        assert (found[key]["n_assign"], found[key]["n_access"], found[key]["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert found[key]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()


def test_languages(spark, sf):
    found = {r["doc_id"]: r for r in run(spark, "op5_language_id", sf[0])}
    assert len(found) == len(sf[1])
    for key, text, *_ in sf[1]:
        r = found[key]
        assert r["held_out"] == (fold(key, 3) == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    held = [(found[k]["lang_pred"], lang) for k, _, lang, *_ in sf[1] if k < 160 and fold(k, 3) == 1]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_scores(spark, sf):
    found = {r["doc_id"]: r for r in run(spark, "op6_lm_score", sf[0])}
    counts = Counter(w for k, t, *_ in sf[1] if fold(k, 7) != 2 for w in text_tokens(t))
    total = sum(counts.values())
    for key, text, *_ in sf[1]:
        words, r = text_tokens(text), found[key]
        assert (r["held_out"], r["train_tokens"], r["n_tokens"], r["n_known"]) == (fold(key, 7) == 2, total, len(words), sum(w in counts for w in words))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words), rel_tol=1e-9)
        assert r["score"] <= 0


def test_tokens(spark, sf):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    found = {r["doc_id"]: r for r in run(spark, "op8_bpe_codec", sf[0])}
    for key, text, *_ in sf[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[key]["n_tokens"] == len(ids)
        assert found[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_sections(spark, sf, rule):
    """Each section's tokens, from the owner of every token by its bytes; a tie goes to the earlier section."""
    encoding, _ = tokencounts.encoder(tokencounts.default_ranks())
    docs = spark.createDataFrame([(r[0], r[1]) for r in sf[1]] + [(900, "\n\n\n a\n\n\tb \n"), (900, "\n\n\n a\n\n\tb \n"), (901, "a\n\nb\n\n\n\nc")], "doc_id long, text string")
    if rule == "majority":
        assert len(run(spark, "op9_token_counts", sf[0])) == sum(len((r[1] or "").encode().splitlines(keepends=True)) if "\r" not in (r[1] or "") else 0 for r in sf[1])
    found = {}
    for r in tokencounts.count_sections(docs, ["doc_id", "text"], rule=rule).collect():
        found.setdefault((r.row.doc_id, r.row.text), Counter())[r.section] += r.n_tokens
    for (key, text), counts in found.items():
        data = text.encode()
        section = np.cumsum(np.frombuffer(b"\0" + data[:-1], np.uint8) == 10)
        want, at = Counter(), 0
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            held = Counter(section[at : at + size].tolist())
            want[min(held, key=lambda s: (-held[s], s)) if rule == "majority" else int(section[at])] += 1
            at += size
        copies = 2 if key == 900 else 1
        assert {k: n for k, n in counts.items() if n} == {k: copies * n for k, n in want.items()}


def test_quality_model(spark, sf):
    """Perplexities from plain counts of an interpolated Kneser-Ney model with three discounts at each order."""
    found = {r["doc_id"]: r for r in run(spark, "op3_quality", sf[0])}
    good = {k for k in range(160) if k % 5 > 0 and k % 7 > 0} | {5}
    train = [t for k, t, *_ in sf[1] if k in good and fold(k, quality.FOLDS) != quality.HELD_FOLD]
    pairs = Counter(p for t in train for p in zip(["<s>", *text_tokens(t)], text_tokens(t)))
    kinds = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    contexts = Counter(b for _, b in pairs)
    d, e = lm.discounts(kinds(pairs)), lm.discounts(kinds(contexts))
    whole, off = Counter(), Counter()
    for (a, _), n in pairs.items():
        whole[a] += n
        off[a] += d[min(n, 3) - 1]
    unknown = sum(e[min(n, 3) - 1] for n in contexts.values()) / len(pairs) / len(contexts)
    lower = lambda w: (contexts[w] - e[min(contexts[w], 3) - 1]) / len(pairs) if w in contexts else unknown
    held = {}
    for key, text, lang, *_ in sf[1]:
        words, total = text_tokens(text), 0.0
        for a, b in zip(["<s>", *words], words):
            n = pairs.get((a, b), 0)
            total += math.log10((n - d[min(n, 3) - 1] if n else 0) / whole[a] + off[a] / whole[a] * lower(b) if a in whole else lower(b))
        want = 10 ** (-total / len(words))
        assert math.isclose(found[key]["perplexity"], want, rel_tol=1e-6)
        if key in good and fold(key, quality.FOLDS) == quality.HELD_FOLD:
            held.setdefault(lang, []).append(want)
    for r in found.values():
        limit = quality.MARGIN * max(held[r["lang"]]) if r["lang"] in held else None  # of so few the 0.99 quantile is the largest
        assert (r["threshold"] is None) == (limit is None) and (limit is None or math.isclose(r["threshold"], limit, rel_tol=1e-6))
        assert r["keep"] == (limit is None or r["perplexity"] <= r["threshold"])


def test_contamination(spark, sf):
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op4_decontamination", sf[0])} == {(400, 1), (400, 2)}


def test_whole_retrieval(spark):
    """All items that score enough in some passage are retrieved, by plain BM25 over every passage, wherever the index is cut."""
    rng = np.random.default_rng(23)
    words = [f"w{x}" for x in range(300)]
    sizes = [5, 6, 9, 17, 40, 64, 65, 90, 130, 300, 900, 2000] * 2
    items = [(k, " ".join(rng.choice(words, n)) + "? " + " ".join(rng.choice(words, max(2, n // 6)))) for k, n in enumerate(sizes)]
    docs = []
    for k, (_, text) in enumerate(items):
        own = text.split()
        for at in rng.integers(0, len(own), len(own) // 12 * (k % 3)):
            own[at] = "x"
        docs.append((k, " ".join([*rng.choice(words, int(rng.integers(0, 200))), *own, *rng.choice(words, int(rng.integers(0, 99)))])))
    split = {k: [w.lower() for w in WORDS.findall(t)] for k, t in items}
    holding = Counter(w for own in split.values() for w in set(own))
    mean = sum(map(len, split.values())) / len(split)
    index, want = decontaminate.build_index(items), set()
    for doc, text in docs:
        own = [w.lower() for w in WORDS.findall(text)]
        hashes = np.array([decontaminate.hash_word(w) for w in own], np.uint64)
        grams = decontaminate.shingles(hashes)
        passages = [set(own[s : s + 96]) for s in range(0, max(1, len(own) - 64), 32)]
        for key, item in split.items():
            parts = decontaminate.count_parts(len(item))
            for entry in [item, *(np.array_split(item, parts) if parts else [])]:
                weight = {}
                for w, n in Counter(map(str, entry)).items():
                    idf = math.log(1 + (len(split) - holding[w] + 0.5) / (holding[w] + 0.5))
                    weight[w] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(entry) / mean))
                whole = sum(weight.values())
                if any(sum(weight.get(w, 0) for w in p) >= decontaminate.MIN_SHARE * whole for p in passages):
                    q, a = decontaminate.overlaps(index, index.ids.index(key), hashes, grams, np.unique(grams))
                    if q >= decontaminate.MIN_QUESTION and a >= decontaminate.MIN_ANSWER:
                        want.add((doc, key))
                    break
    assert {(k, k) for k in range(0, len(items), 3)} <= want  # the unchanged copies, of every length
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.INDEX_ITEMS, 9):
        assert {(r.row.doc_id, r.match.item_id) for r in decontaminate.find_contamination(*frames, size=size).collect()} == want


def test_sketches():
    """A sketch lets every similar pair through, and few others."""
    rng = np.random.default_rng(24)
    rows = []
    for n in [1, 3, 12, 50, 90, 200, 700] * 4:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        rows += [x, np.concatenate([x[: n - n // 9], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]), x[n // 5 :] if n > 5 else x]
    rows = [np.sort(x) for x in rows]
    sizes = np.array([len(x) for x in rows])
    drawn = jaccard.Sketches(jaccard.pa.array(jaccard.sketches(np.concatenate(rows), sizes), jaccard.pa.binary()), jaccard.pa.array(sizes))
    i, j = np.triu_indices(len(rows), 1)
    near = set(drawn.near(i, drawn, j)[0].tolist())
    similar = set()
    for p, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        both = len(np.intersect1d(rows[a], rows[b]))
        if 100 * both >= 75 * (sizes[a] + sizes[b] - both):
            similar.add(p)
    assert similar <= near and len(near) < 2 * len(similar) + 20


def test_a_family_around_the_bar(spark):
    """Copies with similarities on both sides of 0.75, that many signatures connect."""
    rng = np.random.default_rng(25)
    base, texts = [f"b{x}" for x in range(80)], []
    for k in range(150):
        own = list(base)
        for at in rng.integers(0, 80, 1 + k % 3):
            own[at] = f"o{rng.integers(0, 10_000)}"
        texts.append(" ".join(own))
    sets, root = [shingles(t) for t in texts], list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert 1 < len(set(root)) < 150
    found = jaccard.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))


def test_nothing(spark, sf, tmp_path):
    """Empty tables give empty results."""
    for name in TABLES:
        spark.read.parquet(f"{sf[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
