"""Secrets, WARC, languages, tokens and top-k on small tables, with awkward rows, against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import bpe, decontaminate, langid, secrets, tokencounts, topk, warc
from scriptorium.llm.shared import new_folder

SCHEMA = "doc_id long, text string, lang string, row string, spans string"
AWKWARD = [(1, None, None, "r", "s"), (2, "", "en", None, None), (3, "same", "en", "r", None), (3, "same", "en", "r", None), (None, "no id é", "fr", None, None), (5, "word " * 40_000, None, None, "s"), (6, "\t\n ", "de", None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def base_spans(text):
    """The base rules, straight from their expressions."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PIECES = st.sampled_from(["password", "PassWord", "token", "api_key", "apikey", "secret", "=", ": ", " ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "x", "İ", "é", "longvalue99", "\n", "ſecret"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans(text):
    assert [s for s in secrets.find_secrets(text) if s[1] < 3] == base_spans(text)


def test_checksums():
    body = "A" * 30
    good = "ghp_" + body + secrets.base62_crc(body)
    assert [s[2] for s in secrets.find_secrets(f"x {good} y")] == ["github"]
    assert not secrets.find_secrets("x ghp_" + "A" * 36 + " y")
    assert [s[2] for s in secrets.find_secrets("-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----")] == ["pem"]


def test_secret_rows(spark, awkward):
    rows = secrets.scan_secrets(awkward, redact=True).collect()
    assert len(rows) == len(AWKWARD) and all(r.spans == [] for r in rows)
    leak = spark.createDataFrame([(1, "a token=abcdefghij b")], "doc_id long, text string")
    assert secrets.scan_secrets(leak, redact=True).first().clean == "a [secret] b"
    assert secrets.scan_secrets(awkward.limit(0)).count() == 0


def test_warc_round_trip(spark):
    bodies = [b"", b"", b"same", b"same", b"same", bytes(range(256)) * 500, b"\x1f\x8b\x08WARC/1.1\r\n"]
    rows = [(k, f"http://x/{k} é\n", bytearray(b)) for k, b in enumerate(bodies)] + [(7, None, None), (None, "u", bytearray(b"same"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(3)
    files = warc.write_archives(pages, new_folder(spark, "warc"))
    for size in (64, 1000, 1 << 20):
        found = {r.page_id: r for r in warc.read_archives(files, range_bytes=size).collect()}
        assert len(found) == len(rows)
        for key, url, body in rows:
            r = found[key]
            whole = bytes(body or b"")
            same = [k for k, _, b in rows if k is not None and bytes(b or b"") == whole]
            owner = max(same)
            assert r.url == url and r.payload_bytes == len(whole)
            assert r.record_type == ("revisit" if len(same) + (key is None) > 1 and key != owner else "response")
            assert r.refers_to == (owner if r.record_type == "revisit" else None)
            assert r.payload is None or bytes(r.payload) == whole
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_folder(spark, "warc"))).count() == 0


def test_language(spark, awkward):
    texts = {"en": "the and with that of is", "fr": "été déjà où le la que", "de": "über für nicht und der", "es": "ñandú así que el los"}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(t.split(), 30)), lang) for k, (lang, t) in enumerate(list(texts.items()) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    found = langid.predict_language(docs.where("doc_id % 3 = 1"), model).collect()
    assert np.mean([r.lang_pred == r.row.lang for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    odd = langid.predict_language(awkward, model).collect()
    assert [r.lang_pred == "und" for r in odd] == [not any(c.isalpha() for c in r.row.text or "") for r in odd]
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict_language(docs.limit(2), nothing).collect()} == {"und"}


def test_bpe_agrees_with_the_library(spark, awkward):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    rng = np.random.default_rng(1)
    bits = ["a", "'s", "'", " ", "  ", "\n", "é", "٣", "🎉", "<|endoftext|>", "Hello", "ing", "x" * 90, "　", "ſ", "1", "!?"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(300)]
    docs = awkward.unionByName(spark.createDataFrame([(100 + k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA))
    found = bpe.encode(docs, bpe.compile_lexicon(docs), decode=True).collect()
    assert len(found) == len(texts) + len(AWKWARD)
    for r in found:
        want = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), bpe.compile_lexicon(docs.limit(0))).count() == 0


def test_long_merge_equals_short():
    vocab = bpe.vocabulary(bpe.default_vocabulary())
    word = ("internationalisation" * 3).encode()
    assert vocab._merge_long([vocab.byte_ids[b] for b in word]) == vocab.merge(word)
    words = [b"the", b" hello", b"x", "é".encode() * 5, word]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocab.merge_many(words)] == [vocab.merge(w) for w in words]


def test_token_counts(spark, awkward):
    docs = awkward.unionByName(spark.createDataFrame([(9, "One line\n\nnext é line\n  x", None, None, None)], SCHEMA))
    encoding, _ = tokencounts.encoder(tokencounts.default_ranks())
    for rule in tokencounts.RULES:
        found = {}
        for r in tokencounts.count_sections(docs, ["doc_id", "text"], rule=rule).collect():
            assert r.row.text[r.start : r.end].count("\n") <= 1
            found.setdefault((r.row.doc_id, r.row.text), []).append((r.section, r.n_tokens))
        for (_, text), parts in found.items():
            copies = sum(1 for x in AWKWARD if x[1] == text) or 1
            assert sum(n for _, n in parts) == copies * len(encoding.encode_ordinary(text))
    fields = tokencounts.count_sections(docs, ["doc_id"], fields=["lang", "text"]).where("row.doc_id = 3").collect()
    assert {r.section for r in fields} == {0, 1}
    assert tokencounts.count_sections(awkward.limit(0), ["doc_id"]).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for k in range(0, 500, 5)] + [(1, None), (2, [float("nan")] * 6), (3, [None] * 6), (None, [0.1] * 6), (7, []), (10, [0.5] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.integer_weights(F.col("embedding")).alias("weights")).where("vec_id is not null and weights is not null")
    got = {}
    for r in topk.top_k(frame.where("vec_id % 100 = 0"), frame, 10, query_block=2, candidate_block=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    data = [(r.vec_id, list(r.weights)) for r in frame.collect()]
    for q, w in [(a, b) for a, b in data if a % 100 == 0]:
        want = sorted(((sum(x * y for x, y in zip(w, v)), k) for k, v in data if k != q), key=lambda t: (-t[0], t[1]))[:10]
        assert [(k, s) for s, k in want] == [got[q][i] for i in range(1, 11)]


def test_decontamination(spark, awkward):
    rng = np.random.default_rng(3)
    words = [f"w{k}x" for k in range(400)]
    items = [(k, " ".join(rng.choice(words, 30)) + ". " + " ".join(rng.choice(words, 8))) for k in range(20)] + [(90, None), (91, ""), (None, "x y z")]
    clean = [(k, " ".join(rng.choice(words, 300)), None, None, None) for k in range(100, 140)]
    dirty = [(200 + k, " ".join(rng.choice(words, 250)) + " " + items[k][1].upper() + " " + " ".join(rng.choice(words, 90)), None, None, None) for k in range(20)]
    docs = awkward.unionByName(spark.createDataFrame(clean + dirty, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.row.doc_id, r.match.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found == {(200 + k, k) for k in range(20)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(AWKWARD) + len(clean)
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [90, 170, 400])
def test_decontamination_of_long_items(spark, size):
    """An item longer than a passage is found at every offset of the stride, with others of the benchmark beside it."""
    rng = np.random.default_rng(6)
    items = [(k, " ".join(f"i{k}x{x}" for x in range(size - 9)) + ". " + " ".join(f"a{k}x{x}" for x in range(9))) for k in range(3)] + [(9, "one short item stands. it has an answer of words")]
    filler = [f"f{x}" for x in rng.integers(0, 500, 200)]
    docs = [(k, " ".join(filler[:k] + [items[1][1]] + filler[k:])) for k in range(decontaminate.PASSAGE_STRIDE)] + [(100, " ".join(filler)), (101, items[1][1][: len(items[1][1]) // 2])]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.row.doc_id, r.match.item_id) for r in found.collect()} == {(k, 1) for k in range(decontaminate.PASSAGE_STRIDE)}
    assert [len(x.ids) for x in decontaminate.index_pieces(spark.createDataFrame(items, "item_id long, text string"), size=1 + decontaminate.count_parts(size))] == [1, 1, 1, 1]


def test_decontamination_of_parted_items(spark):
    """Words between question and answer don't hide an item, however short either is; a question with another answer is no item."""
    sizes = [(30, n) for n in range(1, 13)] + [(2, 12), (4, 5), (4, 3), (1, 4), (3, 30)]
    parts = [(" ".join(f"q{k}x{x}" for x in range(q)) + "?", " ".join(f"a{k}x{x}" for x in range(a))) for k, (q, a) in enumerate(sizes)]
    filler = " ".join(f"f{x}" for x in range(60))
    docs = [(100 * (1 + n) + k, f"{filler} {q} {between} {a} {filler}") for n, between in enumerate(["Answer:", "A:", "* (B)", "\n"]) for k, (q, a) in enumerate(parts)]
    clean = [(1000 + k, f"{filler} {q} Answer: {' '.join('other' for _ in a.split())} {filler}") for k, (q, a) in enumerate(parts)]
    clean += [(2000 + k, f"{q} {filler} {a}") for k, (q, a) in enumerate(parts) if len(a.split()) < 5 or len(q.split()) < 5]
    bench = spark.createDataFrame([(k, f"{q} {a}") for k, (q, a) in enumerate(parts)], "item_id long, text string")
    found = decontaminate.find_contamination(spark.createDataFrame(docs + clean, "doc_id long, text string"), bench).collect()
    assert {(r.row.doc_id, r.match.item_id) for r in found if r.row.doc_id < 1000} == {(k, k % 100) for k, _ in docs}
    unbroken = {k for k, (q, a) in enumerate(parts) if len(q.split()) < 5 <= len(a.split())}  # here the answer alone has most of the item's 5-grams
    assert {r.row.doc_id for r in found if r.row.doc_id >= 1000} <= {2000 + k for k in unbroken}


def test_wand_finds_all(spark):
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"t{x}" for x in rng.zipf(1.4, 20) % 200)) for k in range(60)]
    index = decontaminate.build_index(items)
    for _ in range(100):
        terms = sorted(rng.choice(len(index.terms), 40, replace=False).tolist())
        scores = np.zeros(60)
        for t in terms:
            span = slice(index.starts[t], index.starts[t + 1])
            scores[index.items[span]] += index.weights[span]
        got = sorted(i for b in range(index.count_blocks()) for i, _ in decontaminate.wand(index, terms, b))
        assert got == np.flatnonzero(scores >= decontaminate.MIN_SHARE - 1e-9).tolist()


