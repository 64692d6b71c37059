"""Benchmark decontamination: BM25 over test items, block-max WAND, verified overlap.

The inverted index is over the benchmark items, not the corpus. Every training passage (a window
of ``PASSAGE_WORDS`` words, one starting every ``PASSAGE_STRIDE``) is a query against it. An item of more than
``PART_WORDS`` words is indexed whole and also in parts of at most as many, each an entry with a self-score of its own:
at every offset some passage holds a part as a whole. All items with an entry that scores at least ``MIN_SHARE``
of its own self-score in one passage are retrieved. Postings hold BM25 weights divided by the entry's self-score,
so that one threshold serves all; document frequencies and the mean length are those of whole items, over the whole benchmark. Entries are numbered
in blocks of ``BLOCK``, and the index has each term's maximum in each block. For all passages of a slice
at once, the block maxima of the essential terms are added up; the frequent terms, which can add no more
than ``NON_ESSENTIAL`` to any entry, count by that bound. Only blocks that can reach the threshold are opened,
and there WAND picks pivot entries by the block maxima and scores them exactly. No entry above the threshold is lost;
``passage`` and ``bm25`` are those of the item's entry with the highest share.

Each retrieved pair is verified on the words of the whole document: a share of at least ``MIN_QUESTION``
of the word 5-grams of the item's question part and ``MIN_ANSWER`` of those of its answer part must occur in
the document. The answer part is the last sentence of the item, or its last third if it has only one. For an
unbroken copy, 5-grams that reach from the question into the answer count for the answer; otherwise each part
counts on its own words, so that other words may stand between both. A part of fewer than five words
is then one run of words, which has to occur whole, in words that don't belong to the other part's
copy, and at most ``NEAR`` words before or after the place of any matched 5-gram's copy of that part (of its run,
if that has fewer than five words too). An item of fewer than five words in all matches only a document of just these words.

The index is built from the benchmark in pieces of about ``INDEX_ITEMS`` entries, each of which is
broadcast: its size is bounded however large the benchmark is, but by its longest item. Each piece is matched in one scan,
and where pieces are cut makes no difference to the matches.

Defined results: a null or empty text or item matches nothing; repeated items match each on its own;
repeated documents are each reported; of an item's entries and passages with the same share the first counts; rows of null item id are skipped; an empty table on either side
gives an empty result; whole texts of any length are searched; other columns don't take part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.llm.shared import drop_table, stored, table
from scriptorium.llm.textscan import SHINGLE_WORDS as SHINGLE, hash_word, hashed_words, ragged, shingles

PASSAGE_WORDS, PASSAGE_STRIDE = 96, 32
PART_WORDS = PASSAGE_WORDS - PASSAGE_STRIDE
MIN_SHARE = 0.6
MIN_QUESTION, MIN_ANSWER = 0.6, 0.6
NEAR = 16
INDEX_ITEMS = 20_000
BLOCK = 8
NON_ESSENTIAL = 0.25
K1, B = 1.2, 0.75
MATCH = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("passage", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in ("bm25", "question_overlap", "answer_overlap")]
)

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def item_words(text: str | None) -> tuple[list[str], list[str]]:
    """The words of the question part and of the answer part."""
    words = _WORDS.findall(text or "")
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    at = ends[-1] if ends else len(words) - len(words) // 3
    return words[:at], words[at:]


@dataclass
class Index:
    """Postings by term: entry numbers and their BM25 weights, with the maximum of each block of postings."""

    ids: list[int] = field(default_factory=list)
    parts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # the words of question and answer
    question: list[np.ndarray] = field(default_factory=list)
    answer: list[np.ndarray] = field(default_factory=list)
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by entry: the number of its item
    self_score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # by term
    others: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by block: the most that the other terms add to an entry
    block_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # by term, into the next two
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def count_blocks(self) -> int:
        return (len(self.owner) + BLOCK - 1) // BLOCK


def count_parts(n_words: int) -> int:
    """How many parts an item of so many words is cut into; 0 if it is indexed as a whole alone."""
    return -(-n_words // PART_WORDS) if n_words > PART_WORDS else 0


class Statistics(NamedTuple):
    """Of all items: how many have words, their mean length, and how many hold a term."""

    items: int
    mean: float
    holding: dict[int, int]


def build_index(items: list[tuple[int, str]], over: Statistics | None = None) -> Index:
    """The index of the items, with weights from the statistics ``over``, by default those of the items themselves."""
    index, postings, lengths, owner, whole = Index(), {}, [], [], []
    for item_id, text in items:
        q, a = item_words(text)
        if not q and not a:
            continue
        hashes = np.array([hash_word(w) for w in q + a], np.uint64)
        number = len(index.ids)
        index.ids.append(item_id)
        index.parts.append((hashes[: len(q)], hashes[len(q) :]))
        every = shingles(hashes)
        # a run of words that reaches from the question into the answer counts for the answer
        split = max(0, min(len(q) - SHINGLE + 1, len(every)))
        index.question.append(np.unique(every[:split]))
        index.answer.append(np.unique(every[split:]))
        parts = count_parts(len(hashes))
        for k, entry in enumerate([hashes, *(np.array_split(hashes, parts) if parts else [])]):
            for term, n in zip(*(x.tolist() for x in np.unique(entry, return_counts=True))):
                postings.setdefault(term, []).append((len(owner), n))
            owner.append(number)
            whole.append(k == 0)
            lengths.append(len(entry))
    if not index.ids:
        return index
    index.owner, count = np.array(owner), len(owner)
    if over is None:
        holding = {term: sum(whole[i] for i, _ in found) for term, found in postings.items()}
        over = Statistics(len(index.ids), sum(n for n, w in zip(lengths, whole) if w) / len(index.ids), holding)
    index.terms = np.array(sorted(postings), np.uint64)
    index.self_score = np.zeros(count)
    lists = []
    for term in index.terms.tolist():
        found = postings[term]
        idf = math.log(1 + (over.items - over.holding[term] + 0.5) / (over.holding[term] + 0.5))
        weights = np.array([idf * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / over.mean)) for i, n in found])
        lists.append((np.array([i for i, _ in found]), weights))
        index.self_score[lists[-1][0]] += weights
    index.items = np.concatenate([x for x, _ in lists])
    index.weights = np.concatenate([w for _, w in lists]) / index.self_score[index.items]
    index.starts = np.cumsum([0, *(len(w) for _, w in lists)])
    term_of = np.repeat(np.arange(len(lists)), np.diff(index.starts))
    key = term_of * index.count_blocks() + index.items // BLOCK
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    index.blocks, index.block_max = index.items[opens] // BLOCK, np.maximum.reduceat(index.weights, opens)
    index.block_starts = np.searchsorted(opens, index.starts)
    index.essential, mass = np.ones(len(lists), bool), np.zeros(count)
    for term in np.argsort(-np.diff(index.starts), kind="stable").tolist():  # the longest lists, as long as the bound holds
        span = slice(index.starts[term], index.starts[term + 1])
        mass[index.items[span]] += index.weights[span]
        if mass.max() > NON_ESSENTIAL:
            mass[index.items[span]] -= index.weights[span]
            break
        index.essential[term] = False
    index.others = np.maximum.reduceat(mass, np.arange(0, count, BLOCK))
    return index


def wand(index: Index, terms: list[int], block: int) -> list[tuple[int, float]]:
    """(entry number, share of its self-score) of the block's entries that reach MIN_SHARE, for a passage with these distinct terms."""
    least, low, high, found = MIN_SHARE - 1e-9, block * BLOCK, (block + 1) * BLOCK, []
    items, weights, cursors = index.items, index.weights, []
    for t in terms:
        a, b = index.block_starts[t], index.block_starts[t + 1]
        place = a + int(np.searchsorted(index.blocks[a:b], block))
        if place < b and index.blocks[place] == block:
            span = items[index.starts[t] : index.starts[t + 1]]
            at, end = (int(index.starts[t] + np.searchsorted(span, x)) for x in (low, high))
            cursors.append([int(items[at]), at, end, float(index.block_max[place])])
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for item, _, _, most in cursors:
            bound += most
            if bound >= least:
                pivot = item
                break
        if pivot is None:
            break
        score = 0.0
        for c in cursors:
            if c[0] > pivot:
                break
            while c[1] < c[2] and items[c[1]] < pivot:
                c[1] += 1
            if c[1] < c[2] and items[c[1]] == pivot:
                score += float(weights[c[1]])
                c[1] += 1
        if score >= least:
            found.append((pivot, score))
        cursors = [[int(items[at]), at, end, most] for _, at, end, most in cursors if at < end]
    return found


def hopeful_blocks(index: Index, term: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, passage, first and last word, and block, wherever a passage of consecutive rows can reach the threshold in a block."""
    many = np.where(counts > 0, 1 + np.maximum(0, counts - PASSAGE_WORDS + PASSAGE_STRIDE - 1) // PASSAGE_STRIDE, 0)
    row, number = np.repeat(np.arange(len(counts)), many), ragged(many)
    ends = np.cumsum(counts)
    first = (ends - counts)[row] + number * PASSAGE_STRIDE
    last = np.minimum(first + PASSAGE_WORDS, ends[row])
    known = np.flatnonzero((term >= 0) & index.essential[term])
    key = np.repeat(np.arange(len(counts)), counts)[known] * len(index.terms) + term[known]
    order = np.argsort(key, kind="stable")
    before = np.full(len(known), -1)  # where the same term occurs before in the row
    same = key[order][1:] == key[order][:-1]
    before[order[1:][same]] = known[order[:-1][same]]
    width = index.count_blocks()
    for lo in range(0, len(row), step := max(1, (1 << 21) // width)):
        part = slice(lo, lo + step)
        a, b = np.searchsorted(known, first[part]), np.searchsorted(known, last[part])
        hits = np.repeat(a, b - a) + ragged(b - a)
        passage = np.repeat(np.arange(len(a)), b - a)
        fresh = before[hits] < first[part][passage]  # each term of a passage once
        hits, passage = term[known[hits[fresh]]], passage[fresh]
        size = (index.block_starts[1:] - index.block_starts[:-1])[hits]
        at = np.repeat(index.block_starts[hits], size) + ragged(size)
        reach = np.bincount(np.repeat(passage, size) * width + index.blocks[at], index.block_max[at], len(a) * width)
        good = np.flatnonzero(reach.reshape(-1, width) + index.others >= MIN_SHARE - 1e-6)
        for p, block in zip((lo + good // width).tolist(), (good % width).tolist()):
            yield int(row[p]), int(number[p]), int(first[p]), int(last[p]), block


def run_starts(words: np.ndarray, run: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(words) - len(run) + 1))
    for k, word in enumerate(run):
        at = at[words[at + k] == word]
    return at


def lies_near(words: np.ndarray, grams: np.ndarray, run: np.ndarray, other: np.ndarray) -> bool:
    """Whether ``run`` occurs at most NEAR words from where the words ``other`` lie, going by any 5-gram of them, and outside of these."""
    starts, size = run_starts(words, run), min(SHINGLE, len(other))
    if size < SHINGLE:
        at = run_starts(words, other)
        least = most = np.zeros(len(at), np.int64)
    else:
        own = shingles(other)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.isin(grams, own))
        least, most = order[np.searchsorted(own, grams[at], "left", order)], order[np.searchsorted(own, grams[at], "right", order) - 1]
    taken = np.zeros(len(words) + 1, np.int64)  # words that belong to ``other``, added up
    for k in range(size):
        taken[at + k + 1] = 1
    taken = np.cumsum(taken)
    starts = starts[taken[starts + len(run)] == taken[starts]]
    low, high = at - most - len(run) - NEAR, at - least + len(other) + NEAR
    return bool((np.searchsorted(starts, high, "right") > np.searchsorted(starts, low, "left")).any())


def overlaps(index: Index, item: int, words: np.ndarray, grams: np.ndarray, have: np.ndarray) -> tuple[float, float]:
    """The shares of the item's question and answer that a document has, from its words, their 5-grams in order, and the distinct ones."""
    share = lambda want: float(np.isin(want, have).mean()) if len(want) else 1.0
    question, answer = share(index.question[item]), share(index.answer[item])
    q, a = index.parts[item]
    if question < MIN_QUESTION or answer >= MIN_ANSWER or len(q) + len(a) < SHINGLE:
        return question, answer
    if len(a) >= SHINGLE:
        answer = max(answer, share(np.unique(shingles(a))))
        if len(q) < SHINGLE and answer >= MIN_ANSWER:
            question = float(lies_near(words, grams, q, a))
    elif lies_near(words, grams, a, q):
        answer = 1.0
    return question, answer


def match_rows(index: Index, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(row, item number, passage, BM25, question overlap, answer overlap) of the verified items of consecutive rows."""
    place = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[place] == words, place, -1)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for row, number, first, last, block in hopeful_blocks(index, term, counts):
        terms = np.unique(term[first:last])
        for entry, share in wand(index, terms[terms >= 0].tolist(), block):
            item = int(index.owner[entry])
            if share > best.get((row, item), (0.0, 0, 0))[0]:
                best[row, item] = share, number, entry
    ends, out, at = np.cumsum(counts), [], -1
    for (row, item), (share, number, entry) in sorted(best.items()):
        if row != at:
            at, own = row, words[ends[row] - counts[row] : ends[row]]
            grams = shingles(own)
            have = np.unique(grams)
        overlap = overlaps(index, item, own, grams, have)
        if overlap[0] >= MIN_QUESTION and overlap[1] >= MIN_ANSWER:
            out.append((row, item, number, share * float(index.self_score[entry]), *overlap))
    return out


def index_pieces(items: DataFrame, key: str = "item_id", text: str = "text", size: int = INDEX_ITEMS) -> Iterator[Index]:
    lower = F.translate(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(_WORDS.pattern), 0)
    rows = items.select(items[key].cast("long").alias("k"), items[text].alias("t")).where("k is not null and t is not null")
    rows = stored(rows.withColumn("words", words).where(F.size("words") > 0).withColumn("no", F.monotonically_increasing_id()), "items")
    count, mean = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    # each item comes with the number of items that hold each of its words
    held_by = rows.select("no", F.explode(F.array_distinct("words")).alias("word"))
    holding = held_by.join(held_by.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("holding"))
    held, terms, entries = [], {}, 0
    for row in rows.join(holding, "no").select("k", "t", "holding").orderBy("k", "t").toLocalIterator():
        held.append((row.k, row.t))
        terms |= {hash_word(w): n for w, n in row.holding.items()}
        entries += 1 + count_parts(sum(1 for _ in _WORDS.finditer(row.t)))
        if entries >= size:
            yield build_index(held, Statistics(count, mean, terms))
            held, terms, entries = [], {}, 0
    if held:
        yield build_index(held, Statistics(count, mean, terms))
    drop_table(rows)


def match_items(df: DataFrame, shared: Broadcast, text: str = "text") -> DataFrame:
    """``row`` and ``matches``, the verified items of each row of ``df`` under one piece of the index."""
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("matches", T.ArrayType(MATCH))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int64()), ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        names = [f.name for f in MATCH]
        for batch in batches:
            for lo, hi, words, counts in hashed_words(batch.column(0).field(place)):
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for row, item, *rest in match_rows(index, words, counts):
                    found[row].append(dict(zip(names, (index.ids[item], *rest))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, kind)], names=schema.names)

    place = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(match, schema)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = INDEX_ITEMS) -> DataFrame:
    """``row`` and ``match`` for each document and verified item."""
    out, spark = None, docs.sparkSession
    for index in index_pieces(items, item_key, item_text, size):
        part = match_items(docs, spark.sparkContext.broadcast(index), text).select("row", F.explode("matches").alias("match"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.limit(0).select(F.struct(*docs.columns).alias("row"), F.lit(None).cast(MATCH).alias("match"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a verified item, with all their columns."""
    for index in index_pieces(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of about INDEX_ITEMS entries
        docs = match_items(docs, shared, text).where(F.size("matches") == 0).select("row.*")
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``documents`` that hold an item of ``benchmark``, with the item and the evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select("row.doc_id", "match.*")
