"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

``compile_lexicon`` counts the pre-tokens of the whole corpus in Spark, takes the most
frequent ones (a documented bound: ``LEXICON_WORDS``), and compiles them into a minimal
acyclic automaton whose arcs carry additive outputs. The outputs along a word's path add up
to the word's rank, which indexes its token ids. Suffixes are shared, so the whole lexicon
is a few megabytes; it is written to a shared folder and memory-mapped by the tasks.

``encode`` splits each whole text into pre-tokens, looks up the distinct ones of a slice in
the automaton, all words abreast, and merges those that it lacks exactly by rank. ``decode``
gathers the bytes of the ids. Both agree with the published tokenizer on every text.

Defined results: a null or empty text has no tokens and decodes to the empty text; a text of
any length is encoded whole, and a single pre-token of any length is merged in O(n log n);
repeated rows and null ids are encoded like any other; an empty table gives an empty table;
other columns are carried along untouched in ``row``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers.pre_tokenizers import ByteLevel

from scriptorium.llm.shared import lean, map_file, new_folder, put_file, table
from scriptorium.llm.textscan import word_hashes

LEXICON_WORDS = 1 << 16  # entries of the automaton
LEXICON_BYTES = 48  # longer words are always merged
MEMO_WORDS = 1 << 18  # words that a task remembers before it starts anew
SLICE_CHARS = 1 << 20
PATTERN = regex.compile(public_tokenizers.PATTERN)


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary file writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Token bytes by id, ids by bytes, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = {c: b for b, c in enumerate(byte_letters())}
        ids = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letter for c in token)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *self.added.values()])
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.ranks: dict[int, int] = {}  # (left id << 20 | right id) -> rank
        self.merged: list[int] = []  # rank -> new id
        for pair in spec["model"]["merges"]:
            a, b = (bytes(letter[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault(ids[a] << 20 | ids[b], len(self.merged))
            self.merged.append(ids[a + b])
        self.none = len(self.merged)
        self.merged_array = np.array(self.merged, np.int64)
        self.byte_id_array = np.array(self.byte_ids, np.int64)
        keys, ranks = np.array(list(self.ranks), np.int64), np.array(list(self.ranks.values()), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
        ids, rank = [self.byte_ids[b] for b in word], self.ranks.get
        if len(ids) > 64:
            return self._merge_long(ids)
        none, merged = len(self.merged), self.merged
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue and linked neighbours, for pre-tokens of any length."""
        ranks, n = self.ranks, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids, packed, of many pre-tokens: those of similar length are merged abreast, each by its own next pair."""
        out, sizes = [b""] * len(words), np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 32)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for lo in range(0, len(rows), 8192):
                self._merge_block(words, rows[lo : lo + 8192], sizes, high, out)
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], self.none)

    def _merge_block(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        blob = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), width)
        left = sizes[rows]
        ids = np.where(np.arange(width) < left[:, None], self.byte_id_array[blob], -1)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(1)
            each = np.arange(len(rows))
            rank = ranks[each, best]
            live = rank < self.none
            if not live.all():
                for i, n, x in zip(rows[~live].tolist(), left[~live].tolist(), ids[~live].astype("<u4")):
                    out[i] = x[:n].tobytes()
                rows, left, ids, ranks, best, rank = rows[live], left[live], ids[live], ranks[live], best[live], rank[live]
                each = np.arange(len(rows))
                if not len(rows):
                    return
            ids[each, best] = self.merged_array[rank]
            ids[:, :-1] = np.where(np.arange(width - 1) > best[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(np.arange(width - 2) >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.none
            left = left - 1
            ranks[each, best] = self._rank(ids[each, best], np.where(best + 1 < width, ids[each, np.minimum(best + 1, width - 1)], -1)) if width > 1 else self.none
            back = np.flatnonzero(best > 0)
            ranks[back, best[back] - 1] = self._rank(ids[back, best[back] - 1], ids[back, best[back]])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- the transducer ---------------------------------------------------------------------


def compile_transducer(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer of sorted distinct words, built state by state as words arrive in order.

    Arcs lie state by state, sorted by byte: ``key`` = state * 256 + byte, ``target``, ``skip``.
    ``skip`` counts the words that sort before those through the arc; along a path the skips,
    and one for each earlier end of a word, add up to the word's rank.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]]]] = []
    words_below: list[int] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            sign = (final, tuple(arcs))
            state = register.get(sign)
            if state is None:
                state = register[sign] = len(frozen)
                frozen.append((final, arcs))
                words_below.append(final + sum(words_below[t] for _, t in arcs))
            path[-1][1].append((labels.pop(), state))

    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for b in word[common:]:
            labels.append(b)
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    frozen.append(path[0])
    keys, targets, skips = [], [], []
    for state, (final, arcs) in enumerate(frozen):
        skip = int(final)
        for b, t in arcs:
            keys.append(state * 256 + b)
            targets.append(t)
            skips.append(skip)
            skip += words_below[t]
    return {
        "key": np.array(keys, np.int64),
        "target": np.array(targets, np.int32),
        "skip": np.array(skips, np.int32),
        "final": np.array([f for f, _ in frozen], np.int32),
        "out_at": np.cumsum([0, *(len(x) for _, x in entries)]).astype(np.int32),
        "out": np.array([i for _, x in entries for i in x], np.uint32),
    }


FIELDS = ("key", "target", "skip", "final", "out_at", "out")
TYPES = (np.int64, np.int32, np.int32, np.int32, np.int32, np.uint32)


def write_transducer(uri: str, parts: dict[str, np.ndarray]) -> None:
    put_file(uri, [np.array([parts[k].nbytes for k in FIELDS], np.int64).tobytes(), *(parts[k].tobytes() for k in FIELDS)])


@functools.lru_cache(maxsize=2)
def open_transducer(uri: str) -> dict[str, np.ndarray]:
    data, at, out = map_file(uri), 8 * len(FIELDS), {}
    for name, kind, size in zip(FIELDS, TYPES, data[:at].view(np.int64)):
        out[name] = data[at : at + int(size)].view(kind)
        at += int(size)
    return out


def look_up(parts: dict[str, np.ndarray], words: list[bytes]) -> list[bytes | None]:
    """The ids, as packed bytes, of each word; None for words that the automaton doesn't have. All words walk abreast."""
    sizes = np.array([len(w) for w in words], np.int64)
    keys, rank = parts["key"], np.zeros(len(words), np.int64)
    state = np.full(len(words), len(parts["final"]) - 1, np.int64)
    state[(sizes > LEXICON_BYTES) | (sizes == 0)] = -1
    blob = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    for depth in range(int(min(sizes.max(initial=0), LEXICON_BYTES))):
        live = np.flatnonzero((state >= 0) & (sizes > depth))
        if not len(live) or not len(keys):
            state[live] = -1
            break
        want = state[live] * 256 + blob[starts[live] + depth]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[at] == want
        state[live] = np.where(hit, parts["target"][at], -1)
        rank[live] += np.where(hit, parts["skip"][at], 0)
    known = state >= 0
    known[known] = parts["final"][state[known]] == 1
    at, out = parts["out_at"], parts["out"]
    return [out[at[r] : at[r + 1]].tobytes() if k else None for k, r in zip(known.tolist(), rank.tolist())]


# --- the corpus -------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, about a million characters at a time."""
    block, size = [], 0
    for value in column:
        text = value.as_py() or ""
        block.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@functools.cache
def letter_classes() -> np.ndarray:
    """The class that the published pre-tokenizer gives each code point: 0 letter, 1 number, 2 white space, 3 other.

    It is read off the library's own splitting, whose Unicode version is older than that of ``regex``:
    between two letters a letter starts no piece, between two digits a number, and so on. Only what
    the newer version calls a letter, number or space can be one in the older.
    """
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    codes = np.array([c for m in regex.finditer(r"[\p{L}\p{N}\s]+", every) for c in range(*m.span())])
    out = np.full(0x110000, 3, np.uint8)
    for lo in range(0, len(codes), 1 << 10):
        part, alone = codes[lo : lo + (1 << 10)], None
        for k, frame in ((2, "!"), (1, "1"), (0, "a")):
            starts = np.zeros(2 * len(part) + 2, bool)
            starts[[a for _, (a, _) in split(frame + frame.join(map(chr, part)) + frame)]] = True
            inside = ~starts[1:-1:2] & ~starts[2::2]
            out[part[inside]] = 3 if k == 2 else k
            alone = ~inside if alone is None else alone & ~inside
        out[part[alone]] = 2
    return out


SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: what the pattern splits off after an apostrophe


def _cuts(whole: str, code: np.ndarray, edge: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in joined texts; each of the separators at ``edge`` is a piece of its own."""
    kind = classes[code]
    kind[edge] = 4
    n = len(kind)
    runs = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.append(runs[1:], n)
    start = np.zeros(n + 1, bool)
    start[runs] = True
    start[edge] = True  # empty texts: separators side by side
    start[edge + 1] = True
    kinds = kind[runs]
    follows = np.append(kinds[1:], np.uint8(4))
    last = ends[(kinds == 2) & (follows != 4)] - 1  # the last space before something
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    lone = runs[(kinds == 3) & (ends - runs == 1) & (follows == 0)]
    lone = lone[(code[lone] == 39) & start[lone]]  # apostrophes that no space has taken
    for at in lone.tolist():
        for suffix in SUFFIXES:
            end = at + 1 + len(suffix)
            if whole.startswith(suffix, at + 1) and (kind[at + 1 : end] == 0).all():
                start[at + 1] = False
                start[end] = True
                break
    return np.flatnonzero(start[:n])


def pretokens(texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct matches of :data:`PATTERN` in the texts, the number of each match in order, and how many each text has.

    Equal pre-tokens are found by a 64-bit hash of their code points and their length, so only distinct ones become strings.
    """
    whole = "\n".join(texts)
    if not whole:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    edge = np.cumsum(sizes + 1)[:-1] - 1
    starts = _cuts(whole, code, edge, classes)
    ends = np.append(starts[1:], len(code))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], edge + 1, [len(code) + 1]])))
    counts[:-1] -= 1  # the separators
    keep = np.ones(len(starts), bool)
    keep[np.searchsorted(starts, edge)] = False
    starts, ends = starts[keep], ends[keep]
    numbers, _ = pd.factorize(word_hashes(code, starts, ends))
    first = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], numbers, counts


def pretoken_lists(texts: list[str], classes: np.ndarray | None = None) -> list[list[str]]:
    """The matches of :data:`PATTERN` in each text, as lists of strings."""
    words, numbers, counts = pretokens(texts, letter_classes() if classes is None else classes)
    listed = [words[i] for i in numbers.tolist()]
    ends = np.cumsum(counts).tolist()
    return [listed[a:b] for a, b in zip([0, *ends], ends)]


def split_texts(texts: list[str], added: dict[str, int], splitter, classes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """:func:`pretokens`, with added tokens cut out first; such a token stands as a string that no pre-token can equal."""
    if splitter is None or not any(splitter.search(x) for x in texts):
        return pretokens(texts, classes)
    pieces = [splitter.split(x) for x in texts]
    plain = iter(pretoken_lists([x for p in pieces for x in p[::2]], classes))
    lists = [[w for i, x in enumerate(p) for w in ([x] if i % 2 else next(plain))] for p in pieces]
    numbers, words = pd.factorize(np.array([w for x in lists for w in x], object))
    return list(words), numbers, np.array([len(x) for x in lists], np.int64)


def count_pretokens(df: DataFrame, text: str, path: str, table_uri: str) -> DataFrame:
    """(word, n) over every whole text: each task counts its own words first, and passes on partial counts when it holds many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        vocab, seen, classes = vocabulary(path), Counter(), map_file(table_uri)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for block in _texts(batch.column(0)):
                words, numbers, _ = split_texts(block, vocab.added, vocab.split_added, classes)
                for word, n in zip(words, np.bincount(numbers, minlength=len(words)).tolist()):
                    seen[word] += n
                if len(seen) > MEMO_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return df.select(df[text]).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, text: str = "text", path: str | None = None, words: int = LEXICON_WORDS) -> str:
    """Writes the transducer of the corpus's most frequent pre-tokens to the shared folder and returns its place."""
    path = path or default_vocabulary()
    folder = new_folder(df.sparkSession, "lexicon")
    put_file(folder + "/classes.bin", [letter_classes().tobytes()])
    vocab, fits = vocabulary(path), (F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1)
    counts = count_pretokens(df, text, path, folder + "/classes.bin")
    top = counts.where(fits & ~F.col("word").isin([*vocab.added])).orderBy(F.desc("n"), "word").limit(words)
    # at most `words` rows of LEXICON_BYTES each come to the driver
    found = sorted({r.word.encode() for r in top.select("word").toLocalIterator()})
    write_transducer(folder + "/transducer.bin", compile_transducer([(w, vocab.merge(w)) for w in found]))
    return folder


_memos: dict[str, dict[str, bytes]] = {}


def _memo(lexicon: str, start: dict[str, bytes]) -> dict[str, bytes]:
    """What a task remembers; emptied when it holds more than MEMO_WORDS words."""
    memo = _memos.get(lexicon)
    if memo is None or len(memo) > MEMO_WORDS:
        _memos.clear()
        memo = _memos[lexicon] = dict(start)
    return memo


def _gather(outputs: list[bytes], numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The concatenated outputs of each text, whose pre-tokens are given by number."""
    sizes = np.array([len(x) // 4 for x in outputs], np.int64)
    ids, starts, each = np.frombuffer(b"".join(outputs), "<u4"), np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    every = ids[np.repeat(starts[numbers] - (ends - each), each) + np.arange(total)].tobytes()
    cuts = [0, *(4 * np.concatenate([[0], ends])[np.cumsum(counts)]).tolist()]
    return [every[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(df: DataFrame, lexicon: str, text: str = "text", path: str | None = None, decode: bool = False, digests: bool = False) -> DataFrame:
    """``row`` and ``ids`` (packed little-endian unsigned 32-bit integers); with ``decode``, ``decoded`` from the ids.

    With ``digests``, SHA-256 digests stand in for the long columns: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.
    """
    path = path or default_vocabulary()
    row = T.StructField("row", df.schema)
    if digests:
        schema = T.StructType([row, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    else:
        schema = T.StructType([row, T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        vocab, parts, classes = vocabulary(path), open_transducer(lexicon + "/transducer.bin"), map_file(lexicon + "/classes.bin")
        for batch in batches:
            done = 0
            for block in _texts(batch.column(0).field(place)):
                words, numbers, counts = split_texts(block, vocab.added, vocab.split_added, classes)
                memo = _memo(lexicon, {w: np.array([i], "<u4").tobytes() for w, i in vocab.added.items()})
                missing = [w for w in words if w not in memo]
                raw = [w.encode() for w in missing]
                known = look_up(parts, raw)
                rest = iter(vocab.merge_many([w for w, ids in zip(raw, known) if ids is None]))
                for word, ids in zip(missing, known):
                    memo[word] = ids if ids is not None else next(rest)
                packed = _gather([memo[w] for w in words], numbers, counts)
                columns = [batch.column(0).slice(done, len(block))]
                if digests:
                    plain = [vocab.decode_bytes(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in packed]
                    columns += [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain])]
                else:
                    columns.append(pa.array(packed, pa.binary()))
                    if decode:
                        columns.append(pa.array([vocab.decode_bytes(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                done += len(block)
        _memos.clear()  # Spark keeps the worker, other operators need the memory

    place = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(run, schema)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, for every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, compile_lexicon(docs), digests=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
