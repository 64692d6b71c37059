"""Token counts by section, from one encoding of each whole document.

A document is encoded once. Its tokens' spans follow from the lengths of their bytes, and are joined with
the spans of its sections by a sweep over both, as both are in order. A token that crosses a boundary goes
to one section by an explicit rule: ``majority`` (most of its bytes, ties to the earlier section) or ``first``
(the section of its first byte). So the counts of a document's sections add up to its tokens.

By default sections are lines, each with its line end; ``fields`` joins several columns with a line end between
them and attributes tokens to the columns instead.

Defined results: a null or empty text has no section and no row; a null field is empty and counts no token of its own;
repeated rows and null ids are counted like any other; an empty table gives an empty table; of other columns those
asked for are carried along in ``row``. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.llm.shared import lean, table

RULES = ("majority", "first")
NEWLINE = 10


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the length in bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(token_sizes: np.ndarray, cuts: np.ndarray, rule: str = "majority") -> np.ndarray:
    """The number of tokens of each section. ``cuts`` are the sections' edges in bytes, from 0 to the text's length."""
    ends = np.cumsum(token_sizes)
    starts = ends - token_sizes
    first = np.searchsorted(cuts, starts, "right") - 1
    if rule == "first":
        return np.bincount(first, minlength=len(cuts) - 1)
    last = np.searchsorted(cuts, ends, "left") - 1
    owner = first.copy()
    for t in np.flatnonzero(last > first).tolist():
        edges = np.clip(cuts[first[t] : last[t] + 2], starts[t], ends[t])
        owner[t] += int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(cuts) - 1)


def count_sections(df: DataFrame, keep: list[str], text: str = "text", rule: str = "majority", path: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``keep``), ``section`` (from 0), ``start`` and ``end`` in code points, and ``n_tokens``, for each section of each row."""
    path = path or default_ranks()
    schema = T.StructType([T.StructField("row", df.select(*keep).schema)] + [T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens")])
    columns = [df[c].cast("string").alias(f"field{k}") for k, c in enumerate(fields or [text])]
    many, names = len(columns), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoding, sizes = encoder(path)
        for batch in batches:
            at, found = [], []
            for i, values in enumerate(zip(*(batch.column(1 + k).to_pylist() for k in range(many)))):
                parts = [v or "" for v in values]
                whole = "\n".join(parts)
                if not any(parts):
                    continue
                data = np.frombuffer(whole.encode(), np.uint8)
                tokens = sizes[np.asarray(encoding.encode_ordinary(whole))]
                if fields:
                    lengths = np.array([len(p.encode()) + 1 for p in parts])
                    lengths[-1] -= 1
                    cuts = np.concatenate([[0], np.cumsum(lengths)])
                else:
                    cuts = np.concatenate([[0], np.flatnonzero(data == NEWLINE) + 1])
                    cuts = cuts if cuts[-1] == len(data) else np.append(cuts, len(data))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[cuts]
                count = attribute(tokens, cuts, rule)
                at.append(np.full(len(count), i))
                found.append(np.stack([np.arange(len(count)), points[:-1], points[1:], count]))
                if sum(map(len, at)) > 50_000:
                    yield _rows(batch, at, found, names)
                    at, found = [], []
            if at:
                yield _rows(batch, at, found, names)

    return df.select(F.struct(*[df[c] for c in keep]).alias("row"), *columns).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, at: list[np.ndarray], found: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    values = np.concatenate(found, 1).astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), *(pa.array(v) for v in values)], names=names)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each line of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_sections(docs, ["doc_id"]).select("row.doc_id", "section", "start", "end", "n_tokens")
