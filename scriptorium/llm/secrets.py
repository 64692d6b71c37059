"""Secret scans: a keyword automaton, anchored expressions near its hits, checksum validation.

1. An Aho-Corasick automaton over the ASCII-lower-cased text finds every keyword in one pass.
2. Only where a keyword starts is an expression tried, anchored at that place.
   Runs of hexadecimal digits carry no keyword; they are found by their own length rule.
3. Tokens that embed a checksum or a decodable header are kept only if it holds.

Kinds, in the order in which spans at one start are listed:

* ``assign``, ``access``, ``hex``: the base rules; leftmost, non-overlapping within each kind.
* ``github``: ``ghp_ gho_ ghu_ ghs_ ghr_`` and 36 characters, the last six being the base-62 CRC-32 of the 30 before.
* ``npm``: ``npm_`` with the same embedded checksum.
* ``jwt``: three dotted base64url parts, the first decoding to a JSON object with ``alg``.
* ``pem``: a whole private-key block, or its header line where the end is missing.

Defined results: a null or empty text has no spans; very long texts are scanned whole;
repeated rows and null ids are scanned like any other, one result row per input row;
an empty table gives an empty table; other columns are carried along untouched in ``row``. A text is scanned
in time that grows with its length alone.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.llm.shared import lean

# The keywords and patterns of the base rules.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Token formats with something to validate.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT_PART, JWT_REST = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*?-----END (?:[A-Z]+ )?PRIVATE KEY-----)?")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        found.add_word(word, ("github", len(word)))
    for word, kind in (("akia", "access"), ("npm_", "npm"), ("eyj", "jwt"), ("-----begin ", "pem")):
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def base62_crc(text: str) -> str:
    value, out = binascii.crc32(text.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def _jwt_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


def _valid(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= 8
    if kind == "access":
        return len(found[0]) >= 16
    if kind in ("github", "npm"):
        return base62_crc(found[1]) == found[2]
    return True


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": CHECKED, "npm": CHECKED, "pem": PEM}


def _closes(text: str, start: int, end: int) -> bool:
    """Whether the base64 of this stretch ends an object, told from its last characters."""
    last = (end - start) % 4 + 4
    try:
        return base64.urlsafe_b64decode(text[end - last : end] + "=" * (-last % 4)).rstrip().endswith(b"}")
    except ValueError:
        return False


def web_tokens(text: str, starts: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Start and end of each token with a valid header, leftmost first. A start whose header is invalid hides no later one, not even in the same run of letters:
    what has to follow a run is looked at once for all starts in it."""
    over = run = after = 0
    for start in starts:
        if start < over or not text.startswith("eyJ", start):
            continue
        if start >= run:
            run = JWT_PART.match(text, start).end()
            rest = JWT_REST.match(text, run)
            after = rest.end() if rest else 0
        if after and run - start >= 8 and _closes(text, start, run) and _jwt_header(text[start:run]):
            yield start, after
            over = after


def find_secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end) of each span in code points, by start and kind."""
    if not text:
        return []
    small = text.lower()
    if len(small) != len(text):  # a letter whose lower case is longer would move the places
        small = text.translate(_UPPER_TO_LOWER)
    hits: dict[str, set[int]] = {}
    for last, (kind, size) in automaton().iter(small):
        hits.setdefault(kind, set()).add(last + 1 - size)
    spans = []
    for kind, starts in hits.items():
        if kind == "jwt":
            spans += [(start, KINDS.index(kind), kind, end) for start, end in web_tokens(text, sorted(starts))]
            continue
        over = 0
        for start in sorted(starts):
            if start < over:
                continue
            if found := _ANCHORED[kind].match(text, start):
                over = found.end()
                if _valid(kind, found):
                    spans.append((start, KINDS.index(kind), kind, over))
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def redact_text(text: str | None, spans: list[tuple[int, int, str, int]], marker: str = "[secret]") -> str | None:
    """The text with each stretch that spans cover, overlapping ones together, replaced by one marker."""
    if not spans:
        return text
    out, at, upto = [], 0, -1
    for start, _, _, end in spans:
        if start >= upto:
            if upto >= 0:
                at = upto
            out += [text[at:start], marker]
            upto = end
        else:
            upto = max(upto, end)
    return "".join(out) + text[upto:]


def scan_secrets(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``row`` (the whole input row), ``spans`` and, with ``redact``, ``clean`` (the text without its secrets)."""
    fields = [T.StructField("row", df.schema), T.StructField("spans", T.ArrayType(SPAN))]
    schema = T.StructType(fields + [T.StructField("clean", T.StringType())] * redact)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
        lean()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(0).field(place).to_pylist()
                found = [find_secrets(x) for x in texts]
                rows = [[{"start": s, "kind_no": n, "kind": k, "end": e} for s, n, k, e in x] for x in found]
                columns = [part.column(0), pa.array(rows, kind)]
                if redact:
                    columns.append(pa.array([redact_text(x, y) for x, y in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    place = df.columns.index(text)
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(scan, schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every secret of every whole text of ``documents``, with a digest of the base spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select(F.col("row.doc_id").alias("doc_id"), "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind_no"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
