"""Sections by heading, and overlapping chunks of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.functions.text import content_hash, leaf_name, segment_id, token_estimate

MAX_CHARS, OVERLAP = 2000, 200
HEADING = r"^(#{1,3})\s+(.+)$"


def sections(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """(key, others.., section, title, body, start_line, end_line): headings of level 1 to 3 start sections; a blank preamble, section 0, is dropped.

    A text's sections are cut within its row, so that nothing is shuffled; rows that repeat a key are cut each on their own, and a null text has no section.
    """
    lines = df.select(key, *others, F.split(F.regexp_replace(text, r"\n\z", ""), "\n").alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADING), i + 1)), lambda i: i.isNotNull())
    opened = lines.withColumn("opens", F.concat(F.array(F.lit(0)), heads))

    def section(opens: Column, number: Column) -> Column:
        last = F.coalesce(F.get("opens", number + 1) - 1, F.size("lines"))
        title = F.coalesce(F.trim(F.regexp_extract(F.get("lines", opens - 1), HEADING, 2)), F.lit(""))
        body = F.regexp_replace(F.array_join(F.slice("lines", opens + 1, last - opens), "\n"), r"^\s+|\s+$", "")
        return F.struct(number.cast("long").alias("section"), title.alias("title"), body.alias("body"), (opens + 1).alias("start_line"), F.greatest(opens + 1, last).alias("end_line"))

    found = opened.select(key, *others, F.explode(F.transform("opens", section)).alias("found")).select(key, *others, "found.*")
    return found.where((F.col("section") > 0) | (F.col("body") != ""))


def pack_lines(text: str, start_line: int, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """Chunks of whole lines of up to ``max_chars``, each after the first opening with the last lines, up to ``overlap``, of
    the one before it. A longer line is cut on its own, in steps of the difference."""
    held: list[str] = []
    first = start_line
    width = lambda rows: sum(map(len, rows)) + max(0, len(rows) - 1)
    lines = text.splitlines()
    if not text.strip() or not lines:
        yield text, start_line, start_line
        return
    for number, line in enumerate(lines, start_line):
        if len(line) > max_chars:
            if held:
                yield "\n".join(held), first, number - 1
            for at in range(0, len(line), max(1, max_chars - overlap)):
                yield line[at : at + max_chars], number, number
            held, first = [], number + 1
        elif held and width(held) + 1 + len(line) > max_chars:
            yield "\n".join(held), first, number - 1
            keep = len(held)
            while keep and width(held[keep - 1 :]) <= overlap:
                keep -= 1
            held = [*held[keep:], line]
            first = number - len(held) + 1
        else:
            first = number if not held else first
            held.append(line)
    if held:
        yield "\n".join(held), first, number


def chunk_sections(found: DataFrame, *kept: str) -> DataFrame:
    """(kept.., section, title, part, piece, start_line, end_line) for each section of :func:`sections`; blank pieces are dropped."""
    own = (*kept, "section", "title")
    schema = T.StructType([*(found.schema[c] for c in own), T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (body, start) in enumerate(zip(batch.column("body").to_pylist(), batch.column("start_line").to_pylist())):
                for part, (piece, a, b) in enumerate(pack_lines(body, start)):
                    if piece.strip():
                        at.append(i)
                        rows.append((part, piece, a, b))
            if at:
                taken = [batch.column(c).take(pa.array(at)) for c in own]
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return found.select(*own, "body", "start_line").mapInArrow(run, schema)


def annotate(pieces: DataFrame, path: Column) -> DataFrame:
    """Chunks with label, hash, token estimate and segment id."""
    label = F.when(F.col("title") != "", F.col("title")).otherwise(leaf_name(path))
    content = F.regexp_replace(F.concat(label, F.lit("\n\n"), F.col("piece")), r"^\s+|\s+$", "")
    out = pieces.withColumn("source_ref", path).withColumn("content", content)
    return out.select("*", content_hash(F.col("content")).alias("content_hash"), token_estimate(F.col("content")).alias("token_count"), segment_id(F.col("source_ref"), F.col("start_line"), F.col("end_line"), F.col("part"), F.lit("documentation")).alias("segment_id"))


def hard_pieces(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, piece) for each line longer than ``max_chars``, cut in steps of the difference."""
    step = max_chars - overlap
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.length("line") > max_chars)
    return lines.select(key, "line_no", "line", F.posexplode(F.sequence(F.lit(0), F.length("line") - 1, F.lit(step))).alias("piece_no", "at")).select(key, "line_no", "piece_no", F.substring("line", F.col("at") + 1, F.lit(max_chars)).alias("piece"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, paragraph): blank lines part them."""
    return df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("paragraph_no", "paragraph"))


def packed_paragraphs(text: str, most: int, overlap: int) -> Iterator[str]:
    """Pieces of up to ``most`` characters: whole paragraphs while they fit, and before the first that doesn't, the tail of the piece that it ends.
    A paragraph that is itself too long is cut into overlapping parts, and what follows starts without a tail."""
    if len(text) <= most:
        yield text
        return
    piece = ""
    for paragraph in re.split(r"\n\s*\n", text):
        joined = (piece + "\n\n" + paragraph).lstrip("\n")
        if len(piece) + 2 + len(paragraph) <= most:
            piece = joined
            continue
        if piece:
            yield piece
        if len(paragraph) > most:
            yield from (paragraph[at : at + most] for at in range(0, len(paragraph), most - overlap))
            piece = ""
        else:
            tail = piece[-overlap:] if overlap else piece
            piece = (tail + "\n\n" + paragraph).lstrip("\n") if tail else paragraph
    if piece:
        yield piece


def paragraph_pieces(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, piece) for the pieces of each text. A null text has none, an empty one an empty piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                if value.is_valid:
                    pieces = list(packed_paragraphs(value.as_py(), max_chars, overlap))
                    own = batch.column(0).take(pa.array([i] * len(pieces), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=[key, "piece_no", "piece"])

    return df.select(df[key], df[text]).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, piece_no int, piece string")
