"""Text quality, hashing, slugs and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

READABLE = r"[\t\n\u000B\f\r\u0020-\u007E\u00A0-\u024F\u2000-\u206F\u4E00-\u9FFF]"
CONTROL = r"[\u0000-\u0008\u000E-\u001F]"
WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_rules(pattern: str) -> str:
    """The expression as SQL reads it, for Java: words and white space of ASCII alone, cases of all letters, and a dot for all but the line feed."""
    for here, there in ((r"\b", WORD_EDGE), (r"\s", r"[\t\n\f\r ]"), (r"\S", r"[^\t\n\f\r ]"), ("(?i)", "(?iu)")):
        pattern = pattern.replace(here, there)
    return "(?d)" + pattern


def readable_ratio(text: Column) -> Column:
    """The share of readable characters, 0 for an empty text."""
    size = F.length(text)
    return F.when(size == 0, 0.0).otherwise((size - F.length(F.regexp_replace(text, READABLE + "+", ""))) / size)


def control_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, CONTROL + "+", ""))


def replacement_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\ufffd", ""))


def is_binary(text: Column) -> Column:
    bad = control_count(text) + replacement_count(text)
    return F.coalesce((F.length(text) == 0) | (bad > F.greatest(F.lit(3), F.floor(F.length(text) / 100))) | (readable_ratio(text) < 0.70), F.lit(True))


def is_mojibake(text: Column) -> Column:
    size = F.length(text)
    return F.coalesce((size == 0) | (replacement_count(text) > F.greatest(F.lit(3), F.floor(size / 150))) | ((size > 400) & (control_count(text) > F.floor(size / 40))), F.lit(True))


def xref_ratio(text: Column) -> Column:
    """The share of non-blank lines that look like cross-reference entries."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(r"^\d{6,12} \d{1,6} [nf]\s*$"))) / F.size(lines)).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cache_key(text: Column) -> Column:
    """The hash of a text with unified line ends and no surrounding white space."""
    return content_hash(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""))


def slug(text: Column, limit: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit), "-+$", "")


def leaf_name(path: Column) -> Column:
    """The last part of a path, without a virtual file id in brackets."""
    return F.regexp_replace(F.trim(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)), r"\s*\[[a-zA-Z0-9_\-]{10,100}\]\s*$", "")


def segment_id(path: Column, start: Column, end: Column, part: Column, kind: Column) -> Column:
    spans = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), kind)
    parts = F.concat(path, F.lit(":part-"), part.cast("string"), F.lit(":"), kind)
    return F.when(path.isNull() | (path == ""), F.lit(None).cast("string")).otherwise(F.coalesce(spans, parts, F.concat(path, F.lit(":"), kind)))
