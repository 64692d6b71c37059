"""Names of several words in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def plain(text: Column) -> Column:
    """In lower case, with one blank for each run of white space inside and none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x20]+", " "))


def longest_alias(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text_id, alias_id, alias) for each of ``texts`` (text_id, text) that has one of ``aliases`` (alias_id, alias) between blanks:
    the longest, of equally long ones that of the smallest id. Case and the length of blanks don't count.

    An alias is looked for where the one of its words is that the fewest texts have; texts and aliases meet by that word, never
    each with each. Null or blank texts and aliases match nothing; rows that repeat a text_id count as one text's parts.
    """
    names = aliases.select("alias_id", plain(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    said = texts.select("text_id", plain(F.col("text")).alias("said")).where("said <> ''")
    words = said.select("text_id", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    parts = names.select("*", F.explode(F.array_distinct(F.split("alias", " "))).alias("word"))
    counts = words.join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "word", "left").groupBy("alias_id", "alias").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("of"))
    hits = words.join(rarest.select("alias_id", "alias", F.col("of.word").alias("word")), "word").select("text_id", "alias_id", "alias").distinct()
    inside = F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" ")))
    best = F.min(F.struct((-F.length("alias")).alias("n"), "alias_id", "alias"))
    return hits.join(said, "text_id").where(inside).groupBy("text_id").agg(best.alias("best")).select("text_id", "best.alias_id", "best.alias")
