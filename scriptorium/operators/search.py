"""Ranked full-text search of a whole set of questions in web search syntax, over an inverted index by word.

A question is made of groups, parted by an ``or`` between two terms; a group of terms, all of which a chunk must have or,
after ``-``, must not have; a term of words, which have to follow each other: what stands in quotes, to the end of the question
if the quote is left open, or else a run without spaces, whose words are its letters and digits. Repeated terms of a group count once, a
term without words not at all, and a group without a required term matches nothing.

The distinct words of each chunk are written once. The chunks of each required word are counted there; then each group's rarest word in its
twin names the chunks that may match, and of these stay the ones that hold all its required words. Only the chunks left get the
places of words, those of the questions that they match, and phrases and exclusions are looked at there. Rows are dealt by chunk once, all
later grouping is within chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.operators.retrieval import few
from scriptorium.sources.folders import stored

WORD_GAP = r"[^\p{L}\p{N}]+"
TERM = r'-?"[^"]*"?|[^\s"!&|()]+'
# What a word costs in a cover, by where it stands; the inverse of its weight there.
PATH_COST, CONTENT_COST = 1.0, 2.5
LEXICAL_FLOOR, LEXICAL_CAP = 0.35, 0.95
PAIR = ("query_id", "chunk_id")
# so many chunks are searched by a task, that its memory doesn't grow with the corpus
CHUNKS_PER_TASK = 2000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def terms(asked: DataFrame) -> DataFrame:
    """(query_id, twin_id, grp, item, negative, words) for the terms of each (query_id, twin_id, query)."""
    cut = asked.select("query_id", "twin_id", F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(TERM), 0).alias("parts"))
    # an `or` between two terms parts groups; of several in a row, the first
    parting = lambda x, i: (F.lower(x) == "or") & (i > 0) & (i < F.size("parts") - 1) & (F.lower(F.get("parts", i - 1)) != "or")
    marked = cut.withColumn("ors", F.array_compact(F.transform("parts", lambda x, i: F.when(parting(x, i), i))))
    each = marked.select("query_id", "twin_id", "ors", F.posexplode("parts").alias("item", "part")).where(~F.array_contains("ors", F.col("item")))
    grp = F.size(F.filter("ors", lambda i: i < F.col("item"))).alias("grp")
    found = each.select("query_id", "twin_id", grp, "item", F.col("part").startswith("-").alias("negative"), words(F.col("part")).alias("words"))
    return found.where(F.size("words") > 0).groupBy("query_id", "twin_id", "grp", "negative", "words").agg(F.min("item").alias("item"))


def spelled(chunks: DataFrame) -> DataFrame:
    """(chunk_id, twin_id, ws): the distinct words of each chunk's path and content."""
    return chunks.select("chunk_id", "twin_id", F.array_distinct(F.concat(words(F.col("source_ref")), words(F.col("content")))).alias("ws"))


def groups(wanted: DataFrame, spelt: DataFrame) -> DataFrame:
    """(query_id, twin_id, grp, word, all): the required words of each group, the one in the fewest chunks of its twin first and by itself.
    Groups with a word that no chunk of the twin has are left out."""
    required = wanted.where("not negative").select("query_id", "twin_id", "grp", F.explode("words").alias("word")).distinct()
    each = spelt.select("twin_id", F.explode("ws").alias("word")).join(few(required.select("twin_id", "word").distinct()), ["twin_id", "word"])
    often = each.groupBy("twin_id", "word").agg(F.count("*").alias("chunks"))
    ranked = required.join(often, ["twin_id", "word"], "left")
    by_group = ranked.groupBy("query_id", "twin_id", "grp").agg(F.min(F.coalesce("chunks", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct("chunks", "word"))).alias("all"))
    return by_group.where("least > 0").select("query_id", "twin_id", "grp", F.col("all")[0]["word"].alias("word"), F.col("all.word").alias("all"))


def holding(named: DataFrame, spelt: DataFrame) -> DataFrame:
    """(query_id, grp, chunk_id): the chunks that hold all required words of a group. Those with its rarest word are found first, without a copy of their words each."""
    each = spelt.select("chunk_id", "twin_id", F.explode("ws").alias("word")).join(few(named.select("query_id", "twin_id", "grp", "word")), ["twin_id", "word"])
    some = stored(each.select("query_id", "grp", "chunk_id"), "some")
    both = spelt.select("chunk_id", "ws").join(few(some), "chunk_id").join(few(named.select("query_id", "grp", "all")), ["query_id", "grp"])
    return both.where(F.forall("all", lambda w: F.array_contains("ws", w))).select("query_id", "grp", "chunk_id")


def held_words(wanted: DataFrame, whole: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, twin_id, source_ref, first, places): where the words of the questions stand that a chunk holds a group of, by word.

    Words of the path come first, ``first`` of them, those of the content go on from there. The rows stay dealt by chunk.
    """
    asked_words = wanted.select("query_id", F.explode("words").alias("word")).distinct()
    needed = whole.select("query_id", "chunk_id").distinct().join(few(asked_words), "query_id").groupBy("chunk_id").agg(F.collect_set("word").alias("needed"))
    head, body = words(F.col("source_ref")), words(F.col("content"))
    texts = chunks.select("chunk_id", "twin_id", "source_ref", "content").join(few(stored(needed, "needed")), "chunk_id")
    each = texts.select("chunk_id", "twin_id", "source_ref", "needed", F.size(head).alias("first"), F.posexplode(F.concat(head, body)).alias("pos", "word")).where(F.array_contains("needed", F.col("word")))
    chunk = ("chunk_id", "twin_id", "source_ref", "first")
    by_word = each.repartition("chunk_id").groupBy(*chunk, "word").agg(F.collect_list(F.col("pos") + 1).alias("at"))
    return by_word.groupBy(*chunk).agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("places"))


def stands(ws: Column, places: Column) -> Column:
    """Whether the words follow each other somewhere."""
    begins = F.transform(ws, lambda w, k: F.transform(F.coalesce(F.try_element_at(places, w), F.array().cast("array<int>")), lambda p: p - k))
    return F.size(F.aggregate(begins, F.get(begins, F.lit(0)), lambda both, one: F.array_intersect(both, one))) > 0


def uses(wanted: DataFrame) -> DataFrame:
    """(query_id, vocabulary): the words of each question, whether any term requires them, and their places in its terms.
    ``n`` is the number of required terms of the group."""
    needs = wanted.where("not negative").groupBy("query_id", "grp").agg(F.count("*").alias("n"))
    each = wanted.join(needs, ["query_id", "grp"]).select("query_id", "grp", "item", "negative", "n", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    by_word = each.groupBy("query_id", "word").agg(F.bool_or(~F.col("negative")).alias("plain"), F.collect_list(F.struct("grp", "item", "negative", "n", "size", "offset")).alias("uses"))
    return by_word.groupBy("query_id").agg(F.collect_list(F.struct("word", "plain", "uses")).alias("vocabulary"))


def occurrences(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where the required terms of the groups that match stand in the chunks: (query_id, chunk_id, source_ref, grp, item, n, items, size, pos, own, idx, upto).

    ``pos`` is the place of a term's last word, ``own`` the cost of all its words, ``idx`` and ``upto`` the number and the cost of all required
    words of the question up to there, ``items`` the terms of the group. All steps keep to the chunk's own partition.
    """
    found = terms(asked)
    spelt = stored(spelled(chunks), "spelled")
    whole = stored(holding(stored(groups(found, spelt), "groups"), spelt), "whole")
    held = stored(held_words(found, whole, chunks), "held")
    judging = found.groupBy("query_id", "grp").agg(F.collect_list(F.struct("negative", "words")).alias("terms"))
    named = held.repartition(1 + held.count() // CHUNKS_PER_TASK, "chunk_id").join(few(whole), "chunk_id").join(few(judging), ["query_id", "grp"])
    whole_groups = named.where(F.forall("terms", lambda t: stands(t["words"], F.col("places")) != t["negative"]))
    placed = whole_groups.dropDuplicates(PAIR).join(few(uses(found)), "query_id")
    there = F.filter("vocabulary", lambda v: F.map_contains_key("places", v["word"]))
    spots = F.flatten(F.transform(there, lambda v: F.transform(F.col("places")[v["word"]], lambda p: F.struct(p.alias("pos"), v["plain"].alias("plain"), v["uses"].alias("uses")))))
    hits = placed.select(*PAIR, "source_ref", "first", F.explode(spots).alias("hit")).select(*PAIR, "source_ref", "hit.*", F.when(F.col("hit.pos") <= F.col("first"), PATH_COST).otherwise(CONTENT_COST).alias("cost"))
    in_order = Window.partitionBy(*PAIR).orderBy("pos")
    numbered = hits.withColumn("idx", F.sum(F.col("plain").cast("int")).over(in_order)).withColumn("upto", F.sum(F.when(F.col("plain"), F.col("cost")).otherwise(0.0)).over(in_order))
    at = numbered.select(*PAIR, "source_ref", "pos", "cost", "idx", "upto", F.explode("uses").alias("use")).select(*PAIR, "source_ref", "pos", "cost", "idx", "upto", "use.*")
    end = (F.col("pos") - F.col("offset") + F.col("size") - 1).alias("end")
    term = at.groupBy(*PAIR, "source_ref", "grp", "item", "negative", "n", "size", end).agg(F.count("*").alias("held"), F.sum("cost").alias("own"), F.max("idx").alias("idx"), F.max("upto").alias("upto")).where("held = size")
    group = Window.partitionBy(*PAIR, "grp")
    judged = term.withColumn("items", F.collect_set(F.when(~F.col("negative"), F.col("item"))).over(group)).withColumn("hurt", F.bool_or("negative").over(group))
    return judged.where((F.size("items") == F.col("n")) & ~F.col("hurt")).select(*PAIR, "source_ref", "grp", "item", "n", "items", "size", F.col("end").alias("pos"), "own", "idx", "upto")


def cover_density(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, source_ref, covers, density): over the least stretches that satisfy a question, their mean weight by the other words within."""
    # the words of a term follow each other, so that they are so many entries in a row
    begin = F.struct((F.col("idx") - F.col("size") + 1).alias("idx"), (F.col("pos") - F.col("size") + 1).alias("pos"), (F.col("upto") - F.col("own")).alias("before"))
    each = occurrences(asked, chunks).select(*PAIR, "source_ref", "grp", "item", "n", "items", "idx", "pos", "upto", begin.alias("begin")).withColumn("other", F.explode("items"))
    last = each.withColumn("last", F.max(F.when(F.col("item") == F.col("other"), F.col("begin"))).over(Window.partitionBy(*PAIR, "grp", "other").orderBy("idx")))
    # a stretch that ends here begins with the term whose last place is furthest back; of several groups the shortest stretch counts
    by_group = last.groupBy(*PAIR, "source_ref", "grp", "n", "idx", "pos", "upto").agg(F.min("last").alias("begin"), F.count_distinct(F.when(F.col("last").isNotNull(), F.col("other"))).alias("held")).where("held = n")
    stretches = by_group.groupBy(*PAIR, "source_ref", "idx", "pos", "upto").agg(F.max("begin").alias("begin"))
    covers = stretches.withColumn("earlier", F.lag("begin.idx").over(Window.partitionBy(*PAIR).orderBy("idx"))).where("earlier is null or begin.idx > earlier")
    inner = F.col("idx") - F.col("begin.idx")
    weight = (inner + 1) / (F.col("upto") - F.col("begin.before")) / (1 + F.col("pos") - F.col("begin.pos") - inner)
    return covers.groupBy(*PAIR, "source_ref").agg(F.count("*").alias("covers"), F.sum(weight).alias("density"))


def lexical_score(density: Column) -> Column:
    return F.round(F.least(F.lit(LEXICAL_CAP), LEXICAL_FLOOR + density), 6)
