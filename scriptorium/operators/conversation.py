"""Windows over conversations and budgets over ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HISTORY_MESSAGES, MESSAGE_CHARS, HISTORY_CHARS = 20, 2000, 12_000
CUT_MARK = " …[truncated]"


def history(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last messages of each session that fit the budget, newest first until one doesn't, each cut to its own limit."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    cut = F.when(F.length("text") > MESSAGE_CHARS, F.concat(F.substring("text", 1, MESSAGE_CHARS), F.lit(CUT_MARK))).otherwise(F.col("text"))
    recent = messages.where("role <> 'system'").withColumn("no", F.row_number().over(newest)).where(F.col("no") <= HISTORY_MESSAGES).withColumn("text", cut)
    spent = F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return recent.withColumn("spent", spent).where(F.col("spent") <= HISTORY_CHARS).drop("no", "spent")


def budget_prefix(df: DataFrame, group: str, order: list[Column], size: Column, rows: int, total: int) -> DataFrame:
    """The first ``rows`` rows of each group, as long as their sizes together stay within ``total``."""
    window = Window.partitionBy(group).orderBy(*order)
    kept = df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= rows)
    return kept.withColumn("spent", F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= total)


def excerpt(messages: DataFrame, session: str = "conv_id", order: str = "turn", last: int = 14, chars: int = 900, tail: int = 2500) -> DataFrame:
    """The end of each session's last messages, each cut, as lines of role and text."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    recent = messages.withColumn("no", F.row_number().over(newest)).where(F.col("no") <= last)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars))
    lines = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return recent.groupBy(session).agg(F.right(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(tail)).alias("excerpt"))
