"""Conversation turns: stop words, blanks, errors, context and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip

# What a user says to end a session.
STOP_WORDS = ("退出", "exit", "stop")


def is_stop(text: Column) -> Column:
    return F.lower(strip(text)).isin(*STOP_WORDS)


def before_first(turns: DataFrame, flag: Column, *, inclusive: bool = False) -> DataFrame:
    """The turns of each conversation before (or up to) the first flagged one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    window = order.rowsBetween(Window.unboundedPreceding, -1 if inclusive else 0)
    return turns.withColumn("_ended", F.coalesce(F.max(flag.cast("int")).over(window), F.lit(0))).where("_ended = 0").drop("_ended")


def until_stop(turns: DataFrame) -> DataFrame:
    return before_first(turns, is_stop(F.col("text")) & (F.col("role") == "user"))


def drop_blank(turns: DataFrame) -> DataFrame:
    return turns.where(strip(F.col("text")) != "")


def with_status(turns: DataFrame, is_error: Column) -> DataFrame:
    """Turns up to and including the first error, each with its status."""
    return before_first(turns, is_error, inclusive=True).withColumn("status", F.when(is_error, "error").otherwise("ok"))


#: Characters of earlier turns that a turn sees, if nothing else is said.
BUDGET = 30_000


def context(turns: DataFrame, history: int | None = None, budget: int | None = BUDGET) -> DataFrame:
    """What each user turn sees of earlier turns: their number, their characters and their texts (``role: text``, one a line).

    It sees the latest turns that, written out, fit into ``budget`` characters together with those
    after them, and ``history`` turns at most; None sets no bound, and without a budget the
    texts of a conversation grow with the square of its turns.  Null texts and roles are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = F.concat_ws(": ", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    # where each turn begins in the conversation written out; every turn takes a character at least
    begin = F.coalesce(F.sum(F.length("_said") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("_text"), said.alias("_said")).withColumns({"_begin": begin, "_number": F.row_number().over(order)})
    if history is None:
        by, low = "_begin", Window.unboundedPreceding if budget is None else -budget
        seen = Window.partitionBy("conv_id").orderBy(by).rangeBetween(low, -1)
    else:
        seen = Window.partitionBy("conv_id").orderBy("_number").rowsBetween(-history, -1)
    items = F.collect_list(F.struct(F.col("_begin").alias("b"), F.length("_text").alias("n"), F.col("_said").alias("s"))).over(seen)
    rows = rows.withColumn("_items", items if history is None or budget is None else F.filter(items, lambda x: F.col("_begin") - x["b"] <= budget))
    told = rows.where("role = 'user'")
    return told.select("conv_id", "turn", F.size("_items").cast("long").alias("n_before"), F.aggregate("_items", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("chars_before"), F.array_join(F.transform("_items", lambda x: x["s"]), "\n").alias("context"))


def pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it at once."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "question", "answer")
