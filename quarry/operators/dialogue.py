"""Conversations: history windows, rule-based tags, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.tables import first_n


def history_window(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of every conversation."""
    return first_n(turns, ["conv_id"], [F.desc("turn")], n)


def tag_intents(turns: DataFrame, rules: list[tuple[str, list[str]]], least_words: int = 5) -> DataFrame:
    """Turns with an intent: the first rule with a fragment in the text, a long enough question, else "undecided"."""
    low, tag = F.lower("text"), None
    for name, parts in rules:
        hit = reduce(lambda x, y: x | y, [low.contains(p.lower()) for p in parts])
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    question = F.col("text").contains("?") & (F.size(F.split(F.trim("text"), " ")) >= least_words)
    tag = F.when(question, "question") if tag is None else tag.when(question, "question")
    return turns.withColumn("intent", tag.otherwise("undecided"))


def exported(turns: DataFrame, kind: str = "md") -> DataFrame:
    """(conv_id, text): one block per turn, in order, as Markdown or plain text ("txt"); tools[] used follow their turn."""
    tools = F.array_join("tools", ", ") if "tools" in turns.columns else F.lit("")
    if kind == "md":
        head, used = F.concat(F.lit("### **"), F.initcap("role"), F.lit("**\n\n")), F.concat(F.lit("\n**Tools used:** "), tools, F.lit("\n"))
    else:
        head, used = F.concat(F.lit("["), F.upper("role"), F.lit("]\n")), F.concat(F.lit("\n[TOOLS] "), tools, F.lit("\n"))
    block = F.concat(head, F.col("text"), F.lit("\n"), F.when(F.coalesce(tools, F.lit("")) != "", used).otherwise(""))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "\n").alias("text"))


def routed(tagged: DataFrame, strategies: list[tuple[str, list[str]]], intent: str = "question", default: str = "hybrid") -> DataFrame:
    """Turns with a strategy: for those of ``intent`` the first rule with a fragment in the text, else ``default``; null for others."""
    low, out = F.lower("text"), F.lit(default)
    for name, parts in reversed(strategies):
        out = F.when(reduce(lambda x, y: x | y, [low.contains(p.lower()) for p in parts]), name).otherwise(out)
    return tagged.withColumn("strategy", F.when(F.col("intent") == intent, out))


def answer_sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.sum(C.estimated_tokens("text")).alias("tokens"))
