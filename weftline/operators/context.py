"""Contexts for prompts: packing into a word budget, formatting, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_order, row_words, split_words

BUDGET = 2500
LEAST = 150
CUT = " …[cut]"
ANSWER_PROMPT = "Sources:\n\n{context}\n\nAnswer from these sources alone, naming each section that you use, in the language of the question.\n\nQuestion: {question}"


def pack(rows: str, budget: int = BUDGET, least: int = LEAST, cut: str = CUT) -> Column:
    """Fit an array of struct(key, title, text, words, must) into a word budget, in order.

    A row that overflows is skipped, and later ones may still fit; a row that must
    stay, or the first one, is shortened instead.  The result has what was packed.
    """
    c = F.col(rows)
    shape = "array<struct<key: string, title: string, text: string, words: int>>"
    zero = F.struct(F.array().cast(shape).alias("out"), F.lit(0).alias("used"))

    def step(s: Column, r: Column) -> Column:
        fits = s["used"] + r["words"] <= budget
        keep = (F.size(s["out"]) == 0) | F.coalesce(r["must"], F.lit(False))
        left = F.greatest(F.lit(least), budget - s["used"])
        short = F.concat(F.array_join(F.slice(split_words(r["text"]), F.lit(1), left), " "), F.lit(cut))

        def add(text: Column, words: Column) -> Column:
            row = F.struct(r["key"].cast("string").alias("key"), r["title"].alias("title"), text.alias("text"), words.cast("int").alias("words"))
            return F.struct(F.array_append(s["out"], row).alias("out"), (s["used"] + words).cast("int").alias("used"))

        return F.when(fits, add(r["text"], r["words"])).when(keep, add(short, row_words(r["title"], short))).otherwise(s)

    return F.aggregate(c, zero, step, lambda s: s["out"])


def format_context(rows: str | Column) -> Column:
    """Blocks of struct(title, text, guidance, section, act_name), joined by blank lines."""
    c = F.col(rows) if isinstance(rows, str) else rows
    cited = lambda r: F.concat(F.lit("Section "), r["section"], F.lit(" of the "), r["act_name"], F.lit(": "), r["title"], F.lit("\n"), r["text"])
    return F.array_join(F.transform(c, lambda r: F.when(r["guidance"], F.concat(r["title"], F.lit(" (guidance)\n"), r["text"])).otherwise(cited(r))), "\n\n")


def prompt(context: Column, question: Column, template: str = ANSWER_PROMPT) -> Column:
    """The template's own braces are the only ones that are filled."""
    head, _, rest = template.partition("{context}")
    middle, _, tail = rest.partition("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def passage(act: Column, section: Column, title: Column, text: Column, most: int = 1600) -> Column:
    return F.concat(act, F.lit(" Section "), section, F.lit(": "), title, F.lit("\n"), F.substring(text, 1, most))


def source_card(act: Column, section: Column, text: Column, most: int = 600) -> Column:
    """A short block for display: bold act and section, then the text's beginning."""
    return F.concat(F.lit("**"), act, F.lit(", Section "), section, F.lit("**\n\n"), F.substring(text, 1, most))


def context_rows(gold: DataFrame, retrieved: DataFrame, key: str, doc: str, is_guidance: Column, exclude: Column, k: int = 8, guidance_slots: int = 2) -> DataFrame:
    """``key``, ``doc``, place: gold first unless excluded, then retrieved rows within k, guidance capped.

    ``gold`` (key, doc, ord) and ``retrieved`` (key, doc, rank and flags).  ``exclude``
    is a column of ``retrieved`` and ``gold``: true for records shown without gold.
    """
    g = gold.where(~exclude).select(key, doc, F.lit(0).alias("_p"), F.col("ord").alias("_o"), F.lit(False).alias("_guide"))
    hidden = gold.select(key, doc)
    rest = retrieved.withColumn("_guide", is_guidance).join(hidden, [key, doc], "left_anti").select(key, doc, F.lit(1).alias("_p"), F.col("rank").alias("_o"), "_guide")
    every = g.unionByName(rest)
    n = F.row_number().over(W.partitionBy(key, "_guide").orderBy("_p", "_o"))
    every = every.withColumn("_n", n).where(F.when(F.col("_guide"), F.col("_n") <= guidance_slots).otherwise((F.col("_p") == 0) | (F.col("_n") <= k)))
    return every.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_p", "_o")).cast("int")).select(key, doc, "place")


def shuffled(rows: DataFrame, key: str, doc: str, into: str = "place") -> DataFrame:
    """Places within each key in a seeded order that hides which row came first."""
    order = hash_order(F.concat_ws(":", F.col(key).cast("string"), F.col(doc).cast("string")))
    return rows.withColumn(into, F.row_number().over(W.partitionBy(key).orderBy(order)).cast("int"))
