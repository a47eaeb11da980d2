"""Chat records: nested messages and metadata, plans of generation tasks, parsed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_fraction, split_words


def messages(rows: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and messages: an array of (role, content) in turn order; one conversation is one row."""
    turn = F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(text).alias("content"))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_m"))
    return got.select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def first_content(role: str, col: str = "messages") -> Column:
    """Content of the first message of a role; null without one."""
    return F.get(F.filter(F.col(col), lambda m: m["role"] == role), F.lit(0))["content"]


def last_content(col: str = "messages") -> Column:
    return F.get(F.col(col), F.size(col) - 1)["content"]


def with_first_content(role: str, content: Column, col: str = "messages") -> Column:
    """The messages with the first one of a role replaced, all others untouched."""
    at = F.array_position(F.transform(F.col(col), lambda m: m["role"]), F.lit(role)) - 1
    return F.transform(F.col(col), lambda m, i: F.when(i == at, F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m))


def section_key(act: str = "act_id", section: str = "section") -> Column:
    return F.concat(F.col(act), F.lit(":"), F.upper(F.col(section)))


def gold_keys(col: str | Column) -> Column:
    """act:section keys with the act lower-cased and the section upper-cased."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda s: F.concat(F.lower(F.element_at(F.split(s, ":"), 1)), F.lit(":"), F.upper(F.element_at(F.split(s, ":"), 2))))


def split_key(sections: str, record_id: str) -> Column:
    """The sorted source sections, joined; the record's own id if it has none."""
    joined = F.array_join(F.sort_array(F.coalesce(F.col(sections), F.array().cast("array<string>"))), "|")
    return F.when(joined == "", F.col(record_id).cast("string")).otherwise(joined)


def task_id(prefix: str, number: Column, prompt: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(number.cast("string"), 6, "0"), F.lit("_"), F.substring(F.sha2(prompt, 256), 1, 8))


def round_robin(rows: DataFrame, group: str, order: list[Column], into: str = "turn") -> DataFrame:
    """Number rows so that groups take turns: all firsts by group, then all seconds, and so on.

    Ranges of the number can be handed to consumers of a shared pool.
    """
    own = rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    # a position is the rows of earlier turns plus those of the turn's earlier groups: counts by (turn, group) suffice
    sizes = own.groupBy("_n").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_n", F.coalesce(F.sum("_size").over(W.orderBy("_n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = own.withColumn("_in", F.row_number().over(W.partitionBy("_n").orderBy(group)))
    return placed.join(before, "_n").withColumn(into, (F.col("_before") + F.col("_in")).cast("int")).drop("_n", "_in", "_before")


def allocate(pool: DataFrame, slices: list[tuple[str, int]], turn: str = "turn") -> DataFrame:
    """Give each slice the next rows of a numbered pool: adds task_type."""
    out, at = F.lit(None).cast("string"), 0
    for name, count in slices:
        out, at = F.when(F.col(turn).between(at + 1, at + count), F.lit(name)).otherwise(out), at + count
    return pool.withColumn("task_type", out).where("task_type is not null")


def is_miss(gold: str, record_id: str, fraction: float, seed: str = "7") -> Column:
    """A record with gold whose own number falls below the fraction is shown without it."""
    return (F.size(gold) > 0) & (hash_fraction(record_id, seed=f"{seed}:") < fraction)


def sample_plan(plan: DataFrame, position: Column, samples: int, fraction: float) -> DataFrame:
    """Every task once, and the first ``fraction`` by ``position`` (0 to 1) ``samples`` times: adds sample_id."""
    n = F.when(position < fraction, samples).otherwise(1)
    return plan.withColumn("sample_id", F.explode(F.sequence(F.lit(0), n - 1)))


ITEMS = "array<map<string,string>>"


def parse_items(raw: str) -> Column:
    """The first JSON list of objects in an answer: fenced blocks first, then the whole text."""
    blocks = F.concat(F.regexp_extract_all(F.col(raw), F.lit(r"[`]{3}(?:json)?([\s\S]*?)[`]{3}"), F.lit(1)), F.array(F.col(raw)))
    lists = F.transform(blocks, lambda b: F.regexp_extract(b, r"(\[[\s\S]*\])", 1))
    parsed = F.filter(F.transform(lists, lambda x: F.from_json(F.nullif(x, F.lit("")), ITEMS)), lambda v: v.isNotNull() & F.exists(v, lambda o: o.isNotNull()))
    return F.get(parsed, F.lit(0))


def parse_answers(rows: DataFrame, key: str, raw: str, first: str = "question", second: str = "answer") -> DataFrame:
    """``key``, n (position in the list from 1, counting skipped items), id, question, answer."""
    items = rows.select(key, F.posexplode(parse_items(raw)).alias("_i", "_o")).where("_o is not null")
    q, a = F.trim(F.coalesce(F.element_at("_o", first), F.lit(""))), F.trim(F.coalesce(F.element_at("_o", second), F.lit("")))
    out = items.select(key, (F.col("_i") + 1).cast("int").alias("n"), q.alias("question"), a.alias("answer")).where("question <> '' and answer <> ''")
    return out.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("_"), F.lpad(F.col("n").cast("string"), 2, "0")))


def plain_answer(raw: str | Column, least: int = 20) -> Column:
    """The answer without a leading label; null if it has fewer than ``least`` words."""
    c = F.col(raw) if isinstance(raw, str) else raw
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:उत्तर|answer)[\s]*[：:][\s]*", "")
    return F.when(F.size(split_words(t)) >= least, t)


def preference_pairs(answers: DataFrame, task: str, sample: str, good: Column, reason: str, keep: tuple[str, ...]) -> DataFrame:
    """``task``, chosen, rejected, reject_reason: each rejected answer with its task's first good one."""
    first = answers.where(good).groupBy(task).agg(F.min_by("answer", sample).alias("chosen"))
    bad = answers.where(~good & F.col(reason).isin(*keep)).select(task, F.col("answer").alias("rejected"), F.col(reason).alias("reject_reason"), sample)
    return bad.join(first, task)


def first_sample(rows: DataFrame, task: str, sample: str) -> DataFrame:
    """One row per task: that of the least sample."""
    names = [c for c in rows.columns if c != task]
    return rows.groupBy(task).agg(F.min_by(F.struct(*names), sample).alias("_r")).select(task, "_r.*")
