"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end as a stream of
words, which is cut into blocks of equal word counts.  Slot t of the mix takes the
point frac((t + 1) * golden ratio), maps it through the sources' cumulative shares
and so names a source; its rank among that source's slots names the block.  Ranks
run on into a second pass over the stream, and the last block of a source is cut
at its target.  The targets weigh sources ``WEIGHTS`` in turn, by code point with null
last, and share ``share`` of all words; a target stops at ``most`` times its
source, and the excess is shared again by weight.

Defined cases: a null text has size 0, null source is a source of its own, null
doc_ids are ordered by their sizes and then by their rows' hashes; texts without words
are in the mix with 0 words taken; an empty table gives an empty result.  Repeated rows
are separate documents.  Columns of any name pass.

Scale: the mix is planned on (doc_id, source, size, hash of the row) alone.  Prefix sums
go over hash buckets of bounded size and then within a bucket, so that a source that
holds a third of all rows is spread over many tasks.  A row per bucket and a row per
slot are the next largest tables; neither comes to the driver.  Windows without a
partition hold a row per source.  Whole rows move twice: to their places in the plan,
by their hashes, and to their slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, count_space_separated, packed, saved, sliced, texts

WEIGHTS = (3, 1, 2)
GOLDEN = 0.6180339887498949
#: Rows that one prefix-sum task should hold.
BUCKET_ROWS = 20_000
#: Slots that one partition of the mixed texts should hold, and the most partitions.
SLOTS_PER_PART, MOST_PARTS = 512, 10_000


def with_sizes(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and size: the number of ``[^\\x20\\x09-\\x0D]+`` in the text.  No shuffle."""
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, off = texts(batch.column(len(carry)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count_space_separated(data, off))], names=[*names, "size"])

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    out = docs.select(*[col(c).alias(n) for n, c in zip(names, carry, strict=True)], "text").mapInArrow(run, f"{kinds}, size long")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "size")


def source_key(column: str = "source") -> Column:
    """A string that is never null and equal just for equal sources, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_key, source, source_size, weight, target: one row per source.

    The limit that resharing reaches is target = min(most * size, level * weight).
    Sources are taken in order of size / weight; those before the first whose own
    level suffices for all the rest stop at their limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", pick.cast("long"))
    by = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    per = per.withColumn("rest", F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    per = per.withColumn("left_weight", F.sum("weight").over(after))
    per = per.withColumn("free", F.lit(most) * F.col("source_size") * F.col("left_weight") >= F.col("weight") * F.col("rest"))
    per = per.withColumn("n", F.row_number().over(by))
    per = per.withColumn("first", F.min(F.when(F.col("free"), F.col("n"))).over(everything))
    rest = F.max(F.when(F.col("n") == F.col("first"), F.col("rest"))).over(everything)
    left = F.max(F.when(F.col("n") == F.col("first"), F.col("left_weight"))).over(everything)
    target = F.when(F.col("n") >= F.col("first"), F.col("weight") * rest / left).otherwise(F.lit(most) * F.col("source_size"))
    return per.select(source_key().alias("source_key"), "source", "source_size", "weight", target.alias("target"), F.floor(target + 0.5).cast("long").alias("goal"))


def shuffle_key(seed: str = "") -> Column:
    """Order of documents within a source: the digest of the seed and the doc_id."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def shuffled_streams(sizes: DataFrame, n_rows: int, seed: str = "") -> DataFrame:
    """``sizes``, source_key and from_word: where the document begins in its source's shuffled stream.

    ``n_rows`` fixes the number of hash buckets; it doesn't change the result.
    """
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = sizes.withColumn("source_key", source_key()).withColumn("_key", shuffle_key(seed))
    # a bucket is a range of the key's first 32 bits, so the order of buckets is that of keys
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets))
    ahead = W.partitionBy("source_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_sum"))
    bases = bases.select("source_key", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    ties = [c for c in ("row_hash", "row_hash2") if c in sizes.columns]
    own = W.partitionBy("source_key", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = rows.join(bases, ["source_key", "_bucket"])
    return joined.select(*sizes.columns, "source_key", (F.col("_base") + F.col("_inner")).alias("from_word"))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """slot, source_key, block_no: which block of which source each slot of the mix takes.

    Golden-ratio points keep every source's count among any first slots within
    O(log n) of its share.  There are as many slots as blocks; the few blocks that
    a source still lacks then follow at the end, and slots beyond a source's last
    block stay unused.  The result holds every block of every source once.
    """
    spark = goals.sparkSession
    need = F.ceil(F.col("goal") / block).cast("long")
    order, everything = W.orderBy("source_key"), W.partitionBy(F.lit(1))
    bands = goals.where("goal > 0").select("source_key", need.alias("need"))
    bands = bands.withColumn("high", F.sum("need").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("need").over(everything)).withColumn("sources", F.count(F.lit(1)).over(everything))
    bands = bands.select("source_key", "need", "sources", "all", ((F.col("high") - F.col("need")) / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"))
    top = bands.agg(F.max("all"), F.max("sources")).first()
    if not top[0]:
        return spark.createDataFrame([], "slot long, source_key string, block_no long")
    total, cells = int(top[0]), 4 * int(top[1])
    # points and bands meet in equal cells of [0, 1), so this is an equi-join of two even sides
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 1) * {GOLDEN}D, 1D)").alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    bands = bands.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    named = slots.join(bands, "cell").where("u >= low and u < high").select("slot", "source_key", "need", F.floor(F.col("slot") / 65536).alias("chunk"))
    # ranks go over chunks of slots and then within a chunk, as one source may own a third of all slots
    ahead = W.partitionBy("source_key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per = named.groupBy("source_key", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    inner = F.row_number().over(W.partitionBy("source_key", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("inner", inner).join(per, ["source_key", "chunk"]).withColumn("block_no", F.col("base") + F.col("inner"))
    counted = named.groupBy("source_key").count()
    lack = bands.select("source_key", "need").distinct().join(counted, "source_key", "left").withColumn("have", F.coalesce("count", F.lit(0))).where("have < need")
    lack = lack.select("source_key", F.explode(F.sequence("have", F.col("need") - 1)).alias("block_no"))
    tail = lack.select((F.lit(total) + F.row_number().over(W.orderBy("block_no", "source_key")) - 1).alias("slot"), "source_key", "block_no")
    return ranked.where("block_no < need").select("slot", "source_key", "block_no").unionByName(tail)


def by_pass(streams: DataFrame, goals: DataFrame) -> DataFrame:
    """``streams`` with source_size, target and, for the passes 0 and 1, the words [_a, _z) of the run that they take."""
    g = goals.select("source_key", "source_size", "target", "goal")
    s = streams.join(g, "source_key").withColumn("pass_no", F.explode(F.array(F.lit(0), F.lit(1))))
    s = s.withColumn("_a", F.col("from_word") + F.col("pass_no") * F.col("source_size"))
    return s.withColumn("_z", F.greatest("_a", F.least(F.col("_a") + F.col("size"), "goal")))


def mix(streams: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """What each slot takes: slot, source_key, block_no, skip, words and the columns of ``streams``.

    A piece takes ``words`` words of its document after the first ``skip``; a slot's
    pieces follow in order of (pass_no, from_word).
    """
    s = by_pass(streams, goals).where("_z > _a")
    s = s.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_z") - 1) / block))))
    low, high = F.greatest(F.col("_a"), F.col("block_no") * block), F.least(F.col("_z"), (F.col("block_no") + 1) * block)
    pieces = s.withColumn("skip", low - F.col("_a")).withColumn("words", high - low).drop("_a", "_z", "goal")
    return pieces.join(schedule(goals, block), ["source_key", "block_no"])


def sized(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of all documents, the sources' goals, and the number of documents."""
    sizes = saved(with_sizes(docs, ["doc_id", "source", *carry]), "mix-sizes")
    goals = saved(targets(sizes.select("source", "size"), weights, share, most), "mix-goals")
    return sizes, goals, sizes.count()


def mixed_documents(docs: DataFrame, block: int = 4096, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot: one row per document."""
    sizes, goals, n = sized(docs, weights, share, most)
    streams = shuffled_streams(sizes, n, seed)
    # a document with words is known by its place in its source's stream, even where doc_ids repeat
    own = ["source_key", "from_word", "doc_id", "source", "size", "source_size", "target"]
    took = mix(streams, goals, block).groupBy(*own).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    every = streams.join(goals.select("source_key", "source_size", "target", "goal"), "source_key")
    rest = every.where("size = 0 or from_word >= goal").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return took.unionByName(rest).drop("source_key", "from_word")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    space = r"[\x20\x09-\x0D]"
    ends = F.split(text, rf"(?<=[^\x20\x09-\x0D])(?={space})")  # each piece but the last ends with a word
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "", block: int = 4096) -> DataFrame:
    """The mix as rows of ``docs``: each document once per pass that takes words of it.

    Rows follow in order of the schedule: each in the slot of the block where it
    begins, and by pass and place in its stream within a slot.  Partitions are ranges
    of slots, so the files that are written from them are sorted by name.
    A document at a source's end is cut after the words taken.  Documents without
    words or beyond their source's goal aren't in the mix.  The columns are those
    of ``docs``; n_chars, if there, follows the text.
    """
    names = docs.columns
    marks = _row_hashes(docs)
    known = docs.select(col("doc_id").alias("doc_id"), col("source").cast("string").alias("source"), *marks, col("text").alias("text"))
    sizes, goals, n = sized(known, weights, share, most, carry=("row_hash", "row_hash2"))
    plan = saved(schedule(goals, block), "mix-schedule")
    slots = (plan.agg(F.max("slot")).first()[0] or 0) + 1
    rows = by_pass(shuffled_streams(sizes, n, seed), goals).where("_z > _a").withColumn("block_no", F.floor(F.col("_a") / block))
    rows = rows.join(plan, ["source_key", "block_no"])
    place = ["slot", "pass_no", "from_word"]
    words = F.when(F.col("_z") - F.col("_a") < F.col("size"), F.col("_z") - F.col("_a"))
    rows = saved(rows.select("row_hash", "row_hash2", *[F.col(c).cast("long") for c in place], words.alias("_words")), "mix-plan")
    # rows of equal hashes are equal rows, so any of them serves all their places
    whole = docs.select(*marks, packed(docs)).dropDuplicates(["row_hash", "row_hash2"])
    rows = rows.join(whole, ["row_hash", "row_hash2"])
    parts = min(-(-slots // SLOTS_PER_PART), MOST_PARTS)
    rows = rows.repartitionById(parts, F.floor(F.col("slot") * parts / slots).cast("int")).sortWithinPartitions(*place)
    fields = {c: F.col("row").getField(f"c{i}") for i, c in enumerate(names)}
    text = fields["text"]
    fields["text"] = F.when(F.col("_words").isNull(), text).otherwise(_first_words(text, F.col("_words")))  # a source's last alone
    if "n_chars" in names:
        fields["n_chars"] = F.length(fields["text"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in fields.items()])


def _row_hashes(docs: DataFrame) -> list[Column]:
    """row_hash and row_hash2: 96 bits of all columns of a row, doc_id included."""
    flat = [F.to_json(F.struct(col(f.name))) if not isinstance(f.dataType, T.AtomicType) else col(f.name) for f in docs.schema.fields]
    return [F.xxhash64(*flat).alias("row_hash"), F.hash(*flat).alias("row_hash2")]
