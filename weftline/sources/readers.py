"""Readers of line-delimited JSON, parquet, plain text, listings and binaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_order
from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, by the file system that its address names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Blank lines are skipped; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corpus(spark: SparkSession, folder: str, mapping_prefix: str = "law_mappings") -> tuple[DataFrame, DataFrame]:
    """Statute rows and mappings of a folder of JSON lines, told apart by file name; fails without rows.

    Rows get row_idx: their place by file name and offset, the last tie-break of rankings.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    both = spark.read.text(f"{folder}/*.jsonl").select(name.alias("_file"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_n")).where(F.trim("value") != "")
    m = F.startswith("_file", F.lit(mapping_prefix))
    rows = both.where(~m).select(F.from_json("value", schemas.STATUTE).alias("r"), F.struct("_file", "_at", "_n").alias("row_idx")).select("row_idx", "r.*")
    if not rows.limit(1).count():
        raise FileNotFoundError(f"no statute rows in {folder}")
    return rows, both.where(m).select(F.from_json("value", schemas.MAPPING).alias("r")).select("r.*")


def generation_rows(spark: SparkSession, folder: str, exclude: str = "law_mappings.jsonl") -> DataFrame:
    """Rows for generation: every file but exactly one; guidance stays in."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return json_lines(spark, f"{folder}/*.jsonl", schemas.STATUTE).where(name != exclude)


def first_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the files that exists; fails if it is empty or none exists."""
    for p in paths:
        if exists(spark, p):
            df = json_lines(spark, p, schema)
            if not df.limit(1).count():
                raise ValueError(f"no records in {p}")
            return df
    raise FileNotFoundError(", ".join(paths))


def eval_split(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Records that need no curation; with ``limit``, the first by id."""
    out = records.where(~F.coalesce("needs_curation", F.lit(False)))
    return out if limit is None else out.orderBy("id").limit(limit)


def run_predictions(lines: DataFrame, key: str = "id", order: str = "line") -> DataFrame:
    """One row per key: the last line wins."""
    names = [c for c in lines.columns if c not in (key, order)]
    return lines.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(key, "_r.*")


def binaries(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, content of files; parsing is the caller's hook."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """path and the rows that ``parse`` makes of each file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, **r} for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse(bytes(c))]
            if rows:
                yield pd.DataFrame(rows)

    return files.mapInPandas(run, f"path string, {schema}")


def seeded_parquet(spark: SparkSession, files: list[str], n: int, key: str, columns: list[str], seed: str = "") -> DataFrame:
    """``n`` rows of each file by a seeded order, together; fails if a column lacks."""
    out = None
    for f in files:
        df = spark.read.parquet(f)
        if lost := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{f} lacks {', '.join(lost)}")
        part = df.select(*columns).orderBy(hash_order(key, seed=seed), key).limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def config(spark: SparkSession, entries: list[dict], schema: str, groups: list[str] | None = None) -> DataFrame:
    """A configuration's entries as a table: the enabled ones, of the given groups."""
    df = spark.createDataFrame(entries, schema)
    if "enabled" in df.columns:
        df = df.where(F.coalesce("enabled", F.lit(True)))
    return df.where(F.col("group").isin(*groups)) if groups else df


def listing(spark: SparkSession, folder: str, prefixes: list[str]) -> DataFrame:
    """key, size of the files below prefixes of a folder; no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{p}" for p in prefixes])
    return df.select(F.col("path").alias("key"), F.col("length").alias("size"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a text file, as questions."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("question"))


def manifest(spark: SparkSession, path: str, schema: str = schemas.ASSET) -> DataFrame:
    """The manifest, or an empty table of its schema."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def messages_only(records: DataFrame, most: int | None = None) -> DataFrame:
    """The messages column; fails without rows."""
    if not records.limit(1).count():
        raise ValueError("no records")
    out = records.select("messages")
    return out if most is None else out.limit(most)


def statistics_with_config(sections: DataFrame, act: dict[str, str]) -> DataFrame:
    """Sections with an act's constants as columns."""
    return sections.select("*", *[F.lit(v).alias(k) for k, v in act.items()])


def mapping_union(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct pairs of all tables, with their old and new acts, in string order."""
    out = None
    for pairs, old, new in tables:
        part = pairs.select(F.lit(old).alias("old_act"), "old_section", F.lit(new).alias("new_act"), "new_section").distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("new_act", "new_section", "old_section")


def vectors(spark: SparkSession, folder: str, model: str, passages: DataFrame, key: str, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key``, embedding: kept by a fingerprint of the model and all passages; made once by ``embed``.

    The fingerprint adds up row hashes, so it doesn't depend on row order.
    """
    row = F.xxhash64(F.lit(model), key, text).cast("decimal(38,0)")
    mark = passages.agg(F.sum(row).alias("s"), F.count(F.lit(1)).alias("n")).first()
    at = f"{folder}/vectors-{model.replace('/', '__')}-{mark['n']}-{abs(int(mark['s'] or 0)):x}"
    if not exists(spark, f"{at}/_SUCCESS"):
        embed(passages.select(key, text)).select(key, "embedding").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
