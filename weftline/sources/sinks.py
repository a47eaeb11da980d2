"""Writers and manifests.  Spark's committer publishes whole tables or nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Line-delimited UTF-8, replacing what was there."""
    df.write.mode("overwrite").json(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """One folder for each split, config or verdict."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str) -> int:
    """Append rows whose key isn't there yet; returns how many."""
    try:
        done = spark.read.parquet(path).select(key)
        new = new.join(done, key, "left_anti")
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.dropDuplicates([key]).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def upsert(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Old reports without the labels that the new ones have, and the new ones."""
    return old.join(new.select(label).distinct(), label, "left_anti").unionByName(new, allowMissingColumns=True)


def asset_status(wanted: DataFrame, manifest: DataFrame, fetched: DataFrame | None = None, key: str = "asset_id") -> DataFrame:
    """``key``, status: cached if the manifest has it, fetched if it has just come, else failed."""
    out = wanted.select(key).join(manifest.select(key, F.lit(True).alias("_c")).distinct(), key, "left")
    if fetched is not None:
        out = out.join(fetched.select(key, F.lit(True).alias("_f")).distinct(), key, "left")
    else:
        out = out.withColumn("_f", F.lit(None).cast("boolean"))
    return out.select(key, F.when(F.col("_c"), "cached").when(F.col("_f"), "fetched").otherwise("failed").alias("status"))


def needed(value: Column, name: str) -> Column:
    """The value; reading it fails where it is missing, so a report never shows a gap."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"missing metric: {name}"))).otherwise(value)


def metric_card(metrics: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """One row, card: a line for each (name, title) of a (name, value) table; fails if one is missing."""
    by = metrics.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"m{i}") for i, (n, _) in enumerate(wanted)])
    lines = [F.concat(F.lit(f"- {title}: "), F.format_string("%.4f", needed(F.col(f"m{i}"), n).cast("double"))) for i, (n, title) in enumerate(wanted)]
    return by.select(F.concat_ws("\n", *lines).alias("card"))


def config_path(root: str, settings: dict) -> str:
    """A folder for a full configuration, so that experiments never replace each other."""
    return root + "".join(f"/{k}={settings[k]}" for k in sorted(settings))


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the session names and all executors share.

    Only on one machine, and where none is named, a temporary one is made and remembered.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftline.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.weftline.scratch", at)
    return at.rstrip("/")


def scratch(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A step that writes a table to the shared folder and reads it back: computed once, and lineage is cut."""
    root = scratch_folder(spark)

    def write(df: DataFrame) -> DataFrame:
        at = f"{root}/weftline-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return write
