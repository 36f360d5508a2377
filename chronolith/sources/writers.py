"""Sinks: panels and splits as partitioned Parquet, scalers, models and metadata, results that grow."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def panel(df: DataFrame, path: str, partitions: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, sorted by time within files, so that readers skip row groups; partitioned by e.g. segment and split."""
    out = df.repartition(*partitions) if partitions else df
    order = [*partitions, *[c for c in ("asset", "ts") if c in df.columns]]
    out = out.sortWithinPartitions(*order) if order else out
    w = out.write.mode(mode)
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def append(df: DataFrame, path: str) -> None:
    """Adds results with the time they were added; columns may differ from those there."""
    df.withColumn("added_at", F.current_timestamp()).write.mode("append").parquet(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def metadata(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "json string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame written to a path, made only if it isn't there with all its files."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """A fitted scaler (feature, center, scale; keys) as Parquet."""
    scaler.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved scaler or model."""
    return spark.read.parquet(path)


def save_model(model: DataFrame, path: str) -> None:
    """Regime models, one row a key: arrays of parameters, as Parquet."""
    model.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines, NaN and infinities as null."""
    from ..operators.audit import to_json_rows

    to_json_rows(df).write.mode("overwrite").text(path)
