"""Scans with explicit schemas, and which of several sources to take."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import BAR


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, schema: StructType = BAR) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def load(spark: SparkSession, path: str, schema: StructType = BAR, ts: str = "ts") -> DataFrame:
    """By the path's ending; ValueError without a timestamp column. Order is not kept: windows sort."""
    df = parquet(spark, path) if ".parquet" in path else csv(spark, path, schema)
    if ts not in df.columns or not df.schema[ts].dataType.typeName().startswith("timestamp"):
        raise ValueError(f"{path} has no timestamp column {ts}")
    return df


def first_of(spark: SparkSession, sources: Iterable[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """The first source whose path exists ('' stands for one without a path), in order of priority."""
    for path, read in sources:
        if not path or exists(spark, path):
            return read()
    raise FileNotFoundError("none of the sources exists")


def normalize(df: DataFrame, asset: str) -> DataFrame:
    """Columns of any case (open or Open, Date or timestamp) as bars of one asset."""
    names = {c.lower().replace(" ", "_"): c for c in df.columns}
    stamp = next((names[n] for n in ("ts", "timestamp", "date", "datetime", "time") if n in names), None)
    missing = [c for c in ("open", "high", "low", "close") if c not in names]
    if stamp is None or missing:
        raise ValueError(f"missing columns: {missing or ['ts']}")
    volume = F.col(names["volume"]).cast("double") if "volume" in names else F.lit(0.0)
    return df.select(F.lit(asset).alias("asset"), F.col(stamp).cast("timestamp_ntz").alias("ts"), *[F.col(names[c]).cast("double").alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))


def pages(start: datetime, end: datetime, fetch: Callable[[datetime, datetime], list[tuple]], chunk: timedelta, step: timedelta = timedelta(hours=1)) -> Iterator[tuple]:
    """Rows of a paged interface: each page from just after the last row, until one is empty or the end is reached.

    fetch(start, end) returns rows whose first field is their time. A page without rows skips to the next chunk only
    if chunks are fixed; here it ends the scan.
    """
    at = start
    while at < end:
        rows = fetch(at, min(end, at + chunk))
        if not rows:
            return
        yield from rows
        at = max(rows[-1][0] + step, at + step)


def fetched(spark: SparkSession, assets: list[str], start: datetime, end: datetime, fetch: Callable[[str, datetime, datetime], list[tuple]], chunk: timedelta = timedelta(days=180)) -> DataFrame:
    """Bars fetched in the executors, one task an asset and chunk of time; failures are retried by Spark's task retries.

    fetch(asset, start, end) -> rows (ts, open, high, low, close, volume); it is imported where it runs, so an
    installation without network or keys only fails when used.
    """
    import pandas as pd

    spans, at = [], start
    while at < end:
        spans += [(a, at, min(end, at + chunk)) for a in assets]
        at += chunk
    todo = spark.createDataFrame(spans, "asset string, a timestamp_ntz, b timestamp_ntz").repartition(max(1, len(spans)), "asset", "a")

    def run(batches):
        for pdf in batches:
            for asset, a, b in pdf.itertuples(index=False):
                rows = fetch(asset, a.to_pydatetime(), b.to_pydatetime())
                yield pd.DataFrame([(asset, *r) for r in rows], columns=["asset", "ts", "open", "high", "low", "close", "volume"])

    got = todo.mapInPandas(run, BAR)
    from ..operators.sync import one_row

    return one_row(got, ["asset", "ts"], ["close"])


def scalars(spark: SparkSession, path: str) -> DataFrame:
    """Logged scalars (run, tag, step, value) as JSON lines."""
    return spark.read.schema("run string, tag string, step bigint, value double").json(path)
