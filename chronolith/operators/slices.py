"""Rows by position or time, finite rows, rows shared by frames, values at an offset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .split import numbered


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def by_position(df: DataFrame, start: int, end: int | None = None, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Rows start to end - 1 of each series."""
    d = numbered(df, keys, order)
    keep = F.col("rn") >= start if end is None else (F.col("rn") >= start) & (F.col("rn") < end)
    return d.where(keep).drop("rn", "n")


def last_rows(df: DataFrame, k: int, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    return numbered(df, keys, order).where(F.col("rn") >= F.col("n") - k).drop("rn", "n")


def between(df: DataFrame, start, end, ts: str = "ts", lookback: str | None = None) -> DataFrame:
    """Rows from start to end, both included. A filter on time isn't pushed below windows, so those who compute windows
    afterwards give their lookback (an interval, such as '720 hours') to keep the rows they need."""
    first = F.lit(start) - F.expr(f"interval {lookback}") if lookback else F.lit(start)
    return df.where(F.col(ts).between(first, F.lit(end)))


def all_finite(columns: list[str]) -> Column:
    """True where none of the columns is NULL, NaN or infinite."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return good


def assign_finite(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """df with new columns, worked out where `columns` are all finite and NULL in the other rows, which all stay."""
    good = all_finite(columns)
    return df.withColumns({k: F.when(good, c) for k, c in made.items()})


def finite_rows(df: DataFrame, columns: list[str], least: int = 0) -> DataFrame:
    """Rows whose columns are all finite; ValueError if there are fewer than `least` (checked only if asked for)."""
    out = df.where(all_finite(columns))
    if least and out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} finite rows")
    return out


def shared(df: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("asset", "ts")) -> DataFrame:
    """Rows of df whose keys other has too."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def at_offset(steps: DataFrame, rows: DataFrame, offset: int, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Steps (t from 0) with columns of the rows that lie `offset` behind their series' start."""
    d = numbered(rows, keys, order).select(*keys, (F.col("rn") - offset).alias("t"), *columns)
    return steps.join(d, [*keys, "t"])


def as_float(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def top(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The k largest by an expression, ties by columns."""
    return df.orderBy(by.desc(), *ties).limit(k)


def pooled(df: DataFrame, vector: str, size: int, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of each run of `size` vectors, place by place: (keys, bucket, place, value)."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / size).cast("long")) if keys else df.withColumn("bucket", F.floor(F.col(order) / size).cast("long"))
    return d.select(*keys, "bucket", F.posexplode(vector).alias("place", "x")).groupBy(*keys, "bucket", "place").agg(F.avg("x").alias("value"))
