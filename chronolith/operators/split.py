"""Chronological splits with purge and embargo, walk-forward segments and their context rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import dealt
from ..schema import CONTEXT_ROWS, EMBARGO, MAX_LOOKBACK, PURGE


def check_purge(purge: int, least: int = MAX_LOOKBACK, strict: bool = True) -> bool:
    """Whether the purge covers the longest look-back; ValueError if not and strict."""
    if purge >= least:
        return True
    if strict:
        raise ValueError(f"purge of {purge} rows is shorter than the look-back of {least}")
    return False


def numbered(df: DataFrame, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """df with rn, from 0, and n, the rows of its series. Rows are numbered by blocks of time, a series of any length in many tasks."""
    return dealt(df, keys, order).select(*df.columns, F.col("__rn").alias("rn"), F.col("__n").alias("n"))


def split_label(n: Column, rn: Column, train: float = 0.7, val: float = 0.15, purge: int = PURGE) -> Column:
    """train, val, test, or NULL for rows purged between them."""
    a, b = F.floor(n.cast("double") * train), F.floor(n.cast("double") * (train + val))
    return F.when(rn < a, "train").when((rn >= a + purge) & (rn < b), "val").when(rn >= b + purge, "test")


def two_way(n: Column, rn: Column, ratio: float = 0.8, purge: int = PURGE) -> Column:
    a = F.floor(n.cast("double") * ratio)
    return F.when(rn < a, "train").when(rn >= a + purge, "eval")


def split(df: DataFrame, train: float = 0.7, val: float = 0.15, purge: int = PURGE, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """df with `split`; purged rows are left out."""
    d = numbered(df, keys)
    return d.withColumn("split", split_label(F.col("n"), F.col("rn"), train, val, purge)).where("split is not null").drop("n")


def summary(df: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    return df.groupBy(*keys, "split").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@dataclass(frozen=True)
class WalkForward:
    """Lengths in rows. 13 months of 720 hours train, one eval, three test, a step of three."""

    train: int = 13 * 720
    purge: int = PURGE
    eval: int = 720
    test: int = 3 * 720
    embargo: int = EMBARGO
    step: int = 3 * 720

    @property
    def size(self) -> int:
        return self.train + self.purge + self.eval + self.purge + self.test + self.embargo

    def segments(self, spark: SparkSession, n: int, offset: int = 0) -> DataFrame:
        """(segment, train_start, ..., test_end): whole segments of n rows only."""
        count = max(0, math.floor((n - offset - self.size) / self.step) + 1)
        start = F.col("id") * self.step + offset
        e, t = self.train + self.purge, self.train + 2 * self.purge + self.eval
        return spark.range(count).select(
            F.col("id").cast("int").alias("segment"), start.alias("train_start"), (start + self.train).alias("train_end"),
            (start + e).alias("eval_start"), (start + e + self.eval).alias("eval_end"),
            (start + t).alias("test_start"), (start + t + self.test).alias("test_end"),
        )

    def rows(self, df: DataFrame, segments: DataFrame, context: int = 0) -> DataFrame:
        """Rows (with rn) of every segment with segment, split and is_context.

        A row is in few segments, found by arithmetic: rows are exploded to the segments that can hold them and
        joined by the segment's number, so neither side is compared with all of the other. With context, the last
        rows before eval and before test come along, marked.
        """
        first = segments.agg(F.min("train_start").alias("__first")).where("__first is not null")
        d = df.join(F.broadcast(first), how="cross")  # one row
        at = F.col("rn") - F.col("__first")
        low, high = F.greatest(F.ceil((at - self.size) / self.step), F.lit(0)), F.floor(at / self.step)
        d = d.where(at >= 0).withColumn("segment", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("segment", F.col("segment").cast("int")).drop("__first")
        d = d.join(segments, "segment")
        inside = lambda a, b: (F.col("rn") >= F.col(a)) & (F.col("rn") < F.col(b))
        named = F.when(inside("train_start", "train_end"), "train").when(inside("eval_start", "eval_end"), "eval").when(inside("test_start", "test_end"), "test")
        kinds = [F.when(named.isNotNull(), F.struct(named.alias("split"), F.lit(False).alias("is_context")))]
        if context:
            # the last training rows lead into eval, the last of train and eval together into test
            into_eval = inside("train_start", "train_end") & (F.col("rn") >= F.col("train_end") - context)
            tail = F.lit(max(0, context - self.eval))
            into_test = (inside("eval_start", "eval_end") & (F.col("rn") >= F.col("eval_end") - context)) | (inside("train_start", "train_end") & (F.col("rn") >= F.col("train_end") - tail))
            as_context = lambda name: F.struct(F.lit(name).alias("split"), F.lit(True).alias("is_context"))
            kinds += [F.when(into_eval, as_context("eval")), F.when(into_test, as_context("test"))]
        d = d.withColumn("__k", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())))
        return d.select(*[c for c in df.columns], "segment", F.col("__k.split").alias("split"), F.col("__k.is_context").alias("is_context"))


def with_context(df: DataFrame, wf: WalkForward, segments: DataFrame, context: int = CONTEXT_ROWS) -> DataFrame:
    return wf.rows(df, segments, context)


def warm_up(raw: DataFrame, features: DataFrame) -> int:
    """Rows that feature look-backs cost at the head."""
    return raw.count() - features.count()
