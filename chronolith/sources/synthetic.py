"""Series with a known signal, made in the executors: for tests of whether a pipeline finds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def oracle_bars(spark: SparkSession, n: int, assets: tuple[str, ...] = ("a",), seed: int = 42, size: float = 0.01, noise: float = 0.002) -> DataFrame:
    """Bars whose signal (-1 or 1) is the sign of the next return: return[t + 1] = signal[t] * size + noise."""
    w = Window.partitionBy("asset").orderBy("k")
    d = spark.range(n).select(F.col("id").alias("k")).join(spark.createDataFrame([(a,) for a in assets], "asset string"), how="cross")
    u = F.pmod(F.xxhash64("k", "asset", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    v = F.pmod(F.xxhash64("k", "asset", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
    d = d.withColumn("signal", F.when(u < 0.5, -1.0).otherwise(1.0)).withColumn("r", F.coalesce(F.lag("signal").over(w), F.lit(0.0)) * size + (v - 0.5) * 2 * noise)
    d = d.withColumn("close", 100 * F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("k").cast("int"))).alias("ts")
    return d.select("asset", ts, "open", (F.greatest("open", "close") * 1.001).alias("high"), (F.least("open", "close") * 0.999).alias("low"), "close", (1000 * v).alias("volume"), "signal")


def oracle_correlation(df: DataFrame, signal: str = "signal", price: str = "close") -> DataFrame:
    """Correlation of a signal with the next relative change, by asset."""
    w = Window.partitionBy("asset").orderBy("ts")
    d = df.withColumn("__n", F.lead(price).over(w) / F.nullif(F.col(price), F.lit(0.0)) - 1)
    return d.groupBy("asset").agg(F.corr(signal, "__n").alias("signal_corr"))


def oracle_verdict(steps: DataFrame, keys: tuple[str, ...] = ("asset",), periods: float = 252 * 24) -> DataFrame:
    """How well a policy uses the signal: mean absolute position, Sharpe, and a tier. Bounds are fixed values."""
    got = steps.groupBy(*keys).agg(F.avg(F.abs("position")).alias("mean_abs_position"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-8) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))
    tier = F.when((F.col("sharpe") > 10) & (F.col("mean_abs_position") > 0.5), "EXCELLENT").when(F.col("sharpe") > 2, "GOOD").when(F.col("sharpe") > 0, "WEAK").otherwise("FAILED")
    return got.withColumn("tier", tier)
