"""Robust scaling without leaks: median and interquartile range of the training rows, applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..schema import MIN_IQR, SCALER_CLIP


def long(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row a key and column: (keys, feature, x)."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select(
        *keys, "f.feature", "f.x"
    )


def with_quantiles(groups: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """groups with the q of the same keys, NULL where there is none."""
    q = q.withColumnsRenamed({k: f"__q_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    return groups.join(q, on, "left").drop(*[f"__q_{k}" for k in by])


def check_finite(df: DataFrame, columns: list[str]) -> None:
    """ValueError, naming the columns, if any holds NULL, NaN or an infinity."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]).first()
    found = {c: bad[c] for c in columns if bad[c]}
    if found:
        raise ValueError(f"not finite: {found}")


def fit(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), min_iqr: float = MIN_IQR) -> DataFrame:
    """(keys, feature, center, scale): exact median and interquartile range, the latter floored."""
    rows = long(df, columns, list(keys))
    some = quantiles(rows, [*keys, "feature"], (0.25, 0.5, 0.75))
    out = with_quantiles(rows.groupBy(*keys, "feature").agg(F.lit(1).alias("one")), some, [*keys, "feature"])  # a column of NULLs has NULLs
    return out.select(*keys, "feature", F.get("q", 1).alias("center"), F.greatest(F.get("q", 2) - F.get("q", 0), F.lit(min_iqr)).alias("scale"))


def transform(df: DataFrame, scaler: DataFrame, columns: list[str], keys: tuple[str, ...] = (), bound: float | None = SCALER_CLIP, prefix: str = "") -> DataFrame:
    """df with (x - center) / scale in place of each column (or beside it, under a prefix), within +- bound.

    The scaler becomes one row a key: keys are segments and assets, so Spark can broadcast it by its size.
    """
    row = scaler.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.struct("center", "scale"))).alias(f"__{c}") for c in columns])
    out = df.join(row, list(keys)) if keys else df.join(F.broadcast(row), how="cross")  # one row
    for c in columns:
        x = (F.col(c) - F.col(f"__{c}.center")) / F.col(f"__{c}.scale")
        x = x if bound is None else F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))
        out = out.withColumn(f"{prefix}{c}", x)
    return out.drop(*[f"__{c}" for c in columns])


def fit_transform(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    return transform(df, fit(df, columns), columns, **kw)


def by_segment(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("segment", "asset"), bounded: tuple[str, ...] = ("zscore",)) -> DataFrame:
    """Rows of segments (with `split`) scaled by the training rows of their own segment; z-scores are clipped too."""
    scaler = fit(df.where(F.col("split") == "train"), columns, keys)
    out = transform(df, scaler, columns, keys, bound=None)
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(5.0)), F.lit(-5.0))) for c in columns if c.endswith(bounded)})
