"""From raw rows to a panel: bars, one row a key, complete hourly grid, alignment on a master clock, gaps, wide view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import fill_forward
from ..schema import OHLC, OHLCV


def bars(events: DataFrame, asset: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id", unit: str = "hour") -> DataFrame:
    """OHLCV bars of events: first, highest, lowest, last value by (ts, tie) and the number of events."""
    at = F.struct(ts, tie)
    return events.groupBy(F.col(asset).alias("asset"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def one_row(df: DataFrame, keys: Sequence[str], tie: Sequence[str], keep: str = "last") -> DataFrame:
    """One row for each key: the last (or first) by `tie`. Reduced before the shuffle, so a key may have any number of rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), F.struct(*tie))
    return df.groupBy(*keys).agg(pick.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def floor_to_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.date_trunc("hour", ts).cast("timestamp_ntz"))


def clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Every hour from the first to the last of df."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias(ts))


def grid(df: DataFrame, hours: DataFrame | None = None, assets: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """df on every hour of every asset; rows that were not there are NULL. hours, assets: dimensions, those of df by default."""
    hours = clock(df, ts) if hours is None else hours.select(ts)
    assets = df.select("asset").distinct() if assets is None else assets
    # a product of two dimensions, of which assets is the small one: the size of the grid wanted
    return hours.join(assets, how="cross").join(df, ["asset", ts], "left")


def panel(raw: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    """Complete hourly grid of bars, filled forwards, without the hours before an asset's first bar."""
    return fill_forward(grid(raw), columns).where(F.col(columns[0]).isNotNull())


def align(df: DataFrame, master: str, columns: Sequence[str] = OHLCV) -> DataFrame:
    """All assets on the hours of the master asset: floor to the hour, last row of an hour, filled forwards."""
    hourly = one_row(df.withColumn("__ts", F.col("ts")).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["asset", "ts"], ["__ts"]).drop("__ts")
    hours = hourly.where(F.col("asset") == master).select("ts")
    return fill_forward(grid(hourly, hours), columns)


def complete_hours(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the hours in which no asset lacks any of the columns."""
    bad = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1 if len(columns) > 1 else F.col(columns[0]).isNull()).select("ts").distinct()
    return df.join(bad, "ts", "left_anti")


def wide(df: DataFrame, assets: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row an hour, columns {asset}_{column}; the assets are given, so no pass finds them."""
    picks = [F.max(F.when(F.col("asset") == a, F.col(c))).alias(f"{a}_{c}") for a in assets for c in columns]
    return df.groupBy("ts").agg(*picks)


def gaps(df: DataFrame, hours: float, ts: str = "ts") -> DataFrame:
    """Steps between rows of an asset of more than so many hours."""
    before = F.lag(ts).over(Window.partitionBy("asset").orderBy(ts))
    out = df.select("asset", before.alias("gap_start"), F.col(ts).alias("gap_end"))
    span = (F.unix_seconds(F.col("gap_end").cast("timestamp")) - F.unix_seconds(F.col("gap_start").cast("timestamp"))) / 3600
    return out.withColumn("gap_hours", span).where(F.col("gap_hours") > hours)


def sanitize_prices(df: DataFrame, columns: Sequence[str] = OHLC, look_ahead: bool = False) -> DataFrame:
    """Prices that are not positive become the last positive one; with look_ahead also the next one, at a series' head."""
    from ..functions.windows import fill_backward

    df = fill_forward(df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns}), columns)
    return fill_backward(df, columns) if look_ahead else df


def sanitize_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.when(F.col("volume").isNotNull(), F.greatest("volume", F.lit(0.0))))


def zero_prices(df: DataFrame, columns: Sequence[str] = OHLC) -> DataFrame:
    """Number of prices that are not positive, by asset."""
    return df.groupBy("asset").agg(*[F.count_if(F.col(c) <= 0).alias(f"n_{c}") for c in columns])
