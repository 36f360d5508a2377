"""Look-ahead-free features of bars. All take and return long frames with (asset, ts); windows are rows of one hour.

Frames may have been dealt to blocks (functions.windows.blocked); `feature_panel` does that itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, col, div, dot, ln, sqrt
from ..functions.windows import blocked, over, rolling, rows, unblocked
from ..schema import RETURN_CLIP, VOL_WINDOW, VOLUME_WINDOW, ZSCORE_WINDOW

EPS = 1e-8


def log_return(df: DataFrame, price: str = "close", bound: float | None = RETURN_CLIP) -> Column:
    """ln of the ratio to the row before; 0 where either isn't positive, NULL in the first row; clipped."""
    p = F.lag(price).over(over(df))
    r = F.when(p.isNotNull() & F.col(price).isNotNull(), F.coalesce(ln(F.when(p > 0, F.col(price) / F.when(p > 0, p))), F.lit(0.0)))
    return r if bound is None else clip(r, -bound, bound)


def zscore(df: DataFrame, c: Column | str = "close", window: int = ZSCORE_WINDOW, least: int | None = None) -> Column:
    c, w = col(c), over(df)
    return (c - rolling(F.avg, c, w, window, least)) / (rolling(F.stddev_samp, c, w, window, least) + F.lit(EPS))


def volume_log_return(df: DataFrame) -> Column:
    """ln of the ratio of volumes, where 0 counts as 1; 0 in the first row."""
    v = F.when(F.col("volume") == 0, 1.0).otherwise(F.col("volume"))
    before = F.lag(v).over(over(df))
    return F.coalesce(ln(div(v, before)), F.lit(0.0))


def volume_zscore(df: DataFrame, window: int = VOLUME_WINDOW) -> Column:
    return F.coalesce(zscore(df, "volume", window, least=1), F.lit(0.0))


def parkinson(df: DataFrame, window: int = VOL_WINDOW) -> Column:
    span = ln(div("high", "low"))
    return rolling(F.avg, F.sqrt(span * span / F.lit(4 * math.log(2))), over(df), window)


def garman_klass(df: DataFrame, window: int = VOL_WINDOW) -> Column:
    """A negative radicand, which only inconsistent bars have, leaves its whole window NULL."""
    hl, co = ln(div("high", "low")), ln(div("close", "open"))
    return rolling(F.avg, sqrt(F.lit(0.5) * hl * hl - F.lit(2 * math.log(2) - 1) * co * co), over(df), window)


def ffd_weights(d: float, size: int = 100, cutoff: float = 1e-5) -> list[float]:
    """Weights of the fixed-width fractional difference, newest row first: 1, then -w (d - k + 1) / k, until below the cutoff."""
    out = [1.0]
    for k in range(1, size + 1):
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < cutoff:
            break
        out.append(w)
    return out


def fracdiff(df: DataFrame, weights: list[float], price: str = "close") -> Column:
    """Weighted sum of the logarithms of the last len(weights) prices; NULL unless all are there."""
    n = len(weights)
    recent = F.collect_list(ln(price)).over(rows(over(df), n))  # oldest first; passes NULLs over, hence the size
    return F.when(F.size(recent) == n, dot(recent, F.array(*[F.lit(w) for w in reversed(weights)])))


def relative_volume(df: DataFrame, window: int = VOL_WINDOW) -> Column:
    v = F.ln(F.lit(1.0) + F.col("volume"))
    return div(v, F.ln(F.lit(1.0) + rolling(F.avg, F.col("volume"), over(df), window)))


def bollinger(df: DataFrame, window: int = 20, width: float = 2.0) -> tuple[Column, Column]:
    """(%B, bandwidth in percent of the middle) with the population standard deviation."""
    w = over(df)
    mid, dev = rolling(F.avg, F.col("close"), w, window), rolling(F.stddev_pop, F.col("close"), w, window)
    low, high = mid - F.lit(width) * dev, mid + F.lit(width) * dev
    return div(F.col("close") - low, high - low), div(F.lit(100.0) * (high - low), mid)


def direction_target(df: DataFrame, price: str = "close") -> Column:
    """1.0 if the next price is higher, else 0.0, the last row too."""
    return F.coalesce((F.lead(price).over(over(df)) > F.col(price)).cast("double"), F.lit(0.0))


def forward_return(df: DataFrame, horizon: int, price: str = "close", pad: float | None = 0.0) -> Column:
    """Relative change over the next rows; `pad` where there are none."""
    r = div(F.lead(price, horizon).over(over(df)) - F.col(price), price)
    return r if pad is None else F.coalesce(r, F.lit(pad))


def benchmark_return(df: DataFrame, price: str = "close") -> Column:
    before = F.lag(price).over(over(df))
    return F.coalesce((F.col(price) - before) / F.greatest(before, F.lit(1e-8)), F.lit(0.0))


def time_encoding(ts: str = "ts") -> dict[str, Column]:
    """Sine and cosine of the hour of the day and of the day of the week (Monday 0)."""
    hour, day = F.hour(ts) * (2 * math.pi / 24), F.weekday(ts) * (2 * math.pi / 7)
    return {"sin_hour": F.sin(hour), "cos_hour": F.cos(hour), "sin_day": F.sin(day), "cos_day": F.cos(day)}


def price_relative(df: DataFrame, rsi: str, scaled: tuple[str, ...]) -> dict[str, Column]:
    """Single-asset normalisation: RSI to 0..1, momentum columns by the price."""
    return {rsi: F.col(rsi) / 100, **{c: div(c, "close") for c in scaled}}


def winsorize(df: DataFrame, columns: list[str], width: float = 5.0, fit: DataFrame | None = None) -> DataFrame:
    """Columns within mean +- width standard deviations of `fit` (df itself by default: that looks ahead)."""
    stats = (df if fit is None else fit).agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(stats), how="cross")  # one row
    return out.select(*[
        F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__m_{c}") - width * F.col(f"__s_{c}")), F.col(f"__m_{c}") + width * F.col(f"__s_{c}"))).alias(c)
        if c in columns else F.col(c) for c in df.columns])


def feature_panel(bars: DataFrame, d: dict[str, float] | float = 0.4, zscore_window: int = ZSCORE_WINDOW, volume_window: int = VOLUME_WINDOW, vol_window: int = VOL_WINDOW) -> DataFrame:
    """The windowed features of every asset, all over one shuffle: log_ret, vol_logret, vol_zscore, parkinson, gk, zscore, fracdiff."""
    ds = d if isinstance(d, dict) else None
    back = max(zscore_window, volume_window, vol_window, 101)
    b = blocked(bars, back)
    ffd = fracdiff(b, ffd_weights(d)) if ds is None else None
    if ds is not None:
        for asset, order in sorted(ds.items()):
            one = F.when(F.col("asset") == asset, fracdiff(b, ffd_weights(order)))
            ffd = one if ffd is None else F.coalesce(ffd, one)
    out = b.withColumns({
        "log_ret": log_return(b), "vol_logret": volume_log_return(b), "vol_zscore": volume_zscore(b, volume_window),
        "parkinson": parkinson(b, vol_window), "gk": garman_klass(b, vol_window), "zscore": zscore(b, "close", zscore_window), "fracdiff": ffd,
    })
    return unblocked(out)


def regime_inputs(df: DataFrame, risk_on: str, risk_off: str, window: int = 24, long_window: int = 168, block: int | None = None) -> DataFrame:
    """Inputs of the regime model from (asset, ts, log_ret, parkinson): trend, vol, risk_on_off, vol_ratio."""
    spread = df.groupBy("ts").agg((F.max(F.when(F.col("asset") == risk_on, F.col("log_ret"))) - F.max(F.when(F.col("asset") == risk_off, F.col("log_ret")))).alias("spread"))
    b = df.join(spread, "ts")
    w = over(b)
    short = rolling(F.avg, F.col("parkinson"), w, window)
    return b.withColumns({
        "hmm_trend": clip(zscore(b, "log_ret", window), -5, 5),
        "hmm_vol": clip(F.ln(short + F.lit(1e-6)), -12, 0),
        "hmm_risk_on_off": clip(rolling(F.avg, F.col("spread"), w, window), -0.05, 0.05),
        "hmm_vol_ratio": clip(short / (rolling(F.avg, F.col("parkinson"), w, long_window) + F.lit(1e-10)), 0.1, 10),
    }).drop("spread")


def momentum_inputs(rsi: Column, adx: Column, macd: Column) -> dict[str, Column]:
    """Momentum passed on to the regime model, clipped; missing ones are 0."""
    zero = F.lit(0.0)
    return {"hmm_rsi": clip(F.coalesce(rsi, zero), 0, 100), "hmm_adx": clip(F.coalesce(adx, zero), 0, 100), "hmm_macd": clip(F.coalesce(macd, zero), -2000, 2000)}


def observations(df: DataFrame, columns: list[str], length: int = 64) -> DataFrame:
    """Sliding windows: array of `length` rows of the columns ending in each row; only whole ones."""
    w = over(df)
    seen = F.collect_list(F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in columns])).over(rows(w, length))
    return df.withColumn("window", seen).where(F.size("window") == length)


def nav_volatility(df: DataFrame, log_ret: str, window: int = 25) -> Column:
    """Population standard deviation of the log returns within the last `window` values, from two returns on."""
    return rolling(F.stddev_pop, F.col(log_ret), over(df), window - 1, least=2)


def turnover(df: DataFrame, position: str = "position", window: int = 24) -> DataFrame:
    """df with `turnover`: mean absolute change of the position (0 before the first row) in the last rows, times the window."""
    w = over(df)
    df = df.withColumn("__d", F.abs(F.col(position) - F.lag(position, 1, 0.0).over(w)))
    return df.withColumn("turnover", F.avg("__d").over(rows(w, window)) * window).drop("__d")


def downside_deviation(df: DataFrame, ret: str = "ret", window: int = 24, eps: float = 1e-8) -> Column:
    """Population standard deviation of the negative returns in the last rows; eps if there are none."""
    w = over(df)
    return F.coalesce(F.stddev_pop(F.when(F.col(ret) < 0, F.col(ret))).over(rows(w, window)), F.lit(eps))


def out_of_distribution(df: DataFrame, c: str, window: int = 100) -> Column:
    """Absolute z of a value within the last `window`, once more than that many have been seen."""
    w = over(df)
    z = F.abs(F.col(c) - F.avg(c).over(rows(w, window))) / (F.stddev_pop(c).over(rows(w, window)) + F.lit(1e-6))
    return F.when(F.row_number().over(w) > window, z).otherwise(0.0)


def baseline_volatility(df: DataFrame, price: str = "close") -> DataFrame:
    """Standard deviation (n - 1) of the relative changes, by asset."""
    return df.withColumn("__r", div(price, F.lag(price).over(over(df))) - 1).groupBy("asset").agg(F.stddev_samp("__r").alias("baseline_vol"))
