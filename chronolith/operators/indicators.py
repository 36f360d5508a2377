"""Recursive indicators. Averages are affine recursions, worked out over blocks of a series (`functions.scans`), so that one
long series is many tasks; an indicator whose second average is of a ratio of first ones takes two such passes.

Seeds: Wilder averages start from the mean of the first n values, exponential averages from the mean of the first n;
earlier rows are NULL. A NULL after the first value makes all later ones of that series NULL. The functions of arrays are the
same on one array; `fold` is for what isn't affine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import known, recursion, smoothing
from ..functions.windows import BLOCK_ROWS
from ..runtime import settled


def fold(df: DataFrame, keys: tuple[str, ...], order: str, inputs: list[str], outputs: list[str], f: Callable[..., list[np.ndarray]]) -> DataFrame:
    """df with columns that f makes of its input columns (arrays in order), NaN as NULL."""
    schema = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields] + [f"`{o}` double" for o in outputs])
    names = df.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        made = f(*[pdf[c].to_numpy(dtype=float) for c in inputs])
        for name, values in zip(outputs, made, strict=True):
            pdf[name] = pd.Series(values).astype(object).where(np.isfinite(values), None)
        return pdf[[*names, *outputs]]

    return df.groupBy(*keys).applyInPandas(one, schema)


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """y = y + alpha (x - y), from the mean of the first n finite values on."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(np.isfinite(x))) if np.isfinite(x).any() else len(x)
    if start + n > len(x):
        return out
    y = x[start : start + n].mean()
    out[start + n - 1] = y
    for t in range(start + n, len(x)):
        y += alpha * (x[t] - y)
        out[t] = y
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1))


def rsi_of(close: np.ndarray, n: int = 14) -> np.ndarray:
    d = np.diff(close, prepend=np.nan)
    gain, loss = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)) + 0 * gain


def macd_of(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = ema(close, fast) - ema(close, slow)
    return line, line - ema(line, signal)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], close[:-1]))
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def adx_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus[:1] = minus[:1] = np.nan
    tr = wilder(true_range(high, low, close), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = 100 * wilder(plus, n) / tr, 100 * wilder(minus, n) / tr
        dx = np.where(a + b == 0, 0.0, 100 * np.abs(a - b) / (a + b))
    return wilder(np.where(np.isnan(a), np.nan, dx), n)


Keys = tuple[str, ...]


class _Momentum:
    """First averages of rsi, macd and adx side by side, by name: (values of a row, seed length, alpha, rows before the first value)."""

    def __init__(self, n: int, fast: int, slow: int, signal: int):
        self.n, self.fast, self.slow, self.signal = n, fast, slow, signal
        w = 1 / n
        gain = lambda r: np.maximum(r["close"] - r["prev_close"], 0)
        loss = lambda r: np.maximum(r["prev_close"] - r["close"], 0)
        up, down = (lambda r: r["high"] - r["prev_high"]), (lambda r: r["prev_low"] - r["low"])
        self.first = {
            "gain": (gain, n, w, 1), "loss": (loss, n, w, 1),
            "fast": (lambda r: r["close"], fast, 2 / (fast + 1), 0), "slow": (lambda r: r["close"], slow, 2 / (slow + 1), 0),
            "range": (_true_range, n, w, 1),
            "plus": (lambda r: np.where((up(r) > down(r)) & (up(r) > 0), up(r), 0.0), n, w, 1), "minus": (lambda r: np.where((down(r) > up(r)) & (down(r) > 0), down(r), 0.0), n, w, 1),
        }

    def averages(self, df: DataFrame, names: list[str], inputs: list[str], outputs: list[str], finish, keys: Keys, order: str, size: int) -> DataFrame:
        own = [self.first[k] for k in names]

        def maps(r):
            return [smoothing(_from(f(r), r["pos"] >= lag), r["pos"] - lag, n, alpha) for f, n, alpha, lag in own]

        def done(r, y):
            return finish(r, {k: known(v, r["pos"] - lag, n) for k, v, (_, n, _, lag) in zip(names, y, own, strict=True)})

        return recursion(df, keys, order, inputs, outputs, [0.0] * len(names), maps, done, inputs, size)


def _from(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    return np.where(on, x, 0.0)


def _true_range(r) -> np.ndarray:
    return np.maximum(r["high"] - r["low"], np.maximum(np.abs(r["high"] - r["prev_close"]), np.abs(r["low"] - r["prev_close"])))


def _again(df: DataFrame, inputs: dict[str, tuple[int, float, int]], anchors: list[str], keys: Keys, order: str, size: int) -> DataFrame:
    """df with second averages `__s...` of columns, each (n, alpha, rows from the anchors' first values to its own), side by side."""

    def maps(r):
        return [smoothing(_from(r[c], r["pos"] >= lag), r["pos"] - lag, n, alpha) for c, (n, alpha, lag) in inputs.items()]

    def finish(r, y):
        return [known(v, r["pos"] - lag, n) for v, (n, _, lag) in zip(y, inputs.values(), strict=True)]

    return recursion(settled(df), keys, order, list(inputs), [f"__s{c}" for c in inputs], [0.0] * len(inputs), maps, finish, (), size, anchors)


def _rsi(y: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(y["loss"] == 0, 100.0, 100 - 100 / (1 + y["gain"] / y["loss"])) + 0 * y["gain"]


def _dx(y: dict[str, np.ndarray]) -> np.ndarray:
    a, b = 100 * y["plus"] / y["range"], 100 * y["minus"] / y["range"]
    return np.where(np.isnan(a), np.nan, np.where(a + b == 0, 0.0, 100 * np.abs(a - b) / (a + b)))


def rsi(df: DataFrame, n: int = 14, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    return _Momentum(n, 12, 26, 9).averages(df, ["gain", "loss"], ["close"], ["rsi"], lambda r, y: [_rsi(y)], keys, order, size)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    d = _Momentum(14, fast, slow, signal).averages(df, ["fast", "slow"], ["close"], ["__line"], lambda r, y: [y["fast"] - y["slow"]], keys, order, size)
    d = _again(d, {"__line": (signal, 2 / (signal + 1), max(fast, slow) - 1)}, ["close"], keys, order, size)
    return d.select(*df.columns, F.col("__line").alias("macd"), (F.col("__line") - F.col("__s__line")).alias("macd_hist"))


def adx(df: DataFrame, n: int = 14, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    d = _Momentum(n, 12, 26, 9).averages(df, ["range", "plus", "minus"], ["high", "low", "close"], ["__dx"], lambda r, y: [_dx(y)], keys, order, size)
    return _again(d, {"__dx": (n, 1 / n, n)}, ["high", "low", "close"], keys, order, size).select(*df.columns, F.col("__s__dx").alias("adx"))


def atr_ratio(df: DataFrame, n: int = 14, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    return _Momentum(n, 12, 26, 9).averages(df, ["range"], ["high", "low", "close"], ["atr_ratio"], lambda r, y: [y["range"] / r["close"]], keys, order, size)


def momentum(df: DataFrame, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    """rsi, macd_hist and adx, their first averages in one pass; rows before an indicator's first value are NULL."""
    m = _Momentum(14, 12, 26, 9)
    finish = lambda r, y: [_rsi(y), y["fast"] - y["slow"], _dx(y)]
    d = m.averages(df, list(m.first), ["high", "low", "close"], ["rsi", "__line", "__dx"], finish, keys, order, size)
    d = _again(d, {"__line": (9, 0.2, 25), "__dx": (14, 1 / 14, 14)}, ["high", "low", "close"], keys, order, size)
    return d.select(*df.columns, "rsi", (F.col("__line") - F.col("__s__line")).alias("macd_hist"), F.col("__s__dx").alias("adx"))


def ema_volatility(df: DataFrame, ret: str, window: int = 24, target: float = 0.05, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    """Root of the exponential average of squared returns (NULL counts as 0), from the target's square on."""
    alpha = 2 / (window + 1)
    maps = lambda r: [(np.full(len(r["rn"]), 1 - alpha), alpha * np.nan_to_num(r[ret]) ** 2)]
    return recursion(df, keys, order, [ret], ["ema_vol"], [target * target], maps, lambda r, y: [np.maximum(np.sqrt(y[0]), 1e-6)], (), size)


def smoothed_action(df: DataFrame, action: str = "action", alpha: float = 0.3, keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    """alpha a + (1 - alpha) the one before, the first as it is."""
    maps = lambda r: [(np.where(r["rn"] == 0, 0.0, 1 - alpha), np.where(r["rn"] == 0, 1.0, alpha) * r[action])]
    return recursion(df, keys, order, [action], ["smoothed"], [0.0], maps, lambda r, y: y, (), size)


def dead_zone(c, width: float = 0.1):
    """0 for actions smaller than the width; a plain projection."""
    return F.when(F.abs(c) < width, 0.0).otherwise(F.col(c) if isinstance(c, str) else c)


def funding(df: DataFrame, noise: str, theta: float, mu: float, sigma: str | float, dt: float = 1.0, start: float = 0.0, bound: tuple[float, float] = (-1e-3, 3e-3), keys: Keys = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    """Mean-reverting rate driven by a column of noise (and of volatility, if sigma names one), clipped at the end."""
    inputs = [noise, sigma] if isinstance(sigma, str) else [noise]

    def maps(r):
        s = r[sigma] if isinstance(sigma, str) else sigma
        return [(np.full(len(r["rn"]), 1 - theta * dt), theta * mu * dt + s * np.sqrt(dt) * r[noise])]

    return recursion(df, keys, order, inputs, ["funding_rate"], [start], maps, lambda r, y: [np.clip(y[0], *bound)], (), size)


def running_normalization(df: DataFrame, reward: str = "reward", gamma: float = 0.99, bound: float = 10.0, keys: Keys = ("episode",), order: str = "t", size: int = BLOCK_ROWS) -> DataFrame:
    """Rewards over the running deviation of their discounted sums, clipped. The sums are one recursion, their running moments another."""
    d = recursion(df, keys, order, [reward], ["__sum"], [0.0], lambda r: [(np.full(len(r["rn"]), gamma), r[reward])], lambda r, y: y, (), size)

    def finish(r, y):
        n = 1e-4 + r["rn"] + 1
        spread = (1e-4 + y[1] - y[0] ** 2 / n) / n
        return [np.clip(r[reward] / np.sqrt(np.maximum(spread, 0) + 1e-8), -bound, bound)]

    ones = lambda r: np.ones(len(r["rn"]))
    return recursion(settled(d), keys, order, [reward, "__sum"], ["normalized"], [0.0, 0.0], lambda r: [(ones(r), r["__sum"]), (ones(r), r["__sum"] ** 2)], finish, (), size).drop("__sum")
