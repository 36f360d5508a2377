"""Recursions, positions and beliefs over blocks of a series equal those over the whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import indicators as ind
from chronolith.operators import regime, split

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """Two series, one with NULLs at its head and a single row of a third; hours with gaps."""
    rng, rows = np.random.default_rng(4), []
    for asset, n in (("a", 700), ("b", 90), ("c", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.02))
        at = np.cumsum(rng.integers(1, 4, size=n))
        for k in range(n):
            none = asset == "b" and k < 5
            h, l, c = close[k] * 1.01, close[k] * 0.98, close[k]
            rows.append((asset, T0 + timedelta(hours=int(at[k])), k, *(None if none else float(v) for v in (h, l, c)), float(rng.normal())))
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, k int, high double, low double, close double, e double").cache()


def series(df, column):
    out = {}
    for r in df.orderBy("asset", "ts").collect():
        out.setdefault(r["asset"], []).append(math.nan if r[column] is None else r[column])
    return {k: np.array(v) for k, v in out.items()}


def whole(bars, f, columns=("high", "low", "close")):
    """f of each series' arrays, from its first value on."""
    got, out = {c: series(bars, c) for c in columns}, {}
    for a, x in got[columns[0]].items():
        head = int(np.argmax(np.isfinite(x)))
        out[a] = np.concatenate((np.full(head, math.nan), f(*[got[c][a][head:] for c in columns])))
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for a in want:
        np.testing.assert_allclose(got[a], want[a], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("size", [64, 8192])
def test_indicators(bars, size):
    with np.errstate(all="ignore"):
        equal(series(ind.rsi(bars, size=size), "rsi"), whole(bars, ind.rsi_of, ("close",)))
        equal(series(ind.macd(bars, size=size), "macd_hist"), whole(bars, lambda c: ind.macd_of(c)[1], ("close",)))
        equal(series(ind.adx(bars, size=size), "adx"), whole(bars, ind.adx_of))
        equal(series(ind.atr_ratio(bars, size=size), "atr_ratio"), whole(bars, lambda h, l, c: ind.wilder(ind.true_range(h, l, c), 14) / c))
        both = ind.momentum(bars, size=size)
        assert both.columns == [*bars.columns, "rsi", "macd_hist", "adx"]
        equal(series(both, "adx"), whole(bars, ind.adx_of))
        equal(series(both, "macd_hist"), whole(bars, lambda c: ind.macd_of(c)[1], ("close",)))


def folded(x, step, start):
    out, y = [], start
    for v in x:
        y = step(y, v)
        out.append(y)
    return np.array(out)


def test_other_recursions(bars):
    e = lambda f: whole(bars, f, ("e",))
    equal(series(ind.ema_volatility(bars, "e", size=50), "ema_vol"), e(lambda x: np.sqrt(folded(x, lambda y, v: 0.08 * v * v + 0.92 * y, 0.0025))))
    equal(series(ind.smoothed_action(bars, "e", size=50), "smoothed"), e(lambda x: folded(x, lambda y, v: v if y is None else 0.3 * v + 0.7 * y, None)))
    equal(series(ind.funding(bars, "e", 0.1, 1e-4, 1e-4, start=2e-3, size=50), "funding_rate"), e(lambda x: np.clip(folded(x, lambda y, v: y + 0.1 * (1e-4 - y) + 1e-4 * v, 2e-3), -1e-3, 3e-3)))

    def normalized(x):
        n, mean, m2, g, out = 1e-4, 0.0, 1e-4, 0.0, []
        for v in x:
            g = 0.99 * g + v
            n += 1
            d = g - mean
            mean += d / n
            m2 += d * (g - mean)
            out.append(np.clip(v / np.sqrt(m2 / n + 1e-8), -10, 10))
        return np.array(out)

    # Welford's update gives the prior no weight in the mean's square, so only the first rows differ, by 1e-4 of a part
    got, want = series(ind.running_normalization(bars, "e", keys=("asset",), order="k", size=50), "normalized"), e(normalized)
    for a in want:
        np.testing.assert_allclose(got[a], want[a], rtol=1e-6, atol=1e-6)


def test_numbers(spark, bars):
    from pyspark.sql import Window

    w = Window.partitionBy("asset")
    want = bars.select("asset", "ts", (F.row_number().over(w.orderBy("ts")) - 1).cast("long").alias("rn"), F.count("*").over(w).alias("n"))
    got = split.numbered(bars)
    assert got.columns == [*bars.columns, "rn", "n"]
    assert got.select("asset", "ts", "rn", "n").exceptAll(want).count() == 0 and got.count() == want.count()
    assert split.numbered(bars.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 1), (None, 9000), ("a", None), ("a", 3)], "asset string, k int")
    assert sorted((r["asset"] or "", r["rn"], r["n"]) for r in split.numbered(odd, order="k").collect()) == [("", 0, 2), ("", 1, 2), ("a", 0, 2), ("a", 1, 2)]


def test_a_long_series_is_many_tasks(spark):
    d = spark.range(1_000_000).select(F.lit("a").alias("asset"), F.col("id").alias("ts"), (100 + F.sin(F.col("id") / 50) * 5 + F.pmod(F.hash("id"), 100) / 100).alias("close"))
    got = ind.rsi(d, order="ts")
    tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
    assert tasks > 1
    close = np.array([r["close"] for r in d.orderBy("ts").collect()])
    values = got.orderBy("ts").select("rsi").toPandas()["rsi"].to_numpy(dtype=float)
    np.testing.assert_allclose(values, ind.rsi_of(close), rtol=1e-9, atol=1e-9)


MODEL = {
    "start": [0.5, 0.3, 0.2], "trans": [[0.9, 0.08, 0.02], [0.2, 0.7, 0.1], [0.05, 0.15, 0.8]], "weights": [[0.6, 0.4], [0.5, 0.5], [0.3, 0.7]],
    "means": [[[-1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [1.5, -1.0]], [[3.0, 2.0], [2.0, 3.0]]], "vars": [[[1.0, 0.5], [0.5, 1.0]], [[0.8, 1.0], [2.0, 1.0]], [[1.0, 1.0], [0.5, 0.5]]],
}
ARRAYS = {k: np.array(v) for k, v in MODEL.items()}


@pytest.fixture(scope="module")
def walk(spark):
    """Two series with gaps and rows that aren't finite; one has no finite row."""
    rng, rows = np.random.default_rng(9), []
    for asset, n in (("a", 400), ("b", 130), ("c", 3)):
        level = np.repeat(rng.normal(size=n // 10 + 1) * 2, 10)[:n]
        for k in range(n):
            x = None if asset == "c" or k % 37 == 5 else float(level[k] + rng.normal())
            rows.append((asset, k if k < 200 else k + 100, x, float(rng.normal()) if k % 53 else float("nan")))
    return spark.createDataFrame(rows, "asset string, ts bigint, x double, y double").cache()


def finite(walk, asset):
    rows = [(r["x"], r["y"]) for r in walk.where(F.col("asset") == asset).orderBy("ts").collect()]
    x = np.array([[math.nan if v is None else v for v in r] for r in rows], dtype=float)
    return x[np.isfinite(x).all(axis=1)]


@pytest.mark.parametrize("size", [32, 8192])
def test_beliefs(walk, size):
    got = regime.forward_filter(walk, MODEL, ["x", "y"], states=3, size=size)
    smooth = regime.smoothed_beliefs(walk, MODEL, ["x", "y"], states=3, size=size)
    assert got.count() == walk.count() and got.where("asset = 'c' and hmm_entropy is not null").count() == 0
    for a in ("a", "b"):
        logs = regime.log_emissions(finite(walk, a), ARRAYS)
        take = lambda d, names, a=a: np.array([[r[n] for n in names] for r in d.where(F.col("asset") == a).where(f"{names[0]} is not null").orderBy("ts").collect()])
        np.testing.assert_allclose(take(got, [f"hmm_prob_{k}" for k in range(3)]), regime.forward(logs, ARRAYS), atol=1e-8)
        np.testing.assert_allclose(take(smooth, [f"prob_{k}" for k in range(3)]), regime.smoothed(logs, ARRAYS)[0], atol=1e-9)


def plain_rounds(x, m, rounds):
    likes = []
    for _ in range(rounds):
        gamma, moves, like = regime.smoothed(regime.log_emissions(x, m), m)
        parts = np.log(m["weights"] + regime.TINY)[None] - 0.5 * (np.log(2 * np.pi * m["vars"])[None] + (x[:, None, None, :] - m["means"][None]) ** 2 / m["vars"][None]).sum(axis=3)
        share = np.exp(parts) / np.exp(parts).sum(axis=2, keepdims=True) * gamma[:, :, None]
        total = share.sum(axis=0)
        means = np.einsum("nkm,nf->kmf", share, x) / total[..., None]
        v = np.einsum("nkm,nkmf->kmf", share, (x[:, None, None, :] - means[None]) ** 2) / total[..., None]
        m = {"start": gamma[0], "trans": moves / moves.sum(axis=1, keepdims=True), "weights": total / total.sum(axis=1, keepdims=True), "means": means, "vars": np.maximum(v, 1e-2)}
        likes.append(like)
    return m, likes


def test_fit_over_blocks_equals_the_local_rounds(spark, walk):
    start = spark.createDataFrame([(a, *[MODEL[k] for k in ("start", "trans", "weights", "means", "vars")]) for a in ("a", "b")], f"asset string, {regime.PARAMETERS}")
    got = {r["asset"]: r for r in regime.fit_blocks(walk.where("asset <> 'c'"), ["x", "y"], start, rounds=3, tolerance=-1e9, size=64).collect()}
    for a in ("a", "b"):
        want, likes = plain_rounds(finite(walk, a), ARRAYS, 3)
        assert likes == sorted(likes) and got[a]["like"] == pytest.approx(likes[-1], abs=1e-6) and got[a]["n"] == len(finite(walk, a))
        for k, v in want.items():
            np.testing.assert_allclose(np.array(got[a][k]), v, rtol=1e-6, atol=1e-8)
