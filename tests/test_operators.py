"""Operators against plain references, invariants and plans."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolith.functions.numeric import clip, entropy, softmax
from chronolith.functions.windows import blocked, fill_forward, unblocked
from chronolith.operators import audit, ensemble, features, indicators, metrics, portfolio, regime, scale, split, stationarity, sync

T0 = datetime(2024, 1, 1)


def series(spark, n=200, assets=("a", "b"), seed=1, step=lambda rng: rng.normal(0, 0.02)):
    rng = np.random.default_rng(seed)
    rows = []
    for a in assets:
        p = 100.0
        for k in range(n):
            o = p
            p *= math.exp(step(rng))
            rows.append((a, T0 + timedelta(hours=k), o, max(o, p) * 1.01, min(o, p) * 0.99, p, float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def values(df, c, asset="a"):
    return [r[c] for r in df.where(F.col("asset") == asset).orderBy("ts").collect()]


@pytest.mark.parametrize("size", [40, 97])
def test_blocks_change_nothing(spark, size):
    d = series(spark)
    b = blocked(d, 23, size)
    got = unblocked(b.withColumn("z", features.zscore(b, "close", 24)))
    want = d.withColumn("z", features.zscore(d, "close", 24))
    assert np.allclose(values(got, "z")[23:], values(want, "z")[23:])
    assert values(got, "z")[:23] == [None] * 23 and got.count() == d.count()


def test_fill_forward_over_blocks(spark):
    random.seed(3)
    d = series(spark).withColumn("x", F.when(F.pmod(F.xxhash64("ts", "asset"), F.lit(9)) == 0, F.col("close")))
    got, seen, want = values(fill_forward(d, ["x"], size=17), "x"), None, []
    for v in values(d, "x"):
        seen = v if v is not None else seen
        want.append(seen)
    assert got == want


def test_no_single_partition_exchange(spark):
    plan = features.feature_panel(series(spark), 0.4, 48, 48)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_feature_panel_equals_single_features(spark):
    d = series(spark, 150)
    got = features.feature_panel(d, 0.4, 48, 48, 24)
    assert np.allclose(values(got, "gk")[23:], values(d.withColumn("g", features.garman_klass(d)), "g")[23:])
    assert np.allclose(values(got, "vol_zscore"), values(d.withColumn("g", features.volume_zscore(d, 48)), "g"))


def test_no_look_ahead(spark):
    d = series(spark, 160)
    assert stationarity.prefix_invariant(d, lambda x: features.feature_panel(x, 0.4, 24, 24), 100, ["zscore", "gk", "fracdiff", "log_ret"])
    assert stationarity.prefix_invariant(d, lambda x: indicators.momentum(x), 100, ["rsi", "adx", "macd_hist"])


@pytest.mark.parametrize(("d", "width"), [(0.3, 101), (0.9, 101), (0.95, 79), (1.0, 2)])
def test_ffd_widths(d, width):
    assert len(features.ffd_weights(d)) == width


def test_rsi_bounds_and_flat():
    assert indicators.rsi_of(np.arange(40.0))[-1] == 100
    assert np.isnan(indicators.rsi_of(np.arange(40.0))[13]) and indicators.rsi_of(np.arange(40.0)[::-1])[14] == 0
    x = 100 + np.cumsum(np.random.default_rng(0).normal(size=300))
    assert ((v := indicators.rsi_of(x)[14:]) >= 0).all() and (v <= 100).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(10, 20000), st.integers(0, 900))
def test_split_laws(n, purge):
    a, b = int(n * 0.7), math.floor(n * (0.7 + 0.15))
    train, val, test = a, max(0, b - a - purge), max(0, n - b - purge)
    assert train + val + test <= n and train == int(n * 0.7)


def test_split_of_5000(spark):
    d = spark.range(5000).select(F.lit("a").alias("asset"), F.col("id").alias("ts"))
    got = {r["split"]: (r["n"], r["lo"]) for r in split.split(d).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("lo")).collect()}
    assert got == {"train": (3500, 0), "val": (30, 4220), "test": (30, 4970)}


def test_walk_forward_defaults(spark):
    wf = split.WalkForward()
    assert wf.size == 13704
    s = wf.segments(spark, 20000, 7).orderBy("segment").collect()
    assert [(r["train_start"], r["eval_start"], r["test_end"]) for r in s] == [(7, 10087, 13687), (2167, 12247, 15847), (4327, 14407, 18007)]
    assert wf.segments(spark, 13703).count() == 0


def test_purge_must_cover_the_look_back():
    assert split.check_purge(720) and not split.check_purge(50, strict=False)
    with pytest.raises(ValueError):
        split.check_purge(50)


def test_scaler_sees_train_only(spark):
    rng = np.random.default_rng(42)
    d = spark.createDataFrame([(0, "a", "train", float(x)) for x in rng.normal(size=500)] + [(0, "a", "test", float(x)) for x in rng.normal(20, 2, size=300)], "segment int, asset string, split string, x double")
    got = scale.by_segment(d, ["x"])
    assert abs(got.where("split = 'train'").agg(F.percentile("x", 0.5)).first()[0]) < 1e-9
    assert got.where("split = 'test'").agg(F.avg("x")).first()[0] > 10
    flat = scale.fit(d.withColumn("x", F.lit(3.0)), ["x"]).first()
    assert flat["scale"] == 0.01
    with pytest.raises(ValueError):
        scale.check_finite(d.withColumn("x", F.lit(None).cast("double")), ["x"])


def test_clip_keeps_nulls(spark):
    got = spark.createDataFrame([(None,), (-9.0,), (9.0,)], "x double").select(clip("x", -5, 5).alias("c")).collect()
    assert [r["c"] for r in got] == [None, -5.0, 5.0]


def test_entropy_and_softmax(spark):
    r = spark.range(1).select(entropy(F.array(*[F.lit(0.25)] * 4)).alias("u"), entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("s"), softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("m")).first()
    assert abs(r["u"] - 1) < 1e-12 and r["s"] == 0 and r["m"] == [0.5, 0.5]


# ---------------------------------------------------------------- simulation


def test_holding_isnt_rebalanced():
    got = portfolio.simulate(np.array([100.0, 110, 121, 133.1]), np.ones(4), portfolio.Rules(commission=0, slippage=0, target_vol=1.0))
    assert got["trades"] == [1, 1, 1] and np.allclose(got["ret"], 0.1)


def test_costs_and_shorts():
    flat = np.full(50, 100.0)
    held = portfolio.simulate(flat, np.ones(50), portfolio.Rules(commission=0.001, slippage=0.0001))
    assert held["nav"][-1] < 10_000 and held["trades"][-1] >= 1
    down = portfolio.simulate(np.linspace(100, 90, 50), -np.ones(50), portfolio.Rules(commission=0, slippage=0, target_vol=1.0))
    up = portfolio.simulate(np.linspace(100, 110, 50), -np.ones(50), portfolio.Rules(commission=0, slippage=0, target_vol=1.0))
    assert down["nav"][-1] > 10_000 > up["nav"][-1]
    paid = portfolio.simulate(flat, -np.ones(50), portfolio.Rules(commission=0, slippage=0, funding=1e-4, target_vol=1.0))
    assert paid["nav"][-1] < 10_000 and portfolio.simulate(flat, np.ones(50), portfolio.Rules(commission=0, slippage=0, funding=1e-4, target_vol=1.0))["nav"][-1] == 10_000


def test_bankruptcy_ends_an_episode():
    got = portfolio.simulate(np.array([100.0, 500, 100, 100]), -np.ones(4), portfolio.Rules(target_vol=1.0))
    assert len(got["nav"]) == 1 and got["reward"] == [-1.0]


def test_breaker_forces_flat():
    price = np.concatenate((np.full(30, 100.0), np.linspace(100, 50, 20), np.full(20, 50.0)))
    got = portfolio.simulate(price, np.ones(len(price)), portfolio.Rules(target_vol=1.0), portfolio.Breaker(0.001, cooldown=5))
    k = got["panic"].index(1.0)
    assert got["position"][k + 1 : k + 5] == [0.0] * 4


def test_reward_uses_moments_before_their_update():
    s = portfolio.Sharpener(0.02, 0, -0.9)
    assert s.reward(0.01, 0) == pytest.approx(min(5, 10 * (1e-6 * 0.01) / 1e-8**1.5)) and s.a == pytest.approx(0.0002)


# ---------------------------------------------------------------- regimes


def known_model():
    return {"start": [0.5, 0.5], "trans": [[0.95, 0.05], [0.05, 0.95]], "weights": [[0.5, 0.5]] * 2, "means": [[[-2.0], [-2.0]], [[2.0], [2.0]]], "vars": [[[1.0], [1.0]]] * 2}


def states(n=600, seed=5):
    rng = np.random.default_rng(seed)
    z = (np.arange(n) // 60) % 2
    return z, rng.normal(np.where(z == 0, -2.0, 2.0), 1.0)


def test_forward_filter_finds_states_without_looking_ahead():
    z, x = states()
    m = {k: np.array(v) for k, v in known_model().items()}
    b = regime.forward(regime.log_emissions(x[:, None], m), m)
    assert (b.argmax(axis=1) == z).mean() > 0.97 and np.allclose(b.sum(axis=1), 1, atol=1e-6)
    assert np.allclose(b[:100], regime.forward(regime.log_emissions(x[:100, None], m), m))


def test_fit_recovers_states():
    z, x = states()
    m = regime.sorted_by(regime.fit_model(x[:, None], states=2, rounds=50, tries=1), 0)
    assert np.allclose(np.sort(regime.state_means(m)[:, 0]), [-2, 2], atol=0.4) and np.allclose(m["trans"].sum(axis=1), 1)
    g = regime.smoothed(regime.log_emissions(x[:, None], m), m)[0]
    assert (g.argmax(axis=1) == z).mean() > 0.95
    with pytest.raises(ValueError):
        regime.fit_model(x[:50, None])


def test_sticky_and_alignment():
    a = regime.sticky(np.array([[0.5, 0.5], [np.nan, 0.5]]), 0.9)
    assert np.allclose(a.sum(axis=1), 1) and a[0, 0] == pytest.approx(0.85)
    assert regime.aligned(np.array([[2.0, 0], [-2, 0]]), np.array([[-2.0, 0], [2, 0]]), np.array([1.0, 2.0])) == (1, 0)


def test_fit_and_filter_frames(spark):
    _, x = states(200)
    d = spark.createDataFrame([("s", k, float(v) if k != 7 else None) for k, v in enumerate(x)], "segment string, ts int, x double")
    m = regime.fit(d, ["x"], ("segment",), states=2, rounds=10, tries=1)
    got = regime.forward_filter(d, m, ["x"], ("segment",), states=2)
    assert got.where("hmm_prob_0 is null").select("ts").collect()[0]["ts"] == 7 and got.where("abs(hmm_prob_0 + hmm_prob_1 - 1) > 1e-6").count() == 0


# ---------------------------------------------------------------- audits and statistics


def one(spark, xs):
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in enumerate(xs)], "step int, x double")


@pytest.mark.parametrize(("xs", "status"), [(np.linspace(10, 2, 120), "CONVERGING"), (np.random.RandomState(123).normal(5, 0.5, 100), "STABLE (Noisy)"), (np.ones(30), "INSUFFICIENT_DATA"), (np.linspace(1, 60, 120), "DIVERGING"), (np.linspace(1, 2e4, 120), "EXPLODING")])
def test_trend_status(spark, xs, status):
    assert audit.trend_stats(one(spark, xs), "x", "step").first()["status"] == status


def test_trend_with_gaps(spark):
    xs = [None if 10 <= k < 14 else v for k, v in enumerate(np.linspace(1, 5, 120))]
    assert audit.trend_stats(one(spark, xs), "x", "step").first()["n"] == 120


def test_vif_and_adf(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    d = spark.createDataFrame([(float(x), float(y), float(x + 0.01 * z)) for x, y, z in zip(a, b, rng.normal(size=400))], "a double, b double, c double")
    v = {r["feature"]: r["vif"] for r in audit.vif(d, ["a", "b", "c"]).collect()}
    assert v["a"] > 1000 and v["b"] < 1.1
    walk, noise = np.cumsum(rng.normal(size=600)), rng.normal(size=600)
    d = spark.createDataFrame([("w", k, float(x)) for k, x in enumerate(walk)] + [("n", k, float(x)) for k, x in enumerate(noise)], "asset string, ts int, x double")
    got = {r["asset"]: r["stationary"] for r in stationarity.adf(d, "x").collect()}
    assert got == {"w": False, "n": True}


def test_ensemble_config_round_trip_and_methods(spark):
    c = ensemble.Config(aggregation="median", temperature=2.0)
    assert ensemble.Config.from_json(c.to_json()) == c
    d = spark.createDataFrame([([0.5, 0.7, 0.6], [0.1, 0.2, 0.3]), ([0.3, 0.5, 0.4], [0.1, 0.2, 0.3])], "actions array<double>, spreads array<double>")
    got = d.select(ensemble.aggregate(F.col("actions"), None, "mean").alias("m"), ensemble.aggregate(F.col("actions"), None, "conservative").alias("c")).collect()
    assert [round(r["m"], 9) for r in got] == [0.6, 0.4] and [r["c"] for r in got] == [0.5, 0.3]
    with pytest.raises(ValueError):
        ensemble.aggregate(F.col("actions"), None, "other")


def test_metrics_edges(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.1)], "k string, r double")
    got = {x["k"]: x for x in d.groupBy("k").agg(metrics.sharpe(F.col("r")).alias("s"), metrics.sortino(F.col("r")).alias("t"), metrics.profit_factor(F.col("r")).alias("p")).collect()}
    assert got["a"]["s"] == 0 and got["b"]["s"] == 0 and got["a"]["p"] == 0 and got["b"]["p"] is None and got["a"]["t"] == 0


def test_gaps_and_dedup(spark):
    d = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=30), 2.0), ("a", T0 + timedelta(hours=31), 3.0), ("a", T0, 9.0)], "asset string, ts timestamp_ntz, close double")
    assert sync.gaps(sync.one_row(d, ["asset", "ts"], ["close"]), 24).select("gap_hours").collect()[0][0] == 30
    assert sync.one_row(d, ["asset", "ts"], ["close"]).where(F.col("ts") == T0).first()["close"] == 9.0


def test_empty_frames(spark):
    d = series(spark).limit(0)
    assert sync.panel(d).count() == 0 and features.feature_panel(d).count() == 0 and split.split(d).count() == 0
