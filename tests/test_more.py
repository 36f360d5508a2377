"""Signals, slices, probes, what is saved."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import audit, indicators, portfolio, probes, regime, scale, slices, split, stationarity, sync
from chronolith.sources import synthetic, writers

T0 = datetime(2024, 1, 1)


def test_oracle_bars_carry_their_signal(spark):
    d = synthetic.oracle_bars(spark, 500, ("a", "b"))
    assert d.count() == 1000 and all(r["signal_corr"] > 0.8 for r in synthetic.oracle_correlation(d).collect())
    assert d.where("high < greatest(open, close) or low > least(open, close)").count() == 0


def test_probe_beats_the_majority(spark):
    from pyspark.sql import Window

    d = split.split(synthetic.oracle_bars(spark, 600), purge=0)
    d = d.withColumn("y", (F.lead("close").over(Window.partitionBy("asset").orderBy("ts")) > F.col("close")).cast("int")).where("y is not null")
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    assert probes.signal(train, test, ["signal", "volume"], "y").first()["gain"] > 2
    assert probes.signal(train, test, ["volume"], "y").first()["gain"] < 15


def test_saved_scaler_and_model(spark, tmp_path):
    d = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(np.random.default_rng(0).normal(size=150))], "segment string, ts int, x double")
    s = scale.fit(d, ["x"])
    writers.save_scaler(s, f"{tmp_path}/s")
    again = scale.transform(d, writers.load_table(spark, f"{tmp_path}/s"), ["x"])
    assert again.exceptAll(scale.transform(d, s, ["x"])).count() == 0
    writers.save_model(regime.fit(d, ["x"], ("segment",), states=2, rounds=5, tries=1), f"{tmp_path}/m")
    assert regime.forward_filter(d, writers.load_table(spark, f"{tmp_path}/m"), ["x"], ("segment",), states=2).where("hmm_entropy is null").count() == 0
    writers.export_json(spark.createDataFrame([(float("nan"), 1)], "a double, b int"), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"a":null,"b":1}'


def test_finite_rows(spark):
    d = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert slices.finite_rows(d, ["x"]).count() == 1
    with pytest.raises(ValueError):
        slices.finite_rows(d, ["x"], 2)
    with pytest.raises(ValueError):
        slices.require(d, ["y"])
    assert slices.as_float(d, ["x"]).schema["x"].dataType.simpleString() == "float"


def test_kpss_tells_a_walk_from_noise(spark):
    rng = np.random.default_rng(1)
    rows = [("w", k, float(x)) for k, x in enumerate(np.cumsum(rng.normal(size=800)))] + [("n", k, float(x)) for k, x in enumerate(rng.normal(size=800))]
    got = {r["asset"]: r["stationary"] for r in stationarity.kpss(spark.createDataFrame(rows, "asset string, ts int, x double"), "x").collect()}
    assert got == {"w": False, "n": True}


def test_adf_equals_least_squares(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=300)) * 0.5
    got = stationarity.adf(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "asset string, ts int, x double"), "x").first()
    d, best = np.diff(x), None
    for lagged in (0, 1):
        y = d[1:]
        z = np.column_stack([x[1:-1], np.ones(len(y))] + ([d[:-1]] if lagged else []))
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        e = y - z @ b
        tau = b[0] / np.sqrt(e @ e / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        aic = len(y) * np.log(e @ e / len(y)) + 2 * z.shape[1]
        best = (aic, tau) if best is None or aic < best[0] else best
    assert got["tau"] == pytest.approx(best[1], abs=1e-6)


def test_funding_reverts_to_its_mean(spark):
    d = spark.range(200).select(F.lit("a").alias("asset"), F.col("id").alias("ts"), F.lit(0.0).alias("e"))
    got = indicators.funding(d, "e", 0.1, 1e-4, 0.01, start=2e-3).orderBy("ts").collect()
    assert got[0]["funding_rate"] > got[-1]["funding_rate"] and abs(got[-1]["funding_rate"] - 1e-4) < 1e-9


def test_running_normalization_is_bounded(spark):
    d = spark.range(100).select(F.lit(1).alias("episode"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("reward"))
    assert indicators.running_normalization(d).where("abs(normalized) > 10").count() == 0


def test_episodes_repeat_shared_rows(spark):
    d = synthetic.oracle_bars(spark, 100).select("asset", "ts", "close")
    starts = spark.createDataFrame([("a", 0, 0), ("a", 1, 30)], "asset string, episode int, start int")
    e = portfolio.episodes(d, starts, 50)
    assert e.groupBy("episode").count().collect()[0]["count"] == 51
    steps = portfolio.backtest(portfolio.buy_and_hold(e), keys=("asset", "episode"))
    assert steps.groupBy("episode").count().where("count <> 50").count() == 0
    assert audit.environment_snapshot(steps).count() == 50 and portfolio.breaker_stats(steps, ("asset", "episode")).count() == 2


def test_align_takes_the_last_row_of_an_hour(spark):
    rows = [("m", T0 + timedelta(hours=k), float(k)) for k in range(4)] + [("x", T0 + timedelta(minutes=5), 1.0), ("x", T0 + timedelta(minutes=50), 2.0), ("x", T0 + timedelta(hours=2, minutes=1), 3.0)]
    got = sync.align(spark.createDataFrame(rows, "asset string, ts timestamp_ntz, close double"), "m", ("close",))
    assert [r["close"] for r in got.where("asset = 'x'").orderBy("ts").collect()] == [2.0, 2.0, 3.0, 3.0]


def test_class_and_training_audits(spark):
    d = spark.createDataFrame([(0.99, 1.0, 2.0), (0.1, 0.0, -4.0)], "action double, cost double, gain double")
    r = audit.training_diagnostics(d).first()
    assert r["saturation"] == 0.5 and r["churn_ratio"] == pytest.approx(1 / 6)
    assert regime.transition_diagnostics(np.eye(4))["kind"] == "STICKY"


def test_ensemble_agreement_and_calibration(spark):
    """Members that differ too much give the fixed action; spreads without a running mean stay as they are."""
    from chronolith.operators import ensemble

    d = spark.createDataFrame([(0, [0.5, 0.5], [1.0, 3.0], 2.0), (1, [-1.0, 1.0], [1.0, 1.0], 2.0), (2, [0.5, 0.4], [1.0, 3.0], None)], "k int, actions array<double>, spreads array<double>, ema double")
    config = ensemble.Config(min_agreement=0.5, disagreement_action=0.25, pessimistic_scaling=False)
    got = {r["k"]: r for r in ensemble.predict(d, config, spread_ema="ema").collect()}
    assert got[0]["action"] == pytest.approx(0.5) and got[1]["action"] == 0.25 and got[1]["agreement"] == 0
    w = np.exp([-1.0, -3.0])
    assert got[2]["action"] == pytest.approx(w @ [0.5, 0.4] / w.sum())
    n = {r["k"]: r["n"] for r in d.select("k", ensemble.normalized_spreads(F.col("spreads"), F.col("ema")).alias("n")).collect()}
    assert n[0] == pytest.approx([1 / (2 + 1e-6), 3 / (2 + 1e-6)]) and n[2] == [1.0, 3.0]
    kept = ensemble.predict(d, ensemble.Config(aggregation="mean", pessimistic_scaling=False)).where("k = 1").first()
    assert kept["action"] == 0


def test_masked_assignment_keeps_every_row(spark):
    d = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("-inf"),)], "x double")
    got = [r["y"] for r in slices.assign_finite(d, ["x"], {"y": F.col("x") + 1}).collect()]
    assert got == [2.0, None, None, None]
    assert slices.assign_finite(d.limit(0), ["x"], {"y": F.col("x")}).count() == 0
