"""Registered queries on series of their own: every order, every segment, every parameter."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from oracle import duck, same

from chronolith.operators import features, regime, stationarity
from chronolith.plans import catalogue
from chronolith.plans.base import returns

T0 = datetime(2024, 1, 1)


def events(spark, path, series):
    """One event an hour and asset."""
    rows = [(k, T0 + timedelta(hours=k), a, float(v)) for a, x in series.items() for k, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{path}/e")
    next(path.glob("e/*.parquet")).rename(path / "events.parquet")
    return str(path)


def plain_order(x):
    """The least of all 15 orders whose difference passes the test, by least squares."""
    for d in np.round(np.arange(0.3, 1.01, 0.05), 2):
        w = features.ffd_weights(float(d))
        y = np.convolve(np.log(x), w, "valid")
        dy, best = np.diff(y), None
        for lagged in (0, 1):
            t = dy[1:]
            z = np.column_stack([y[1:-1], np.ones(len(t))] + ([dy[:-1]] if lagged else []))
            b = np.linalg.lstsq(z, t, rcond=None)[0]
            e = t - z @ b
            aic = len(t) * np.log(e @ e / len(t)) + 2 * z.shape[1]
            if best is None or aic < best[0]:
                best = (aic, b[0] / np.sqrt(e @ e / (len(t) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]))
        if len(t) >= 100 and best[1] < stationarity.critical(len(t)):
            return float(d)
    return 1.0


def test_least_order_tries_every_order(spark, tmp_path):
    series = {f"a{k}": np.exp(5 + 0.05 * np.cumsum(np.random.default_rng(k).normal(size=700))) for k in range(8)}
    want = {a: plain_order(x + 1) for a, x in series.items()}
    assert set(want.values()) - {0.3, 0.65, 1.0}
    got = {r["asset"]: r["d"] for r in catalogue.QUERIES["least_fracdiff_order"](spark, events(spark, tmp_path, series)).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["wfo_segments", "wfo_rows_per_split", "wfo_context_rows", "robust_scale_train_only"])
def test_segments_cover_longer_series(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    sf = events(spark, tmp_path, {"a": rng.uniform(1, 9, 960), "b": rng.uniform(1, 9, 960)})
    same(catalogue.QUERIES[name](spark, sf), duck(sf), catalogue.ORACLES[name].replace("range(0, 3)", "range(0, 5)"))  # 959 returns hold five segments


def test_regime_model_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["regime_model"](spark, sf).collect()
    rows = returns(spark, sf).orderBy("ts").toPandas()
    assert len(got) == rows["asset"].nunique()
    for r in got:
        m = {k: np.array(r[k]) for k in ("start", "trans", "weights", "means", "vars")}
        assert r["states"] == 4 and m["trans"].shape == (4, 4) and m["weights"].shape == (4, 2) and m["means"].shape == m["vars"].shape == (4, 2, 2)
        assert all(np.allclose(m[k].sum(axis=-1), 1) for k in ("start", "trans", "weights")) and (m["vars"] >= 1e-2).all()
        assert (np.diff(regime.state_means(m)[:, 0]) >= 0).all()
    x = rows[rows["asset"] == r["asset"]][["ret", "volume"]].to_numpy(dtype=float)
    want = regime.sorted_by(regime.fit_model(x, states=4, rounds=200, tries=3), 0)
    assert all(np.allclose(m[k], want[k], atol=1e-6) for k in m)
