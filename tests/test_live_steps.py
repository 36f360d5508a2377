"""The live environment step against the batch one: over micro-batches, after a restart, with late rows, timers and restarts in place."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolith.operators import features, portfolio
from chronolith.streaming import steps as live

T0 = datetime(2024, 1, 1)
SCHEMA = "asset string, ts timestamp, close double, action double"


def rows(n=60, seed=1, assets=("a", "b"), scale=0.02):
    rng, out = np.random.default_rng(seed), []
    for x in assets:
        price = 100 * np.exp(np.cumsum(rng.normal(size=n) * scale))
        out += [(x, T0 + timedelta(hours=k), float(price[k]), float(np.sign(rng.normal()))) for k in range(n)]
    return out


def written(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def same(got, want, names):
    got, want = (d.orderBy("asset", "t").select("asset", "t", *names).collect() for d in (got, want))
    assert len(got) == len(want) and len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a["asset"] == b["asset"] and a["t"] == b["t"]
        for c in names:
            assert (a[c] is None) == (b[c] is None) and (b[c] is None or abs(a[c] - b[c]) < 1e-9), (a, b)


BREAKER = portfolio.Breaker(0.005)
RULES = portfolio.Rules(funding=0.0001)


def test_stream_equals_backtest_also_after_a_restart(spark, tmp_path):
    data = rows()
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    cut = lambda a, b: [r for r in data if T0 + timedelta(hours=a) <= r[1] < T0 + timedelta(hours=b)]
    how = {"rules": RULES, "breaker": BREAKER}
    written(spark, src, [cut(0, 10), cut(10, 25)])
    live.replayed(spark, src, out, state, SCHEMA, 1, **how)
    assert spark.read.parquet(out).count() == 2 * 24
    written(spark, src, [cut(25, 26) + cut(3, 4), cut(26, 60)])  # one row comes late, again
    live.replayed(spark, src, out, state, SCHEMA, 1, **how)
    got = spark.read.parquet(out)
    want = portfolio.backtest(spark.createDataFrame(data, SCHEMA), RULES, breaker=BREAKER)
    same(got, want, ["price", "next_price", *portfolio.Account.TELLS])
    assert got.where("panic > 0").count() > 0
    # the bounded history gives what windows over the whole table give
    w = Window.partitionBy("asset").orderBy("ts")
    d = want.withColumn("log", F.log("nav") - F.log(F.lag("nav").over(w)))
    d = features.turnover(d.withColumns({"nav_vol": features.nav_volatility(d, "log"), "downside": features.downside_deviation(d)}))
    same(got, d, ["nav_vol", "turnover", "downside"])


def test_a_timer_closes_an_idle_episode(spark, tmp_path):
    data = rows(8, assets=("a",))
    later = [("a", T0 + timedelta(hours=50 + k), 100.0 + k, 1.0) for k in range(3)]
    clock = [("z", T0 + timedelta(hours=30), 1.0, 0.0)], [("z", T0 + timedelta(hours=31), 1.0, 0.0)]
    src = f"{tmp_path}/in"
    written(spark, src, [data, clock[0], clock[1], later])
    live.replayed(spark, src, f"{tmp_path}/out", f"{tmp_path}/state", SCHEMA, 1, idle="12 hours")
    got = [(r["event"], r["t"]) for r in spark.read.parquet(f"{tmp_path}/out").where("asset = 'a'").orderBy("ts", "event").collect()]
    assert got == [("step", k) for k in range(7)] + [("closed", 7), ("step", 0), ("step", 1)]


@pytest.mark.parametrize("restart", [False, True])
def test_a_broke_episode_ends_or_restarts_in_place(spark, restart):
    prices = [100.0, 100.0, 900.0, 100.0, 110.0, 120.0]  # short while the price goes up ninefold
    data = [("a", T0 + timedelta(hours=k), p, -1.0) for k, p in enumerate(prices)]
    rules = portfolio.Rules(target_vol=1.0)
    got = live.steps(spark.createDataFrame(data, SCHEMA), rules, restart=restart).orderBy("ts").collect()
    assert got[1]["nav"] <= 0 and got[1]["reward"] == -1
    assert [(r["episode"], r["t"]) for r in got] == [(0, 0), (0, 1)] + ([(1, 0), (1, 1)] if restart else [])


def test_lanes_restart_in_place(spark):
    """Against plain loops: a broke episode is shorter, the last one is cut, one runs out of rows."""
    data = rows(120, 3) + [("c", T0 + timedelta(hours=k), p, -1.0) for k, p in enumerate([100.0, 100.0, 900.0] + [100.0 + j for j in range(40)])]
    starts = [(a, lane, e, lane * 7 + e * 11) for a in ("a", "b") for lane in range(3) for e in range(4)] + [("c", 0, 0, 0), ("c", 0, 1, 5), ("c", 0, 2, 40), ("c", 0, 3, 2)]
    rules, want = portfolio.Rules(target_vol=1.0), {}
    for asset, lane in sorted({s[:2] for s in starts}):
        series, step = [r for r in data if r[0] == asset], 0
        for _, _, episode, begin in sorted(s for s in starts if s[:2] == (asset, lane)):
            part = series[begin : begin + 21]
            for t, nav in enumerate(portfolio.simulate(np.array([r[2] for r in part]), np.array([r[3] for r in part]), rules)["nav"]):
                if step < 70:
                    want[asset, lane, step] = (episode, t, nav)
                step += 1
    got = portfolio.lanes(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(starts, "asset string, lane int, episode int, start bigint"), 20, 70, rules).collect()
    told = {(r["asset"], r["lane"], r["step"], r["episode"], r["t"]): r["nav"] for r in got}
    assert told == pytest.approx({(*k, e, t): float(nav) for k, (e, t, nav) in want.items()}) and len(got) == len(want)
    assert ("c", 0, 2) in want and want["c", 0, 2][:2] == (1, 0)


def test_odd_rows(spark):
    assert live.steps(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [("a", T0, 1.0, None), ("a", T0, 2.0, 1.0), (None, T0, 1.0, 1.0), (None, T0 + timedelta(hours=1), 1.0, None)]
    assert [r["asset"] for r in live.steps(spark.createDataFrame(one, SCHEMA).withColumn("waiting", F.lit("x"))).collect()] == [None]
    with pytest.raises(ValueError):
        live.steps(spark.createDataFrame([], SCHEMA), breaker=portfolio.Breaker(0.1, window=9))
