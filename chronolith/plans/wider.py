"""Operators that no other query shows: the ensemble's calibration and agreement, average true range, masked assignment, values of a portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, ensemble, features, indicators, portfolio, regime, slices
from ..streaming import live
from .backtests import ENS, SD, WEIGHTED, members
from .base import BARS, PANEL, RETURNS, events, panel, query, r, returns, rounded
from .featured import N


@query(f"""with recursive {ENS}, e as (select ens.vec_id, label, list_avg(s) m, row_number() over (partition by label order by ens.vec_id) i from ens join embeddings using (vec_id)),
x as (select label, 1::bigint i, null::double k, m k2 from e where i = 1 union all select x.label, e.i, x.k2, 0.05e0 * e.m + 0.95e0 * x.k2 from x join e on e.label is not distinct from x.label and e.i = x.i + 1),
c as (select vec_id, a, case when k is null then s else list_transform(s, lambda y: y / (k + 1e-6)) end s from ens join e using (vec_id) join x on x.label is not distinct from e.label and x.i = e.i),
g as (select vec_id, {WEIGHTED} * greatest(least(1 - 2 * {SD}, 1), 0.1) act, greatest(least(1 - {SD}, 1), 0) agr from c) select vec_id, round(case when agr < 0.8 then 0.05e0 else act end, 6) + 0e0 as action, round(agr, 6) + 0e0 agreement from g""")
def ensemble_calibrated(spark, sf_dir):
    """Spreads over the running mean of earlier rows of the label, doubled aversion, a fixed action where members agree too little."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    m = members(spark, sf_dir).join(labels, "vec_id")
    config = ensemble.Config(risk_aversion=2.0, min_agreement=0.8, disagreement_action=0.05, calibrate_spread=True, ema_alpha=0.05)
    return rounded(ensemble.predict(m, config, keys=("label",), order="vec_id").select("vec_id", "action", "agreement"))


@query(f"""with recursive {PANEL}, {N}, l as (select *, lag(close) over (partition by asset order by ts) pc from n), d as (select asset, i, greatest(high - low, abs(high - pc), abs(low - pc)) tr from l where i > 1),
s as (select asset, avg(tr) tr from d where i <= 15 group by 1), x as (select asset, 15::bigint i, tr from s union all select x.asset, d.i, x.tr + (d.tr - x.tr) / 14 from x join d on d.asset = x.asset and d.i = x.i + 1)
select n.asset, n.ts, round(x.tr / nullif(n.close, 0), 6) + 0e0 atr_ratio from n left join x using (asset, i)""")
def atr_14(spark, sf_dir):
    return indicators.atr_ratio(panel(spark, sf_dir).select("asset", "ts", "high", "low", "close")).select("asset", "ts", r("atr_ratio").alias("atr_ratio"))


@query(f"""with {PANEL}, x as (select asset, ts, close - 20 a, case when volume > 1 then volume * 30 end b, (close - 50) * 100 c from panel)
select asset, ts, round(greatest(least(a, 100), 0), 6) + 0e0 hmm_rsi, round(greatest(least(coalesce(b, 0), 100), 0), 6) + 0e0 hmm_adx, round(greatest(least(c, 2000), -2000), 6) + 0e0 hmm_macd from x""")
def momentum_inputs(spark, sf_dir):
    """What goes into the regime model of columns in the indicators' ranges and beyond, some missing."""
    made = features.momentum_inputs(F.col("close") - 20, F.when(F.col("volume") > 1, F.col("volume") * 30), (F.col("close") - 50) * 100)
    return rounded(panel(spark, sf_dir).select("asset", "ts", *[c.alias(k) for k, c in made.items()]))


@query(f"with {PANEL} select asset, ts, round(open / 100, 6) + 0e0 as open, round(high / nullif(close, 0), 6) + 0e0 high, round(low / nullif(close, 0), 6) + 0e0 low from panel")
def price_relative(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(p.select("asset", "ts", *[c.alias(k) for k, c in features.price_relative(p, "open", ("high", "low")).items()]))


@query(f"with {PANEL} select asset, ts, round(volume * 100 + open * close, 6) + 0e0 nav from panel")
def portfolio_value(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("asset", "ts", portfolio.nav(F.col("volume") * 100, F.col("open"), F.col("close")).alias("nav")))


@query(f"with {PANEL} select asset, ts, round(case when volume > 1 then close / (volume - 1) * 2 + open end, 6) + 0e0 y from panel")
def masked_assignment(spark, sf_dir):
    """A column worked out on finite rows only; the others keep their place."""
    x = F.when(F.col("volume") > 1, F.col("close") / (F.col("volume") - 1)).otherwise(F.lit(float("nan")))
    d = panel(spark, sf_dir).withColumn("x", x)
    return rounded(slices.assign_finite(d, ["x", "open"], {"y": F.col("x") * 2 + F.col("open")}).select("asset", "ts", "y"))


NR = "n as (select asset, ts, ret, row_number() over (partition by asset order by ts) i from returns)"


@query(f"""with recursive {RETURNS}, {NR}, x as (select asset, i, 0.001e0 + 0.1e0 * (1e-4 - 0.001e0) + 0.0005e0 * ret x from n where i = 1 union all
  select x.asset, n.i, x.x + 0.1e0 * (1e-4 - x.x) + 0.0005e0 * n.ret from x join n on n.asset = x.asset and n.i = x.i + 1)
select n.asset, n.ts, round(greatest(least(x.x, 3e-3), -1e-3), 6) + 0e0 funding_rate from n join x using (asset, i)""")
def funding_rates(spark, sf_dir):
    """A mean-reverting rate driven by returns, so that its noise is a column."""
    got = indicators.funding(returns(spark, sf_dir).select("asset", "ts", "ret"), "ret", 0.1, 1e-4, 0.0005, start=1e-3)
    return got.select("asset", "ts", r("funding_rate").alias("funding_rate"))


@query(f"""with recursive {RETURNS}, {NR}, s as (select asset, i, ret g, 1 + 1e-4 c, ret / (1 + 1e-4) m, 1e-4 + ret * (ret - ret / (1 + 1e-4)) q from n where i = 1 union all
  select asset, i, g, c, m + d / c, q + d * (g - m - d / c) from (select s.asset, n.i, 0.99e0 * s.g + n.ret g, s.c + 1 c, s.m, s.q, 0.99e0 * s.g + n.ret - s.m d from s join n on n.asset = s.asset and n.i = s.i + 1))
select n.asset, n.ts, round(greatest(least(ret / sqrt(q / c + 1e-8), 10), -10), 6) + 0e0 normalized from n join s using (asset, i)""")
def normalized_rewards(spark, sf_dir):
    got = indicators.running_normalization(returns(spark, sf_dir).select("asset", "ts", "ret"), "ret", keys=("asset",), order="ts")
    return got.select("asset", "ts", r("normalized").alias("normalized"))


@query(f"""with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) - 1 rn from panel), s as (select unnest([0, 1, 2]) episode), a as (select distinct asset from panel)
select n.asset, s.episode::int episode, n.ts, n.close from n join a using (asset) join s on n.rn between s.episode * 40 and s.episode * 40 + 64""")
def overlapping_episodes(spark, sf_dir):
    p = panel(spark, sf_dir).select("asset", "ts", "close")
    starts = p.select("asset").distinct().withColumn("episode", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("start", F.col("episode") * 40)
    return portfolio.episodes(p, starts, 64).select("asset", "episode", "ts", "close")


@query(f"""with {RETURNS}, g as (select state, stddev_pop(ret) / 10 v, 100e0 * avg((ret > 0)::int) w from returns group by 1)
select state, (case when v < 0.05 then 'Low volatility' when v < 0.15 then 'Medium volatility' else 'High volatility' end) || ', ' || (case when w > 52 then 'bullish' when w < 48 then 'bearish' else 'neutral' end) words from g""")
def state_words(spark, sf_dir):
    got = returns(spark, sf_dir).groupBy("state").agg((F.stddev_pop("ret") / 10).alias("v"), (100 * F.avg((F.col("ret") > 0).cast("double"))).alias("w"))
    return got.select("state", regime.describe(F.col("v"), F.col("w")).alias("words"))


@query(f"""with {RETURNS}, d as (select asset, greatest(least(ret, 1), -1) a, abs(ret) * 0.001e0 c, ret g from returns)
select asset, round(avg((abs(a) > 0.95)::int), 6) saturation, round(avg(a), 6) + 0e0 mean_action, round(avg(abs(a)), 6) mean_abs_action, round(coalesce(sum(c) / nullif(sum(abs(g)), 0), 0), 6) churn_ratio from d group by 1""")
def action_diagnostics(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", F.greatest(F.least("ret", F.lit(1.0)), F.lit(-1.0)).alias("action"), (F.abs("ret") * 0.001).alias("cost"), F.col("ret").alias("gain"))
    return rounded(audit.training_diagnostics(d, ("asset",)))


@query(f"with {BARS} select asset, ts, open, high, low, close, volume from bars")
def live_bars(spark, sf_dir):
    """The streaming operator on a table: the bars of the batch one."""
    return live.hourly_bars(events(spark, sf_dir))


@query("""with l as (select event_type asset, ts, ts - lag(ts) over (partition by event_type order by ts) >= interval 3 hour as far from events), n as (select asset, ts, sum(coalesce(far, true)::int) over (partition by asset order by ts rows between unbounded preceding and current row) k from l)
select asset, min(ts) as start, max(ts) + interval 3 hour as "end", count(*) n from n group by asset, k""")
def live_sessions(spark, sf_dir):
    return live.sessions(events(spark, sf_dir))


@query("""with e as (select event_type, date_trunc('day', ts)::timestamp ts, event_id, value from events) select event_type, ts, max(event_id) event_id, arg_max(value, event_id) as value from e group by 1, 2""")
def live_latest(spark, sf_dir):
    """Of the rows of one key and time (days here), the last."""
    e = events(spark, sf_dir).select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return live.latest(e, ["event_type"])
