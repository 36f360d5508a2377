"""Ensembles, portfolio simulation, rewards, regime beliefs, stationarity, relational smoke queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, ensemble, metrics, portfolio, regime, split, stationarity
from ..operators import features as f
from .base import PANEL, RETURNS, panel, query, r, returns, rounded

ENS = "ens as (select vec_id, list_transform(embedding[1:5], lambda x: greatest(least(x::double * 2, 1), -1)) a, list_transform(embedding[6:10], lambda x: abs(x::double)) s from embeddings)"


def members(spark, sf_dir):
    """Five actions and spreads a row, of embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("e", F.col("embedding").cast("array<double>"))
    acts = F.transform(F.slice("e", 1, 5), lambda x: F.greatest(F.least(x * 2, F.lit(1.0)), F.lit(-1.0)))
    return e.select("vec_id", acts.alias("actions"), F.transform(F.slice("e", 6, 5), F.abs).alias("spreads"), "e")


SD = "sqrt(list_avg(list_transform(a, lambda x: (x - list_avg(a)) ** 2)))"
WEIGHTED = "list_sum(list_transform(range(1, 6), lambda i: exp(-s[i]) * a[i])) / list_sum(list_transform(s, lambda x: exp(-x)))"


@query(f"""with {ENS} select vec_id, round(list_avg(a), 6) + 0e0 mean, round(list_median(a), 6) + 0e0 median, round({WEIGHTED}, 6) + 0e0 confidence,
round(a[list_position(list_transform(a, lambda x: abs(x)), list_min(list_transform(a, lambda x: abs(x))))], 6) + 0e0 conservative, round(list_avg(a) * greatest(least(1 - {SD}, 1), 0), 6) + 0e0 pessimistic_bound from ens""")
def ensemble_actions(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.select("vec_id", *[r(ensemble.aggregate(F.col("actions"), F.col("spreads"), k)).alias(k) for k in ensemble.METHODS])


@query(f"""with {ENS}, g as (select vec_id, {WEIGHTED} * greatest(least(1 - {SD}, 1), 0.1) act, greatest(least(1 - {SD}, 1), 0) agr, list_max(s) * 8 ood from ens)
select vec_id, round(act, 6) + 0e0 as action, round(agr, 6) + 0e0 agreement, round(case when ood > 2.5 then 0e0 when ood > 1.5 then act * 0.25e0 else act end, 6) + 0e0 final_action, case when ood > 2.5 then 'OOD_FALLBACK' when ood > 1.5 then 'OOD_WARNING' else 'NORMAL' end mode from g""")
def ensemble_gated(spark, sf_dir):
    m = members(spark, sf_dir).withColumn("ood", F.array_max("spreads") * 8)
    return rounded(ensemble.predict(m, ensemble.Config(), ood="ood").select("vec_id", "action", "agreement", "final_action", "mode"))


@query("""with q as (select vec_id, list_max(list_transform(embedding, lambda x: x::double)) - list_min(list_transform(embedding, lambda x: x::double)) sp from embeddings) select vec_id, round(sp, 6) spread, round(1 / (sp + 1e-6), 6) confidence from q""")
def ensemble_spread(spark, sf_dir):
    s = ensemble.quantile_spread(F.col("e"))
    return rounded(members(spark, sf_dir).select("vec_id", s.alias("spread"), ensemble.member_confidence(s).alias("confidence")))


@query("""with k as (select case when label < 5 then 'single' else 'ensemble' end kind, embedding[1]::double + 1 x from embeddings),
g as (select avg(x) filter (kind = 'single') s, avg(x) filter (kind = 'ensemble') e, var_pop(x) filter (kind = 'single') sv, var_pop(x) filter (kind = 'ensemble') ev from k)
select round(s, 6) single_mean, round(e, 6) ensemble_mean, round(e - s, 6) + 0e0 delta, round(100 * (e - s) / abs(s), 6) + 0e0 delta_pct, round(100 * (1 - ev / sv), 6) + 0e0 variance_reduction_pct from g""")
def ensemble_comparison(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select(F.when(F.col("label") < 5, "single").otherwise("ensemble").alias("kind"), (F.get("embedding", 0).cast("double") + 1).alias("sharpe"))
    return rounded(ensemble.compare(d))


# ---------------------------------------------------------------- simulation; prices are made price-like first

PRICE = f"""{PANEL}, pr as (select asset, ts, row_number() over (partition by asset order by ts) i, 100 + ln(1 + close) price, close from panel),
st as (select *, lead(price) over (partition by asset order by ts) nxt from pr)"""
RULES = portfolio.Rules(funding=0.0001)
WALK = """w as (
  select asset, 0::bigint i, 10000e0 cash, 0e0 units, 0e0 held, 10000e0 peak, 0.0025e0 var, 10000e0 nav, 0::bigint trades, 0e0 dd from (select distinct asset from act)
  union all
  select asset, i + 1, cash3, units2, held2, greatest(peak, nav2), (2e0 / 25) * ret * ret + (1 - 2e0 / 25) * var, nav2, trades + ch, (greatest(peak, nav2) - nav2) / greatest(peak, nav2)
  from (select *, cash3 + units2 * nxt nav2, (cash3 + units2 * nxt - nav1) / greatest(nav1, 1e-8) ret
    from (select *, cash2 - case when units2 < 0 then abs(units2) * price * 0.0001e0 else 0e0 end cash3
      from (select *, case when ch = 1 then nav1 * tgt / price else units end units2, case when ch = 1 then tgt else held end held2,
              case when ch = 1 then cash - (nav1 * tgt / price - units) * price - abs(nav1 * tgt / price - units) * price * (0.0006e0 + 0.0001e0) else cash end cash2
        from (select *, (tgt <> held)::int ch
          from (select w.*, a.price, a.nxt, w.cash + w.units * a.price nav1,
                  greatest(least(round_even(greatest(least(a.act * greatest(least(0.05e0 / greatest(sqrt(w.var), 0.01e0), 5), 0.1), 1), -1) / 0.1e0, 0) * 0.1e0, 1), -1) tgt
            from w join act a on a.asset = w.asset and a.i = w.i + 1 where a.nxt is not null)))))
)"""


def priced(spark, sf_dir):
    return panel(spark, sf_dir).select("asset", "ts", (100 + F.log1p("close")).alias("close"), F.col("close").alias("raw"))


def value(steps):
    return steps.select("asset", F.col("t"), r(F.ln(F.col("nav") / 10_000), 8).alias("log_nav"), r("position", 4).alias("position"), F.col("trades").cast("long").alias("trades"), r("drawdown", 8).alias("drawdown"))


OUT = "select asset, i - 1 t, round(ln(nav / 10000), 8) + 0e0 log_nav, round(held, 4) + 0e0 as position, trades, round(dd, 8) + 0e0 drawdown from w where i > 0"


@query(f"with recursive {PRICE}, act as (select *, 1e0 act from st), {WALK} {OUT}")
def backtest_bh(spark, sf_dir):
    return value(portfolio.backtest(portfolio.buy_and_hold(priced(spark, sf_dir)), RULES))


@query(f"with recursive {PRICE}, act as (select *, coalesce(sign(nxt - price), 0)::double act from st), {WALK} {OUT}")
def backtest_oracle(spark, sf_dir):
    return value(portfolio.backtest(portfolio.oracle(priced(spark, sf_dir)), RULES))


@query(f"""with recursive {PRICE}, act as (select *, 1e0 act from st), {WALK}, e as (select asset, arg_max(nav, i) nav, arg_max(held, i) held, arg_max(trades, i) trades, count(*) n, max(dd) dd from w where i > 0 group by 1)
select asset, round(ln(nav / 10000), 8) + 0e0 log_nav, round(held, 4) + 0e0 final_position, trades, n episode_length, round(dd, 8) + 0e0 max_drawdown from e""")
def episode_end(spark, sf_dir):
    e = portfolio.episode_end(portfolio.backtest(portfolio.buy_and_hold(priced(spark, sf_dir)), RULES))
    return e.select("asset", r(F.ln(F.col("final_nav") / 10_000), 8).alias("log_nav"), r("final_position", 4).alias("final_position"), F.col("trades").cast("long").alias("trades"), "episode_length", r("max_drawdown", 8).alias("max_drawdown"))


@query(f"""with recursive {RETURNS}, x as (select asset, ts, ret / 100 al, row_number() over (partition by asset order by ts) i from returns),
d as (select asset, 0::bigint i, 0e0 a, 1e-6::double b, 0e0 d from (select distinct asset from x) union all
  select d.asset, x.i, d.a + 0.02e0 * (x.al - d.a), d.b + 0.02e0 * (x.al * x.al - d.b),
    case when x.i <= 200 then 10 * ln(1 + greatest(x.al, -0.9e0)) else greatest(least(10 * (d.b * (x.al - d.a) - 0.5e0 * d.a * (x.al * x.al - d.b)) / greatest(d.b - d.a * d.a, 1e-8) ** 1.5e0, 5), -5) end
  from d join x on x.asset = d.asset and x.i = d.i + 1)
select x.asset, x.ts, round(d.d, 6) + 0e0 reward from d join x using (asset, i)""")
def dsr_reward(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", (F.col("ret") / 100).alias("alpha"))
    return portfolio.sharpe_rewards(d, "alpha").select("asset", "ts", r("reward").alias("reward"))


#: The walk with a breaker: no action while it waits; it falls beyond three times a volatility of 0.005 over 25 values, or a drawdown of 0.2, for 12 steps.
BREAKER = WALK.replace("w as (", "wb as (", 1).replace("from w join act a on a.asset = w.asset and a.i = w.i + 1", "from wb w join act a on a.asset = w.asset and a.i = w.i + 1").replace(
    "0::bigint trades, 0e0 dd from", "0::bigint trades, 0e0 dd, 0 wait, []::double[] navs from"
).replace(
    "select asset, i + 1, cash3, units2, held2, greatest(peak, nav2), (2e0 / 25) * ret * ret + (1 - 2e0 / 25) * var, nav2, trades + ch, (greatest(peak, nav2) - nav2) / greatest(peak, nav2)\n  from (",
    """select asset, i + 1, cash3, units2, held2, peak2, (2e0 / 25) * ret * ret + (1 - 2e0 / 25) * var, nav2, trades + ch, dd2,
    case when greatest(wait - 1, 0) = 0 and (coalesce(list_stddev_pop(list_transform(range(2, len(navs2) + 1), lambda j: ln(navs2[j]) - ln(navs2[j - 1]))), 0) > 0.015e0 or dd2 > 0.2e0) then 12 else greatest(wait - 1, 0) end, navs2
  from (select *, greatest(peak, nav2) peak2, (greatest(peak, nav2) - nav2) / greatest(peak, nav2) dd2, list_append(navs, nav2)[-25:] navs2 from (""",
).replace("greatest(least(a.act * greatest(", "greatest(least(case when w.wait = 0 then a.act else 0 end * greatest(").replace("where a.nxt is not null)))))\n)", "where a.nxt is not null))))))\n)")


@query(f"""with recursive {PRICE}, act as (select *, coalesce(sign(nxt - price), 0)::double act from st), {BREAKER}, p as (select asset, i, wait > 0 panic, coalesce(lag(wait > 0) over (partition by asset order by i), false) before from wb where i > 0)
select asset, count(*) filter (panic and not before) triggers, count(*) filter (panic) panic_steps, round(count(*) filter (panic and not before) / count(*)::double, 6) + 0e0 trigger_rate from p group by 1""")
def backtest_breaker(spark, sf_dir):
    """Circuit breaker's statistics."""
    steps = portfolio.backtest(portfolio.oracle(priced(spark, sf_dir)), RULES, breaker=portfolio.Breaker(0.005))
    return rounded(portfolio.breaker_stats(steps))


@query(f"""with recursive {PRICE}, act as (select *, 1e0 act from st), {WALK} select i - 1 t, round(avg(nav), 4) + 0e0 mean_nav, round(max(dd), 4) + 0e0 max_drawdown, round(avg(held), 4) + 0e0 mean_position,
round(stddev_samp(held), 4) + 0e0 std_position, round(avg((abs(held) > 0.1)::int), 4) + 0e0 in_market from w where i > 0 group by 1""")
def environment_snapshot(spark, sf_dir):
    return rounded(audit.environment_snapshot(portfolio.backtest(portfolio.buy_and_hold(priced(spark, sf_dir)), RULES)), 4)


@query(f"""with {RETURNS}, x as (select asset, ts, ret / 100 ret, (state - 1.5e0) / 1.5e0 p from returns), d as (select *, abs(p - coalesce(lag(p) over (partition by asset order by ts), 0)) c, coalesce(stddev_pop(case when ret < 0 then ret end) over w, 1e-8) dn, avg(ret) over w m from x window w as (partition by asset order by ts rows between 23 preceding and current row)),
t as (select *, avg(c) over (partition by asset order by ts rows between 23 preceding and current row) * 24 tn from d)
select asset, ts, round(ret + 0.5e0 * greatest(least(m / (dn + 1e-8), 1), -1) - 0.1e0 * p * p - (0.1e0 + 0.1e0 * tn) * c, 6) + 0e0 reward from t""")
def lexi_reward(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions.numeric import clip

    d = returns(spark, sf_dir).withColumns({"ret": F.col("ret") / 100, "position": (F.col("state") - 1.5) / 1.5})
    d = f.turnover(d)
    w = Window.partitionBy("asset").orderBy("ts")
    d = d.withColumns({"change": F.col("position") - F.lag("position", 1, 0.0).over(w), "down": f.downside_deviation(d), "m": F.avg("ret").over(w.rowsBetween(-23, 0))})
    s = clip(F.col("m") / (F.col("down") + 1e-8), -1, 1)
    return d.select("asset", "ts", r(portfolio.lexicographic_reward(F.col("ret"), s, F.col("position"), F.col("change"), F.col("turnover"))).alias("reward"))


@query(f"""with {RETURNS}, g as (select asset, row_number() over (partition by asset order by ts) as step, ret > 0 a, abs(ret) > 2 b from returns), h as (select *, sum((not a)::int) over w ga, sum((not b)::int) over w gb from g window w as (partition by asset order by step rows between unbounded preceding and current row)),
k as (select asset, step, a, b, sum(a::int) over (partition by asset, ga order by step)::bigint a_run, sum(b::int) over (partition by asset, gb order by step)::bigint b_run from h)
select asset, step, a, b, a_run, b_run, greatest(a_run, b_run) >= 3 or a::int + b::int >= 2 as stop from k""")
def overfitting_guard(spark, sf_dir):
    d = split.numbered(returns(spark, sf_dir)).select("asset", (F.col("rn") + 1).cast("long").alias("step"), (F.col("ret") > 0).alias("a"), (F.abs("ret") > 2).alias("b"))
    return portfolio.guard(d, ["a", "b"], 3, ("asset",), "step")


@query("""select vec_id, round(greatest(least((p - 0.15e0) / 0.6e0, 1), 0) * 0.4e0, 6) + 0e0 w_cost, round(least(1e0, p / 0.3e0), 6) anneal, round(0.01e0 * (1 - 0.5e0 * p) * greatest(least(0.05e0 / greatest(v, 1e-8), 2), 0.5e0), 8) noise
from (select vec_id, (vec_id % 101) / 100e0 p, abs(embedding[1]::double) v from embeddings)""")
def schedules(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 101 / 100.0).alias("p"), F.abs(F.get("embedding", 0).cast("double")).alias("v"))
    p = F.col("p")
    return e.select("vec_id", r(portfolio.curriculum(p)).alias("w_cost"), r(portfolio.cost_anneal(p, 0.3)).alias("anneal"), r(portfolio.noise_scale(0.01, p, F.col("v")), 8).alias("noise"))


RESULTS = "res as (select label segment, case when label = 9 then 'fallback' else 'model' end strategy, avg(embedding[1]::double) * 40 sharpe, avg(embedding[2]::double) * 800 pnl_pct, abs(avg(embedding[3]::double)) * 300 max_dd_pct, (avg(embedding[4]::double) > 0) ok, avg(embedding[5]::double) > 0 ck, abs(avg(embedding[6]::double)) * 20 ratio from embeddings group by 1)"


def results(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.avg(F.get("embedding", k).cast("double"))
    d = e.groupBy(F.col("label").alias("segment")).agg((at(0) * 40).alias("sharpe"), (at(1) * 800).alias("pnl_pct"), (F.abs(at(2)) * 300).alias("max_dd_pct"), (at(3) > 0).alias("ok"), (at(4) > 0).alias("ck"), (F.abs(at(5)) * 20).alias("ratio"))
    return d.withColumns({"strategy": F.when(F.col("segment") == 9, "fallback").otherwise("model"), "status": metrics.status(F.col("ok"), F.col("ck"), F.col("ratio"))})


STATUS = "case when ok then 'SUCCESS' when ck and ratio >= 0.3 then 'RECOVERED' else 'FAILED' end"


@query(f"""with {RESULTS}, s as (select *, {STATUS} status from res) select count(*) filter (strategy <> 'fallback') segments, round(avg(sharpe) filter (strategy <> 'fallback'), 6) + 0e0 mean_sharpe, round(avg(pnl_pct) filter (strategy <> 'fallback'), 6) + 0e0 mean_pnl_pct,
round(avg(max_dd_pct) filter (strategy <> 'fallback'), 6) mean_max_dd_pct, count(*) filter (status = 'SUCCESS') n_success, count(*) filter (status = 'RECOVERED') n_recovered, count(*) filter (status = 'FAILED') n_failed from s""")
def wfo_summary(spark, sf_dir):
    return rounded(metrics.summary(results(spark, sf_dir)))


@query(f"""with {RESULTS}, s as (select segment, sharpe, pnl_pct, max_dd_pct, pnl_pct - max_dd_pct / 2 alpha from res), k as (select *, (alpha < -10)::int + (sharpe < -1)::int + (pnl_pct < -20)::int bad, (alpha > 0)::int + (sharpe > 1)::int good from s)
select segment, case when bad >= 2 or (bad = 1 and alpha < -5) then 'FAIL' when good >= 2 or alpha > 5 then 'PASS' else 'MIXED' end verdict from k""")
def verdicts(spark, sf_dir):
    d = results(spark, sf_dir)
    none = F.lit(None).cast("double")
    return d.select("segment", metrics.verdict(F.col("pnl_pct") - F.col("max_dd_pct") / 2, F.col("sharpe"), F.col("pnl_pct"), none, none, none).alias("verdict"))


@query(f"""with {PANEL}, p as (select asset, ts, 100 + ln(1 + close) c from panel), d as (select *, c / lag(c) over (partition by asset order by ts) - 1 r, (max(c) over w - c) / max(c) over w dd from p window w as (partition by asset order by ts rows between unbounded preceding and current row))
select asset, round(avg(r) / stddev_pop(r) * sqrt(8760e0), 6) + 0e0 sharpe, round(100 * (arg_max(c, ts) - arg_min(c, ts)) / arg_min(c, ts), 6) + 0e0 pnl_pct, round(100 * max(dd), 6) max_dd_pct from d group by 1""")
def fallback_buy_and_hold(spark, sf_dir):
    return rounded(metrics.fallback(priced(spark, sf_dir), "buy_and_hold", ("asset",)))


# ---------------------------------------------------------------- regimes and stationarity

MODEL = {
    "start": [0.5, 0.5], "trans": [[0.9, 0.1], [0.2, 0.8]], "weights": [[0.6, 0.4], [0.5, 0.5]],
    "means": [[[-1.0], [0.0]], [[0.5], [1.5]]], "vars": [[[1.0], [0.5]], [[0.8], [2.0]]],
}
LSE = "greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b})) + 1e-10)"


def _emission(k: int) -> str:
    part = lambda m: f"(ln({MODEL['weights'][k][m]}e0 + 1e-10) - 0.5e0 * (ln(2 * pi() * {MODEL['vars'][k][m][0]}e0) + (ret - ({MODEL['means'][k][m][0]}e0)) ** 2 / {MODEL['vars'][k][m][0]}e0))"
    return LSE.format(a=part(0), b=part(1))


@query(f"""with recursive {RETURNS}, e as (select asset, ts, row_number() over (partition by asset order by ts) i, {_emission(0)} e0_, {_emission(1)} e1_ from returns),
f as (select asset, i, a - l a, b - l b from (select *, {LSE.format(a="a", b="b")} l from (select asset, i, ln(0.5e0 + 1e-10) + e0_ a, ln(0.5e0 + 1e-10) + e1_ b from e where i = 1))
  union all select asset, i, a - l, b - l from (select *, {LSE.format(a="a", b="b")} l from (select asset, i, {LSE.format(a="p0", b="p1")} + e0_ a, {LSE.format(a="q0", b="q1")} + e1_ b
    from (select e.asset, e.i, e0_, e1_, f.a + ln(0.9e0 + 1e-10) p0, f.b + ln(0.2e0 + 1e-10) p1, f.a + ln(0.1e0 + 1e-10) q0, f.b + ln(0.8e0 + 1e-10) q1 from f join e on e.asset = f.asset and e.i = f.i + 1))))
select e.asset, e.ts, round(exp(f.a), 6) + 0e0 hmm_prob_0, round(exp(f.b), 6) + 0e0 hmm_prob_1 from f join e using (asset, i)""")
def forward_filter(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", "ret")
    return rounded(regime.forward_filter(d, MODEL, ["ret"], states=2).select("asset", "ts", "hmm_prob_0", "hmm_prob_1"))


@query()
def regime_model(spark, sf_dir):
    """Fitted by expectation-maximisation, one model an asset, with the operator's defaults; the tests check invariants and recovery of known states."""
    d = returns(spark, sf_dir).select("asset", "ts", "ret", F.col("volume").alias("vol"))
    m = regime.fit(d, ["ret", "vol"], ("asset",), sort_by="ret")
    return m.select("asset", F.size("start").alias("states"), "start", "trans", "weights", "means", "vars")


#: Least squares of a difference on the level before it and a constant (b0), and on the difference before too (b1), from centred sums; the better by AIC.
ADF = """ad as (select {k}, x - l d, l, l - lag(l) over (partition by {k} order by ts) m from (select *, lag(x) over (partition by {k} order by ts) l from {source} where x is not null)),
aq as (select {k}, count(*)::double n, regr_sxx(l, l) ll, regr_sxx(m, m) mm, regr_sxx(d, d) dd, covar_pop(l, m) * count(*) lm, covar_pop(l, d) * count(*) ld, covar_pop(m, d) * count(*) md from ad where m is not null and d is not null group by all),
ab as (select *, ld / ll b0, (ld * mm - md * lm) / (ll * mm - lm * lm) b1, (md * ll - ld * lm) / (ll * mm - lm * lm) b2 from aq),
ar as (select *, greatest(dd - b0 * ld, 0) r0, greatest(dd - b1 * ld - b2 * md, 0) r1 from ab),
av as (select {k}, n, b0 / sqrt(r0 / (n - 2) / ll) t0, b1 / sqrt(r1 / (n - 3) * mm / (ll * mm - lm * lm)) t1, n * ln(r0 / n) + 4 a0, n * ln(r1 / n) + 6 a1 from ar),
adf as (select {k}, n::bigint n, case when a1 < a0 then t1 else t0 end tau, (a1 < a0)::int lags, case when a1 < a0 then t1 else t0 end < -2.86154e0 - 2.8903e0 / n - 4.234e0 / n ** 2 - 40.04e0 / n ** 3 stationary from av)"""


@query(f"""with {PANEL}, src as (select asset, ts, close x from panel), {ADF.format(k="asset", source="src")} select asset, n, round(tau, 4) + 0e0 tau, lags, stationary from adf""")
def adf_test(spark, sf_dir):
    return rounded(stationarity.adf(panel(spark, sf_dir), "close"), 4)


@query(f"""with recursive {PANEL}, o as (select unnest(range(0, 15)) o), wt as (select o, 0 k, 1e0 w from o union all select o, k + 1, -w * (0.3e0 + 0.05e0 * o - k) / (k + 1) from wt where k < 100 and abs(w * (0.3e0 + 0.05e0 * o - k) / (k + 1)) >= 1e-5),
nw as (select o, count(*) c from wt group by 1), lg as (select asset, ts, row_number() over (partition by asset order by ts) rn, ln(close + 1) y from panel),
fx as (select a.asset, wt.o, a.ts, a.rn, sum(b.y * wt.w) x from wt join lg b on true join lg a on a.asset = b.asset and a.rn = b.rn + wt.k group by 1, 2, 3, 4),
src as (select fx.asset, fx.o, fx.ts, x from fx join nw using (o) where rn >= c), {ADF.format(k="asset, o", source="src")},
g as (select asset, min(o) o from adf where stationary and n >= 100 group by 1)
select a.asset, coalesce(round(0.3e0 + 0.05e0 * g.o, 10), 1e0) d from (select distinct asset from panel) a left join g using (asset)""")
def least_fracdiff_order(spark, sf_dir):
    d = panel(spark, sf_dir).withColumn("close", F.col("close") + 1)
    return stationarity.least_order(d)


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def relational_revenue(spark, sf_dir):
    """Star-schema smoke query: an extension."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
