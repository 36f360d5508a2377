"""Features, targets and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import blocked, unblocked
from ..operators import features as f
from ..operators import indicators
from .base import LN, PANEL, RETURNS, panel, query, r, returns, rounded

W = "(partition by asset order by ts rows between {n} preceding and current row)"


def w(n: int) -> str:
    return W.format(n=n - 1)


@query(f"""with {PANEL} select asset, ts, round(case when count(close) over w = 24 then (close - avg(close) over w) / (stddev_samp(close) over w + 1e-8) end, 6) + 0e0 z
from panel window w as {w(24)}""")
def zscore_24(spark, sf_dir):
    p = blocked(panel(spark, sf_dir), 23)
    return unblocked(p.withColumn("z", r(f.zscore(p, "close", 24)))).select("asset", "ts", "z")


@query(f"""with {PANEL}, l as (select *, lag(close) over (partition by asset order by ts) p from panel)
select asset, ts, round(least(greatest({LN.format(p="p", c="close")}, -0.2e0), 0.2e0) + case when p is null then null else 0e0 end, 6) + 0e0 log_ret from l""")
def log_returns(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.log_return(p)).alias("log_ret"))


@query(f"""with {PANEL}, v as (select asset, ts, case when volume = 0 then 1 else volume end v from panel)
select asset, ts, round(coalesce(ln(v / lag(v) over (partition by asset order by ts)), 0), 6) + 0e0 vol_logret from v""")
def vol_logret(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.volume_log_return(p)).alias("vol_logret"))


@query(f"""with {PANEL} select asset, ts, round(coalesce((volume - avg(volume) over w) / (stddev_samp(volume) over w + 1e-8), 0), 6) + 0e0 vol_zscore from panel window w as {w(48)}""")
def vol_zscore(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.volume_zscore(p, 48)).alias("vol_zscore"))


@query(f"""with {PANEL}, x as (select asset, ts, case when high > 0 and low > 0 then sqrt(ln(high / low) ** 2 / (4 * ln(2e0))) end x from panel)
select asset, ts, round(case when count(x) over w = 24 then avg(x) over w end, 6) + 0e0 parkinson from x window w as {w(24)}""")
def parkinson_24(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.parkinson(p)).alias("parkinson"))


@query(f"""with {PANEL}, x as (select asset, ts, case when low > 0 and open > 0 and close > 0 then 0.5e0 * ln(high / low) ** 2 - (2 * ln(2e0) - 1) * ln(close / open) ** 2 end x from panel),
y as (select asset, ts, case when x >= 0 then sqrt(x) end y from x)
select asset, ts, round(case when count(y) over w = 24 then avg(y) over w end, 6) + 0e0 gk from y window w as {w(24)}""")
def garman_klass_24(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.garman_klass(p)).alias("gk"))


FFD = ", ".join(f"({k}, {x!r}::double)" for k, x in enumerate(f.ffd_weights(0.4)))


@query(f"""with {PANEL}, x as (select asset, ts, row_number() over (partition by asset order by ts) rn, case when close > 0 then ln(close) end x from panel), wt(k, w) as (values {FFD})
select a.asset, a.ts, round(case when count(b.x) = (select count(*) from wt) then sum(b.x * wt.w) end, 6) + 0e0 fracdiff from x a cross join wt left join x b on b.asset = a.asset and b.rn = a.rn - wt.k group by 1, 2""")
def fracdiff_d040(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.fracdiff(p, f.ffd_weights(0.4))).alias("fracdiff"))


@query(f"""with {PANEL} select asset, ts, round(case when count(volume) over w = 24 then ln(1 + volume) / nullif(ln(1 + avg(volume) over w), 0) end, 6) + 0e0 volume_rel from panel window w as {w(24)}""")
def relative_volume(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.relative_volume(p)).alias("volume_rel"))


@query(f"""with {PANEL}, m as (select asset, ts, close, case when count(close) over w = 20 then avg(close) over w end m, case when count(close) over w = 20 then stddev_pop(close) over w end s from panel window w as {w(20)})
select asset, ts, round((close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0), 6) + 0e0 pct_b, round(100 * ((m + 2 * s) - (m - 2 * s)) / nullif(m, 0), 6) + 0e0 bandwidth from m""")
def bollinger(spark, sf_dir):
    p = panel(spark, sf_dir)
    b, width = f.bollinger(p)
    return p.select("asset", "ts", r(b).alias("pct_b"), r(width).alias("bandwidth"))


@query(f"""with {PANEL} select asset, ts, coalesce((lead(close) over w > close)::int::double, 0e0) target from panel window w as (partition by asset order by ts)""")
def targets(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", f.direction_target(p).alias("target"))


@query(f"""with {PANEL} select asset, ts, round(coalesce((lead(close, 1) over w - close) / nullif(close, 0), 0), 4) + 0e0 fwd_1, round(coalesce((lead(close, 24) over w - close) / nullif(close, 0), 0), 4) + 0e0 fwd_24
from panel window w as (partition by asset order by ts)""")
def fwd_returns(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", *[r(f.forward_return(p, h), 4).alias(f"fwd_{h}") for h in (1, 24)])


@query(f"""with {PANEL} select asset, ts, round(coalesce((close - lag(close) over w) / greatest(lag(close) over w, 1e-8), 0), 4) + 0e0 bench from panel window w as (partition by asset order by ts)""")
def benchmark_return(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.benchmark_return(p), 4).alias("bench"))


@query(f"""with {RETURNS}, pk as (select *, case when count(x) over w = 24 then avg(x) over w end parkinson from (select *, case when low > 0 then sqrt(ln(high / low) ** 2 / (4 * ln(2e0))) end x from returns) window w as {w(24)}),
sp as (select ts, max(case when asset = 'click' then ret end) - max(case when asset = 'view' then ret end) sp from pk group by 1),
j as (select pk.*, sp from pk join sp using (ts)),
k as (select *, case when count(ret) over w = 24 then (ret - avg(ret) over w) / (stddev_samp(ret) over w + 1e-8) end a, case when count(parkinson) over w = 24 then avg(parkinson) over w end b,
  case when count(sp) over w = 24 then avg(sp) over w end c, case when count(parkinson) over v = 48 then avg(parkinson) over v end d from j window w as {w(24)}, v as {w(48)})
select asset, ts, round(case when a is not null then greatest(least(a, 5), -5) end, 6) + 0e0 hmm_trend, round(case when b is not null then greatest(least(ln(b + 1e-6), 0), -12) end, 6) + 0e0 hmm_vol,
  round(case when c is not null then greatest(least(c, 0.05e0), -0.05e0) end, 6) + 0e0 hmm_risk_on_off, round(case when b is not null and d is not null then greatest(least(b / (d + 1e-10), 10), 0.1e0) end, 6) + 0e0 hmm_vol_ratio from k""")
def hmm_inputs(spark, sf_dir):
    p = returns(spark, sf_dir)
    p = p.withColumnRenamed("ret", "log_ret").withColumn("parkinson", f.parkinson(p))
    got = f.regime_inputs(p, "click", "view", 24, 48)
    return rounded(got.select("asset", "ts", "hmm_trend", "hmm_vol", "hmm_risk_on_off", "hmm_vol_ratio"))


@query(f"""with {PANEL}, s as (select avg(volume) m, stddev_samp(volume) s from panel)
select asset, ts, round(least(greatest(volume, m - 1.5e0 * s), m + 1.5e0 * s), 6) + 0e0 volume from panel, s""")
def winsorized(spark, sf_dir):
    return rounded(f.winsorize(panel(spark, sf_dir), ["volume"], 1.5).select("asset", "ts", "volume"))


@query(f"""with {PANEL} select asset, ts, round(sum(close) over w, 2) + 0e0 sum_close, count(*) over w n from panel window w as {w(8)} qualify count(*) over w = 8""")
def observation_windows(spark, sf_dir):
    p = panel(spark, sf_dir)
    got = f.observations(p, ["close", "volume"], 8)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + F.get(x, 0).cast("double"))
    return got.select("asset", "ts", r(total, 2).alias("sum_close"), F.size("window").cast("long").alias("n"))


@query(f"""with {RETURNS} select asset, ts, round(case when count(ret) over w >= 2 then stddev_pop(ret) over w end, 6) + 0e0 nav_vol, round(coalesce(stddev_pop(case when ret < 0 then ret end) over w, 1e-8), 6) + 0e0 downside
from returns window w as {w(24)}""")
def rolling_risk(spark, sf_dir):
    p = returns(spark, sf_dir)
    return p.select("asset", "ts", r(f.nav_volatility(p, "ret")).alias("nav_vol"), r(f.downside_deviation(p)).alias("downside"))


@query(f"""with {RETURNS}, p as (select asset, ts, (state - 1.5e0) / 1.5e0 position from returns), d as (select asset, ts, abs(position - coalesce(lag(position) over (partition by asset order by ts), 0)) d from p)
select asset, ts, round(avg(d) over w * 24, 6) + 0e0 turnover from d window w as {w(24)}""")
def turnover(spark, sf_dir):
    p = returns(spark, sf_dir).withColumn("position", (F.col("state") - 1.5) / 1.5)
    return f.turnover(p).select("asset", "ts", r("turnover").alias("turnover"))


@query(f"""with {PANEL} select asset, ts, round(case when row_number() over (partition by asset order by ts) > 100 then abs(close - avg(close) over w) / (stddev_pop(close) over w + 1e-6) else 0e0 end, 6) + 0e0 ood
from panel window w as {w(100)}""")
def ood_score(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("asset", "ts", r(f.out_of_distribution(p, "close")).alias("ood"))


@query(f"""with {PANEL}, c as (select asset, close / nullif(lag(close) over (partition by asset order by ts), 0) - 1 c from panel) select asset, round(stddev_samp(c), 4) + 0e0 baseline_vol from c group by 1""")
def baseline_vol(spark, sf_dir):
    return rounded(f.baseline_volatility(panel(spark, sf_dir)), 4)


# ---------------------------------------------------------------- recursions: SQL walks the rows one by one

N = "n as (select *, row_number() over (partition by asset order by ts) i from panel)"


@query(f"""with recursive {PANEL}, {N}, d as (select asset, i, ts, close - lag(close) over (partition by asset order by ts) d from n),
s as (select asset, avg(greatest(d, 0)) g, avg(greatest(-d, 0)) l from d where i between 2 and 15 group by 1),
x as (select asset, 15::bigint i, g, l from s union all
  select x.asset, d.i, x.g + (greatest(d.d, 0) - x.g) / 14, x.l + (greatest(-d.d, 0) - x.l) / 14 from x join d on d.asset = x.asset and d.i = x.i + 1)
select d.asset, d.ts, round(case when x.l = 0 then 100e0 else 100 - 100 / (1 + x.g / x.l) end, 6) + 0e0 rsi from d left join x using (asset, i)""")
def rsi_14(spark, sf_dir):
    return indicators.rsi(panel(spark, sf_dir).select("asset", "ts", "close")).select("asset", "ts", r("rsi").alias("rsi"))


@query(f"""with recursive {PANEL}, {N}, s as (select asset, avg(close) filter (i <= 12) a, avg(close) filter (i <= 26) b from n group by 1),
f as (select asset, 12::bigint i, a e from s union all select f.asset, n.i, f.e + (2e0 / 13) * (n.close - f.e) from f join n on n.asset = f.asset and n.i = f.i + 1),
g as (select asset, 26::bigint i, b e from s union all select g.asset, n.i, g.e + (2e0 / 27) * (n.close - g.e) from g join n on n.asset = g.asset and n.i = g.i + 1),
m as (select asset, i, f.e - g.e m from f join g using (asset, i)),
t as (select asset, avg(m) s from m where i <= 34 group by 1),
h as (select asset, 34::bigint i, s e from t union all select h.asset, m.i, h.e + (2e0 / 10) * (m.m - h.e) from h join m on m.asset = h.asset and m.i = h.i + 1)
select n.asset, n.ts, round(m.m, 6) + 0e0 macd, round(m.m - h.e, 6) + 0e0 macd_hist from n left join m using (asset, i) left join h using (asset, i)""")
def macd_hist(spark, sf_dir):
    return rounded(indicators.macd(panel(spark, sf_dir).select("asset", "ts", "close")).select("asset", "ts", "macd", "macd_hist"))


@query(f"""with recursive {PANEL}, {N}, l as (select *, lag(high) over w ph, lag(low) over w pl, lag(close) over w pc from n window w as (partition by asset order by ts)),
d as (select asset, i, ts, greatest(high - low, abs(high - pc), abs(low - pc)) tr, case when high - ph > pl - low and high - ph > 0 then high - ph else 0e0 end p, case when pl - low > high - ph and pl - low > 0 then pl - low else 0e0 end m from l where i > 1),
s as (select asset, avg(tr) tr, avg(p) p, avg(m) m from d where i <= 15 group by 1),
x as (select asset, 15::bigint i, tr, p, m from s union all
  select x.asset, d.i, x.tr + (d.tr - x.tr) * (1e0 / 14), x.p + (d.p - x.p) * (1e0 / 14), x.m + (d.m - x.m) * (1e0 / 14) from x join d on d.asset = x.asset and d.i = x.i + 1),
q as (select asset, i, 100 * p / tr a, 100 * m / tr b from x), dx as (select asset, i, case when a + b = 0 then 0e0 else 100 * abs(a - b) / (a + b) end dx from q),
t as (select asset, avg(dx) s from dx where i <= 28 group by 1),
y as (select asset, 28::bigint i, s e from t union all select y.asset, dx.i, y.e + (dx.dx - y.e) * (1e0 / 14) from y join dx on dx.asset = y.asset and dx.i = y.i + 1)
select n.asset, n.ts, round(y.e, 6) + 0e0 adx from n left join y using (asset, i)""")
def adx_14(spark, sf_dir):
    return indicators.adx(panel(spark, sf_dir).select("asset", "ts", "high", "low", "close")).select("asset", "ts", r("adx").alias("adx"))


@query(f"""with recursive {RETURNS}, n as (select *, row_number() over (partition by asset order by ts) i from returns),
x as (select asset, 0::bigint i, 0.05e0 * 0.05e0 v from (select distinct asset from n) union all
  select x.asset, n.i, (2e0 / 25) * n.ret * n.ret + (1 - 2e0 / 25) * x.v from x join n on n.asset = x.asset and n.i = x.i + 1)
select n.asset, n.ts, round(greatest(sqrt(x.v), 1e-6), 6) + 0e0 ema_vol from n join x using (asset, i)""")
def ema_vol(spark, sf_dir):
    return indicators.ema_volatility(returns(spark, sf_dir).select("asset", "ts", "ret"), "ret").select("asset", "ts", r("ema_vol").alias("ema_vol"))


@query(f"""with recursive {RETURNS}, n as (select asset, ts, (state - 1.5e0) / 1.5e0 a, row_number() over (partition by asset order by ts) i from returns),
x as (select asset, i, a e from n where i = 1 union all select x.asset, n.i, 0.3e0 * n.a + 0.7e0 * x.e from x join n on n.asset = x.asset and n.i = x.i + 1)
select n.asset, n.ts, round(x.e, 6) + 0e0 smoothed from n join x using (asset, i)""")
def action_ema(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", ((F.col("state") - 1.5) / 1.5).alias("action"))
    return indicators.smoothed_action(d).select("asset", "ts", r("smoothed").alias("smoothed"))


@query(f"""with {RETURNS} select asset, ts, round(case when abs(ret) < 0.1e0 then 0e0 else ret end, 6) + 0e0 action from returns""")
def dead_zone(spark, sf_dir):
    return returns(spark, sf_dir).select("asset", "ts", r(indicators.dead_zone("ret")).alias("action"))


FFD_ALL = ", ".join(f"({k}, {x!r}::double)" for k, x in enumerate(f.ffd_weights(0.4)))


@query(f"""with {PANEL}, b as (select *, lag(close) over w p, case when volume = 0 then 1 else volume end v, case when high > 0 and low > 0 then sqrt(ln(high / low) ** 2 / (4 * ln(2e0))) end pk,
  case when low > 0 and open > 0 and close > 0 then 0.5e0 * ln(high / low) ** 2 - (2 * ln(2e0) - 1) * ln(close / open) ** 2 end g, case when close > 0 then ln(close) end x, row_number() over w rn from panel window w as (partition by asset order by ts)),
c as (select *, case when g >= 0 then sqrt(g) end gy from b), wt(k, w) as (values {FFD_ALL}),
fd as (select a.asset, a.rn, case when count(b.x) = {len(f.ffd_weights(0.4))} then sum(b.x * wt.w) end fd from c a cross join wt join c b on b.asset = a.asset and b.rn = a.rn - wt.k group by 1, 2)
select asset, ts, round(open, 6) + 0e0 as open, round(high, 6) + 0e0 high, round(low, 6) + 0e0 low, round(close, 6) + 0e0 as close, round(volume, 6) + 0e0 volume,
round(least(greatest({LN.format(p="p", c="close")}, -0.2e0), 0.2e0) + case when p is null then null else 0e0 end, 6) + 0e0 log_ret, round(coalesce(ln(v / lag(v) over (partition by asset order by ts)), 0), 6) + 0e0 vol_logret,
round(coalesce((volume - avg(volume) over w48) / (stddev_samp(volume) over w48 + 1e-8), 0), 6) + 0e0 vol_zscore, round(case when count(pk) over w24 = 24 then avg(pk) over w24 end, 6) + 0e0 parkinson, round(case when count(gy) over w24 = 24 then avg(gy) over w24 end, 6) + 0e0 gk,
round(case when count(close) over w48 = 48 then (close - avg(close) over w48) / (stddev_samp(close) over w48 + 1e-8) end, 6) + 0e0 zscore, round(fd, 6) + 0e0 fracdiff from c left join fd using (asset, rn) window w24 as {w(24)}, w48 as {w(48)}""")
def feature_panel(spark, sf_dir):
    """All windowed features over one shuffle of blocks, all 101 weights of the fractional difference."""
    return rounded(f.feature_panel(panel(spark, sf_dir), 0.4, 48, 48))




