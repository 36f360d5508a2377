"""Streams with state, smoothed beliefs, rewards and reports that other queries don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, indicators, portfolio, probes, regime, split, stationarity
from ..operators import features as f
from ..runtime import settled, workspace
from ..streaming import steps
from .backtests import MODEL, PRICE, RULES, WALK, _emission, priced
from .base import PANEL, RETURNS, panel, query, r, returns, rounded

ORACLE_ACT = "act as (select *, coalesce(sign(nxt - price), 0)::double act from st)"


@query(f"""with recursive {PRICE}, {ORACLE_ACT}, {WALK}, x as (select w.asset, act.ts, w.i - 1 t, ln(nav / 10000) log_nav, held, trades, dd, nav, lag(nav) over (partition by w.asset order by w.i) before,
  abs(held - lag(held) over (partition by w.asset order by w.i)) change from w left join act on act.asset = w.asset and act.i = w.i),
y as (select *, nav / before - 1 ret, case when t > 0 then ln(nav / before) end lr from x where t >= 0)
select asset, ts::varchar ts, t, round(log_nav, 8) + 0e0 log_nav, round(held, 4) + 0e0 as position, trades, round(dd, 8) + 0e0 drawdown,
  round(case when count(lr) over v >= 2 then stddev_pop(lr) over v end, 8) + 0e0 nav_vol, round(24 * avg(change) over v, 6) + 0e0 turnover, round(coalesce(stddev_pop(case when ret < 0 then ret end) over v, 1e-8), 8) + 0e0 downside
from y window v as (partition by asset order by t rows between 23 preceding and current row)""")
def live_steps(spark, sf_dir):
    """The simulation as a stream over three files of rows in the order of time, one a micro-batch; its state goes from batch to batch."""
    d = portfolio.oracle(priced(spark, sf_dir)).select("asset", F.col("ts").cast("timestamp").alias("ts"), "close", "action")
    first, last = d.agg(F.min("ts"), F.max("ts")).first()
    root = workspace(spark)
    for k in range(3):  # one after the other, so that the files' times are in the order of their rows
        low, high = (F.lit(first) + (F.lit(last) - F.lit(first)) * (j / 3) for j in (k, k + 1))
        part = d.where((F.col("ts") >= low) & ((F.col("ts") < high) if k < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{root}/rows")
    steps.replayed(spark, f"{root}/rows", f"{root}/steps", f"{root}/state", d.schema, 1, rules=RULES)
    got = spark.read.parquet(f"{root}/steps")
    return got.select(
        "asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "t", r(F.ln(F.col("nav") / 10_000), 8).alias("log_nav"), r("position", 4).alias("position"), F.col("trades").cast("long").alias("trades"),
        r("drawdown", 8).alias("drawdown"), r("nav_vol", 8).alias("nav_vol"), r("turnover").alias("turnover"), r("downside", 8).alias("downside"),
    )


@query(f"""with recursive {RETURNS}, e as (select asset, ts, row_number() over (partition by asset order by ts) i, count(*) over (partition by asset) n, exp({_emission(0)}) e0, exp({_emission(1)}) e1 from returns),
f as (select asset, i, a / (a + b) a, b / (a + b) b from (select asset, i, 0.5e0 * e0 a, 0.5e0 * e1 b from e where i = 1)
  union all select asset, i, a / (a + b), b / (a + b) from (select e.asset, e.i, (f.a * 0.9e0 + f.b * 0.2e0) * e0 a, (f.a * 0.1e0 + f.b * 0.8e0) * e1 b from f join e on e.asset = f.asset and e.i = f.i + 1)),
g as (select asset, i, 1e0 a, 1e0 b from e where i = n
  union all select asset, i - 1, a / (a + b), b / (a + b) from (select g.asset, g.i, 0.9e0 * e0 * g.a + 0.1e0 * e1 * g.b a, 0.2e0 * e0 * g.a + 0.8e0 * e1 * g.b b from g join e on e.asset = g.asset and e.i = g.i where g.i > 1))
select e.asset, e.ts, round(f.a * g.a / (f.a * g.a + f.b * g.b), 6) + 0e0 prob_0, round(f.b * g.b / (f.a * g.a + f.b * g.b), 6) + 0e0 prob_1 from e join f using (asset, i) join g using (asset, i)""")
def smoothed_beliefs(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", "ret")
    return rounded(regime.smoothed_beliefs(d, MODEL, ["ret"], states=2).select("asset", "ts", "prob_0", "prob_1"))


DSR = """d as (select asset, 0::bigint i, 0e0 a, 1e-6::double b, 0e0 d from (select distinct asset from x) union all
  select d.asset, x.i, d.a + 0.02e0 * (x.al - d.a), d.b + 0.02e0 * (x.al * x.al - d.b),
    case when x.i <= 200 then 10 * ln(1 + greatest(x.al, {floor}e0)) else greatest(least(10 * (d.b * (x.al - d.a) - 0.5e0 * d.a * (x.al * x.al - d.b)) / greatest(d.b - d.a * d.a, 1e-8) ** 1.5e0, 5), -5) end
  from d join x on x.asset = d.asset and x.i = d.i + 1)"""


@query(f"""with recursive {RETURNS}, x as (select asset, ts, ret / 100 al, row_number() over (partition by asset order by ts) i from returns), {DSR.format(floor="-0.99")}
select x.asset, x.ts, round(d.d, 6) + 0e0 reward from d join x using (asset, i)""")
def dsr_plain_returns(spark, sf_dir):
    """The reward on returns themselves, without a benchmark."""
    d = returns(spark, sf_dir).select("asset", "ts", (F.col("ret") / 100).alias("ret"))
    return portfolio.sharpe_rewards(d, "ret", floor=-0.99).select("asset", "ts", r("reward").alias("reward"))


@query(f"""with recursive {PRICE}, {ORACLE_ACT}, {WALK}, s as (select w.asset, w.i, w.nav / lag(w.nav) over o - 1 ret, held, abs(held - lag(held) over o) delta, price, nxt from w left join act on act.asset = w.asset and act.i = w.i window o as (partition by w.asset order by w.i)),
x as (select *, ret - (nxt / price - 1) al from s where i > 0), {DSR.format(floor="-0.9")}
select x.asset, x.i - 1 t, round(d.d, 6) + 0e0 gain, case when abs(held) < 0.05e0 then -0.01e0 else 0e0 end idle, round(greatest(-10 * delta, -0.1e0), 6) + 0e0 churn,
  round(d.d + case when abs(held) < 0.05e0 then -0.01e0 else 0e0 end + 0.5e0 * greatest(-10 * delta, -0.1e0) * 0.05e0, 6) + 0e0 reward from x join d using (asset, i)""")
def reward_parts(spark, sf_dir):
    """Gain over the market, cost of idling and of churn, and the reward that the simulation makes of them."""
    rules = portfolio.Rules(funding=0.0001, w_cost=0.5)
    s = portfolio.backtest(portfolio.oracle(priced(spark, sf_dir)), rules)
    d = portfolio.reward_parts(s, rules)
    return rounded(d.select("asset", "t", "gain", "idle", "churn", "reward"))


#: Two lanes of three episodes of 90 steps an asset; the walk takes an episode for an asset of its own.
LANES = f"""{PRICE}, ep as (select lane, episode, lane * 50 + episode * 130 "start" from (select unnest([0, 1]) lane) a, (select unnest([0, 1, 2]) episode) b),
act as (select asset || '/' || lane || '/' || episode asset, asset name, lane, episode, st.i - ep."start" i, price, case when st.i - ep."start" <= 90 then nxt end nxt, coalesce(sign(nxt - price), 0)::double act from st join ep on st.i - 1 between ep."start" and ep."start" + 90)"""


@query(f"""with recursive {LANES}, {WALK}, k as (select name asset, lane, episode, w.i - 1 t, nav, w.held, w.trades from w join act on act.asset = w.asset and act.i = w.i where w.i > 0),
z as (select asset, lane, episode, coalesce(sum(n) over (partition by asset, lane order by episode rows between unbounded preceding and 1 preceding), 0) b from (select asset, lane, episode, count(*) n from k group by 1, 2, 3))
select k.asset, k.lane, k.episode, (b + t)::bigint as step, t, round(ln(nav / 10000), 8) + 0e0 log_nav, round(held, 4) + 0e0 as position, trades from k join z on z.asset = k.asset and z.lane = k.lane and z.episode = k.episode where b + t < 200""")
def restarting_lanes(spark, sf_dir):
    """Lanes that take their next episode in place, 200 steps each."""
    d = portfolio.oracle(priced(spark, sf_dir))
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("lane"), F.lit(e).alias("episode")) for a in range(2) for e in range(3)]))
    starts = d.select("asset").distinct().select("asset", pair.alias("p")).select("asset", "p.lane", "p.episode", (F.col("p.lane") * 50 + F.col("p.episode") * 130).cast("long").alias("start"))
    got = portfolio.lanes(d, starts, 90, 200, RULES)
    return got.select("asset", "lane", "episode", "step", "t", r(F.ln(F.col("nav") / 10_000), 8).alias("log_nav"), r("position", 4).alias("position"), F.col("trades").cast("long").alias("trades"))


@query(f"""with {RETURNS}, n as (select asset, state, lead(state) over (partition by asset order by ts) nx from returns), c as (select asset, state, nx, count(*)::double k from n where nx is not null group by 1, 2, 3),
p as (select *, k / sum(k) over (partition by asset, state) p from c), s as (select asset, state, coalesce(sum(case when state = nx then p end), 0) stay, sum(-p * ln(p)) e from p group by 1, 2), g as (select asset, avg(stay) m, avg(e) e from s group by 1)
select asset, round(m, 6) + 0e0 mean_stay, round(e, 6) + 0e0 mean_row_entropy, case when m > 0.8e0 then 'STICKY' when m < 0.5e0 then 'VOLATILE' else 'MODERATE' end kind from g""")
def transition_report(spark, sf_dir):
    return rounded(regime.transition_report(returns(spark, sf_dir)))


@query(f"with {PANEL}, n as (select asset, row_number() over (partition by asset order by ts) - 1 rn from panel) select asset, count(*) as rows, 0::bigint changed from n where rn < 400 group by 1")
def temporal_isolation(spark, sf_dir):
    """Indicators and rolling features of the first 400 rows, with and without the later ones."""

    def made(d):
        d = indicators.momentum(d)
        return d.withColumns({"vol": f.parkinson(d), "z": f.zscore(d, "close", 48)})

    return stationarity.isolation(settled(panel(spark, sf_dir).select("asset", "ts", "open", "high", "low", "close")), made, 400, ["rsi", "macd_hist", "adx", "vol", "z"])


STATS = """select '{c}' feature, avg({c}) m, stddev_samp({c}) s, quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.5) q2, quantile_cont({c}, 0.75) q3, count(*) n from returns"""


@query(f"""with {RETURNS}, st as ({STATS.format(c="close")} union all {STATS.format(c="ret")} union all {STATS.format(c="volume")}),
u as (select 'close' feature, close x from returns union all select 'ret', ret from returns union all select 'volume', volume from returns),
z as (select feature, x, greatest(least((x - q2) / greatest(q3 - q1, 1e-2), 5), -5) z, q1 - 3 * (q3 - q1) lo, q3 + 3 * (q3 - q1) hi from u join st using (feature)),
g as (select feature, avg(z) m, stddev_samp(z) s, 100e0 * count(*) filter (z <= -5 or z >= 5) / count(*) clipped, 100e0 * count(*) filter (x < lo or x > hi) / count(*) o from z group by 1)
select feature, round(st.m, 6) + 0e0 mean, round(st.s, 6) + 0e0 std, round(g.m, 6) + 0e0 mean_b, round(g.s, 6) + 0e0 std_b, round(abs(g.m - st.m), 6) + 0e0 mean_shift, round(g.s / st.s, 6) + 0e0 std_ratio, round(clipped, 6) + 0e0 clipped_pct, round(o, 6) + 0e0 out_pct from st join g using (feature)""")
def normalization_report(spark, sf_dir):
    """Raw against robustly scaled columns: moments, what the bounds clip, outliers."""
    from ..operators import scale

    d, columns = settled(returns(spark, sf_dir).select("close", "ret", "volume")), ["close", "ret", "volume"]
    return rounded(audit.normalization_report(d, scale.fit_transform(d, columns), columns))


PROBE = f"""{RETURNS}, m as (select *, (lead(ret) over (partition by asset order by ts) > 0)::int y, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from returns),
pr as (select *, case when rn < floor(n * 0.8e0) then 'train' else 'test' end split from m where y is not null)"""


def _probe(spark, sf_dir):
    d = split.numbered(returns(spark, sf_dir))
    nxt = F.lead("ret").over(_by_time())
    d = d.withColumns({"y": (nxt > 0).cast("int"), "split": F.when(F.col("rn") < F.floor(F.col("n") * 0.8), "train").otherwise("test")})
    return d.where("y is not null")


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("asset").orderBy("ts")


@query(f"with {PROBE}, c as (select split, count(*) n, sum(y) ones from pr group by 1) select split, n, ones::bigint ones, round(100e0 * greatest(ones, n - ones) / n, 6) majority_pct from c")
def probe_baseline(spark, sf_dir):
    """What a probe of the next return's sign has to beat."""
    d = _probe(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    return rounded(d.withColumn("majority_pct", 100 * F.greatest(F.col("ones"), F.col("n") - F.col("ones")) / F.col("n")))


@query()
def signal_probe(spark, sf_dir):
    """A forest on the return, volume and range of each bar for the sign of the next return, later rows to test it; the tests hold it against
    a series that carries a signal."""
    d = _probe(spark, sf_dir).withColumn("range", F.col("high") - F.col("low"))
    return probes.signal(d.where("split = 'train'"), d.where("split = 'test'"), ["ret", "volume", "range"], "y")
