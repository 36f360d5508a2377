"""Slices, alignment, signal probes, and thin compositions of other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, indicators, portfolio, probes, scale, slices, split, stationarity, sync
from ..sources import synthetic
from .backtests import PRICE, RULES, WALK, priced
from .base import BARS, PANEL, RETURNS, bars, panel, query, r, returns, rounded


@query(f"with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) rn from panel) select asset, ts, close from n where rn between 101 and 200")
def positional_slice(spark, sf_dir):
    return slices.by_position(panel(spark, sf_dir).select("asset", "ts", "close"), 100, 200)


@query(f"with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts desc) rn from panel) select asset, ts, close from n where rn <= 50")
def tail_rows(spark, sf_dir):
    return slices.last_rows(panel(spark, sf_dir).select("asset", "ts", "close"), 50)


@query("select event_id, ts, value from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'")
def time_range(spark, sf_dir):
    from datetime import datetime

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    return slices.between(e, datetime(2024, 1, 5), datetime(2024, 1, 20, 12))


@query(f"with {BARS} select asset, ts, close from bars where asset = 'click' and ts in (select ts from bars where asset = 'view')")
def index_intersection(spark, sf_dir):
    b = bars(spark, sf_dir).select("asset", "ts", "close")
    return slices.shared(b.where("asset = 'click'"), b.where("asset = 'view'"), ("ts",))


@query(f"""with {BARS}, a as (select open x, row_number() over (order by ts) i from bars where asset = 'click'), b as (select close y, row_number() over (order by ts) i from bars where asset = 'view') select i::int i, x, y from a join b using (i)""")
def zip_by_position(spark, sf_dir):
    from pyspark.sql import Window

    b = bars(spark, sf_dir)
    x, y = b.where("asset = 'click'").select("ts", F.col("open").alias("x")), b.where("asset = 'view'").select("ts", F.col("close").alias("y"))
    got = audit.zip_by_position(x, y, "ts")
    return got.select(F.row_number().over(Window.orderBy("ts")).alias("i"), "x", "y")


@query(f"""with {BARS}, n as (select asset, close, row_number() over (partition by asset order by ts) - 1 rn from bars) select asset, rn - 24 t, close from n where rn >= 24 and rn < 74""")
def offset_lookup(spark, sf_dir):
    b = bars(spark, sf_dir)
    steps = b.select("asset").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("asset", F.col("t").cast("long").alias("t"))
    return slices.at_offset(steps, b, 24, ["close"]).select("asset", "t", "close")


@query(f"""with {RETURNS}, s as (select asset, case when ret > 0 then 1e0 else -1e0 end s, lead(close) over (partition by asset order by ts) / nullif(close, 0) - 1 n from returns) select asset, round(corr(s, n), 6) + 0e0 signal_corr from s group by 1""")
def oracle_corr(spark, sf_dir):
    d = returns(spark, sf_dir).withColumn("signal", F.when(F.col("ret") > 0, 1.0).otherwise(-1.0))
    return rounded(synthetic.oracle_correlation(d))


@query(f"""with recursive {PRICE}, act as (select *, coalesce(sign(nxt - price), 0)::double act from st), {WALK}, s as (select asset, held, nav / lag(nav, 1, 10000e0) over (partition by asset order by i) - 1 ret from w where i > 0),
g as (select asset, avg(abs(held)) p, avg(ret) / (stddev_pop(ret) + 1e-8) * sqrt(6048e0) s from s group by 1)
select asset, round(p, 4) + 0e0 mean_abs_position, round(s, 4) + 0e0 sharpe, case when s > 10 and p > 0.5 then 'EXCELLENT' when s > 2 then 'GOOD' when s > 0 then 'WEAK' else 'FAILED' end tier from g""")
def oracle_agent(spark, sf_dir):
    return rounded(synthetic.oracle_verdict(portfolio.backtest(portfolio.oracle(priced(spark, sf_dir)), RULES)), 4)


@query(f"""with {RETURNS}, u as (select 'close' feature, close x from returns union all select 'ret', ret from returns), q as (select feature, quantile_cont(x, 0.5) m, greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-2) s from u group by 1),
z as (select feature, x, greatest(least((x - m) / s, 5), -5) z from u join q using (feature)) select feature, round(100e0 * count(*) filter (abs(x) >= 2) / count(*), 6) raw, round(100e0 * count(*) filter (abs(z) >= 2) / count(*), 6) scaled from z group by 1""")
def clip_heatmap(spark, sf_dir):
    d = returns(spark, sf_dir)
    return rounded(audit.clip_heatmap({"raw": d, "scaled": scale.fit_transform(d, ["close", "ret"])}, ["close", "ret"], -2, 2))


@query("""with e as (select vec_id // 32 bucket, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 place from embeddings) select bucket, place::int place, round(avg(x), 6) + 0e0 as value from e group by 1, 2""")
def pooled_embeddings(spark, sf_dir):
    return rounded(slices.pooled(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 32, "vec_id"))


@query(f"""with {RETURNS} select asset, round(avg((abs(ret) < 0.1e0)::int), 6) trigger_ratio from returns group by 1""")
def dead_zone_ratio(spark, sf_dir):
    z = indicators.dead_zone("ret")
    return rounded(returns(spark, sf_dir).groupBy("asset").agg(F.avg(((z == 0)).cast("double")).alias("trigger_ratio")))


@query(f"""with {RETURNS}, u as (select 'close' a, corr(close, ret) c from returns union all select 'volume', corr(volume, ret) from returns union all select 'open', corr(open, ret) from returns) select a, round(c, 6) + 0e0 corr from u order by abs(c) desc, a limit 2""")
def top_correlations(spark, sf_dir):
    got = audit.correlations(returns(spark, sf_dir), ["ret", "close", "volume", "open"]).where("a = 'ret'")
    return rounded(slices.top(got.select(F.col("b").alias("a"), "corr"), F.abs("corr"), 2, "a"))


@query(f"""with {PANEL}, n as (select asset, close - avg(close) over (partition by asset) e, row_number() over (partition by asset order by ts) rn from panel), s as (select asset, rn, e, sum(e) over (partition by asset order by rn) s from n),
l as (select a.asset, k, sum(a.e * b.e) g from n a cross join (select unnest(range(1, 13)) k) join n b on b.asset = a.asset and b.rn = a.rn - k group by 1, 2), v as (select asset, 2 * sum((1 - k / 13e0) * g) v from l group by 1),
q as (select asset, count(*) n, sum(s * s) q, sum(e * e) v0 from s group by 1) select asset, n, round(q / (n * (v0 + v)), 6) kpss, q / (n * (v0 + v)) < 0.463e0 stationary from q join v using (asset)""")
def kpss_test(spark, sf_dir):
    return rounded(stationarity.kpss(panel(spark, sf_dir), "close"))


@query(f"""with recursive {RETURNS}, n as (select asset, ts, abs(ret) s, row_number() over (partition by asset order by ts) i from returns), x as (select asset, i, s e from n where i = 1 union all select x.asset, n.i, 0.01e0 * n.s + 0.99e0 * x.e from x join n on n.asset = x.asset and n.i = x.i + 1)
select n.asset, n.ts, round(x.e, 6) + 0e0 spread_ema from n join x using (asset, i)""")
def spread_ema(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", F.abs("ret").alias("action"))
    return indicators.smoothed_action(d, alpha=0.01).select("asset", "ts", r("smoothed").alias("spread_ema"))


@query(f"with {BARS} select asset, ts, close from bars where asset = 'click' union all select asset, ts, close from bars where asset = 'view' union all select 'both', ts, null from (select distinct ts from bars)")
def row_union(spark, sf_dir):
    b = bars(spark, sf_dir).select("asset", "ts", "close")
    none = b.select("ts").distinct().select(F.lit("both").alias("asset"), "ts")
    return b.where("asset = 'click'").unionByName(b.where("asset = 'view'")).unionByName(none, allowMissingColumns=True)


@query("""with d as (select l_returnflag || l_linestatus asset, date_trunc('day', l_shipdate) ts, sum(l_extendedprice) v from lineitem group by 1, 2), n as (select asset, v, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from d)
select asset, case when rn < floor(n * 0.8e0) then 'train' else 'eval' end split, count(*) as rows, round(min(v), 2) min_v, round(max(v), 2) max_v from n group by 1, 2""")
def split_lineitem_daily(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.sum("l_extendedprice").alias("v"))
    d = split.numbered(d)
    d = d.withColumn("split", split.two_way(F.col("n"), F.col("rn"), 0.8, 0))
    return d.groupBy("asset", "split").agg(F.count("*").alias("rows"), F.round(F.min("v"), 2).alias("min_v"), F.round(F.max("v"), 2).alias("max_v"))


@query()
def regime_projection(spark, sf_dir):
    """Two principal components, their variance and the states' silhouette."""
    d = returns(spark, sf_dir)
    p, share = probes.projection(d, ["close", "ret", "volume"])
    s = probes.silhouette(d, ["close", "ret"])
    return p.groupBy("state").agg(F.count("*").alias("n")).withColumns({"explained": F.lit(round(sum(share), 6)), "silhouette": F.lit(round(s, 6))})


@query(f"""with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel),
b as (select asset, floor(rn / greatest(ceil(n / 200e0), 1))::int bucket, avg(close) v from n group by 1, 2),
m as (select asset, v, row_number() over (partition by asset order by bucket) - 1 rn, count(*) over (partition by asset) n from b),
c as (select asset, floor(rn / floor(n / 50e0))::int bin, avg(v) m, coalesce(stddev_pop(v), 0) s, any_value(n) n from m where n >= 50 and floor(rn / floor(n / 50e0)) < 50 group by 1, 2),
t as (select asset, max(case when bin = 0 then m end) "start", max(case when bin = 49 then m end) "end", max(m) peak, coalesce(regr_slope(case when bin >= 40 then m end, bin), 0) slope, coalesce(avg(case when bin >= 40 then s end), 0) noise from c group by 1),
u as (select k.asset, k.n, t.* exclude (asset), abs(slope) / (noise + 1e-9) snr from (select asset, count(*) n from b group by 1) k left join t using (asset))
select asset, n, round("start", 6) + 0e0 "start", round("end", 6) + 0e0 "end", round(peak, 6) + 0e0 peak, round(slope, 6) + 0e0 slope, round(noise, 6) + 0e0 noise, round(snr, 6) + 0e0 snr,
case when n < 50 then 'INSUFFICIENT_DATA' when "end" is null or "end" > 1e4 then 'EXPLODING' when snr < 2 then 'STABLE (Noisy)' when slope > 0 and "end" < 1.5e0 * coalesce("start", 0) then 'RISING (Controlled)' when slope > 0 then 'DIVERGING' else 'CONVERGING' end status from u""")
def convergence(spark, sf_dir):
    """Trend statistics of a logged series, resampled first."""
    d = panel(spark, sf_dir).select("asset", "ts", "close")
    return rounded(audit.trend_stats(audit.resample(d, "close", "ts", 200, ("asset",)), "value", "bucket", ("asset",)))




@query(f"with {PANEL} select asset, ts, round(greatest(close - 50, 0), 6) + 0e0 volume from panel")
def volume_cleansed(spark, sf_dir):
    p = panel(spark, sf_dir).select("asset", "ts", (F.col("close") - 50).alias("volume"))
    return rounded(sync.sanitize_volume(p))


@query(f"with {PANEL}, n as (select asset, ts, case when volume > 1 then close / (volume - 1) end x from panel) select asset, ts, round(x, 6) + 0e0 x from n where x is not null")
def finite_rows_only(spark, sf_dir):
    p = panel(spark, sf_dir)
    x = F.when(F.col("volume") > 1, F.col("close") / (F.col("volume") - 1)).otherwise(F.lit(float("inf")))
    return rounded(slices.finite_rows(p.select("asset", "ts", x.alias("x")), ["x"]))


@query(f"with {PANEL} select asset, ts, round(close::float::double, 6) + 0e0 x from panel")
def float_close(spark, sf_dir):
    p = slices.as_float(panel(spark, sf_dir).select("asset", "ts", "close"), ["close"])
    return p.select("asset", "ts", r(F.col("close").cast("double")).alias("x"))
