"""Features with their full windows, on daily series of lineitem that are long enough for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..operators import features as f
from .base import query, r

DAILY = """daily as (select l_returnflag || l_linestatus asset, date_trunc('day', l_shipdate)::timestamp ts, sum(l_extendedprice)::double as close, max(l_extendedprice)::double high,
  min(l_extendedprice)::double low, sum(l_quantity)::double volume from lineitem group by 1, 2)"""
BACK = "(partition by asset order by ts rows between {n} preceding and current row)"
FFD = ", ".join(f"({k}, {x!r}::double)" for k, x in enumerate(f.ffd_weights(0.4)))


def daily(spark, sf_dir):
    """One row a flag, status and day that has items shipped."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice").cast("double")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        F.sum(price).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum(F.col("l_quantity").cast("double")).alias("volume"))


@query(f"""with {DAILY} select asset, ts::varchar ts, round(case when count(close) over w = 720 then (close - avg(close) over w) / (stddev_samp(close) over w + 1e-8) end, 4) + 0e0 z from daily window w as {BACK.format(n=719)}""")
def zscore_720_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(f.zscore(d, "close", 720), 4).alias("z"))


@query(f"""with {DAILY} select asset, ts::varchar ts, round(coalesce((volume - avg(volume) over w) / (stddev_samp(volume) over w + 1e-8), 0), 4) + 0e0 z from daily window w as {BACK.format(n=335)}""")
def vol_zscore_336_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(f.volume_zscore(d, 336), 4).alias("z"))


@query(f"""with {DAILY}, x as (select asset, ts, sqrt(ln(high / low) ** 2 / (4 * ln(2e0))) x from daily), y as (select asset, ts, case when count(x) over s = 24 then avg(x) over s end a, case when count(x) over l = 168 then avg(x) over l end b
from x window s as {BACK.format(n=23)}, l as {BACK.format(n=167)}) select asset, ts::varchar ts, round(a, 6) short, round(b, 6) long, round(greatest(least(a / (b + 1e-10), 10), 0.1) + case when a is null or b is null then null else 0e0 end, 6) ratio from y""")
def vol_ratio_168_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    d = d.select("asset", "ts", f.parkinson(d, 24).alias("short"), f.parkinson(d, 168).alias("long"))
    ratio = clip(F.col("short") / (F.col("long") + F.lit(1e-10)), 0.1, 10)
    return d.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r("short").alias("short"), r("long").alias("long"), r(ratio).alias("ratio"))


@query(f"""with {DAILY}, x as (select asset, ts, row_number() over (partition by asset order by ts) rn, ln(close) x from daily), wt(k, w) as (values {FFD}), q as (select a.asset, a.rn, sum(b.x * wt.w) s, count(*) n from x a cross join wt join x b on b.asset = a.asset and b.rn = a.rn - wt.k group by 1, 2)
select x.asset, x.ts::varchar ts, round(case when n = {len(f.ffd_weights(0.4))} then s end, 6) + 0e0 fracdiff from x join q using (asset, rn)""")
def fracdiff_full_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(f.fracdiff(d, f.ffd_weights(0.4))).alias("fracdiff"))


HORIZONS = (1, 24, 168)


@query(f"""with {DAILY} select asset, ts::varchar ts, {", ".join(f"round((lead(close, {h}) over w - close) / close, 4) + 0e0 fwd_{h}" for h in HORIZONS)} from daily window w as (partition by asset order by ts)""")
def fwd_returns_168_daily(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select("asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[r(f.forward_return(d, h, pad=None), 4).alias(f"fwd_{h}") for h in HORIZONS])
