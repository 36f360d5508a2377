"""Bars, grid, cleansing, splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, scale, split, sync
from .base import BARS, GRID, PANEL, RETURNS, bars, events, panel, query, returns, rounded

WF = split.WalkForward(train=240, purge=48, eval=72, test=96, embargo=12, step=96)


@query(f"with {BARS} select * from bars")
def bars_hourly(spark, sf_dir):
    return bars(spark, sf_dir)


@query(f"with {PANEL} select * from panel")
def grid_ffill(spark, sf_dir):
    return panel(spark, sf_dir)


@query(f"""with {BARS}, g as (select asset, lag(ts) over (partition by asset order by ts) gap_start, ts gap_end from bars)
select asset, gap_start, gap_end, (epoch(gap_end) - epoch(gap_start)) / 3600e0 gap_hours from g where gap_end - gap_start > interval 1 hour""")
def grid_gaps(spark, sf_dir):
    return sync.gaps(bars(spark, sf_dir), 1)


@query(f"""with {PANEL}, s as (select asset, ts, case when open > 20 then open end o, case when close > 20 then close end c from panel)
select asset, ts, coalesce(last_value(o ignore nulls) over w, first_value(o ignore nulls) over v) as open, coalesce(last_value(c ignore nulls) over w, first_value(c ignore nulls) over v) as close
from s window w as (partition by asset order by ts), v as (partition by asset order by ts rows between current row and unbounded following)""")
def sanitize_prices(spark, sf_dir):
    p = panel(spark, sf_dir).select("asset", "ts", *[F.when(F.col(c) > 20, F.col(c)).otherwise(0.0).alias(c) for c in ("open", "close")])
    return sync.sanitize_prices(p, ("open", "close"), look_ahead=True)


@query(f"with {PANEL} select asset, count(*) filter (open <= 20) n_open, count(*) filter (close <= 20) n_close from panel group by 1")
def zero_prices(spark, sf_dir):
    p = panel(spark, sf_dir)
    return sync.zero_prices(p.withColumns({"open": F.col("open") - 20, "close": F.col("close") - 20}), ("open", "close"))


@query("""with h as (select user_id, date_trunc('hour', ts)::timestamp ts, arg_max({'v': value, 't': event_type}, {'a': ts, 'b': event_id}) x from events group by 1, 2)
select user_id, ts, x.v as value, x.t event_type from h""")
def last_of_hour(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.col("ts").alias("at"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value", "event_type")
    return sync.one_row(e, ["user_id", "ts"], ["at", "event_id"]).select("user_id", "ts", "value", "event_type")


@query(f"""with {BARS}, m as (select ts from bars where asset = 'click'), g as (select m.ts, a.asset, b.close, b.volume from m cross join (select distinct asset from bars) a
left join bars b on b.ts = m.ts and b.asset = a.asset)
select asset, ts, last_value(close ignore nulls) over w as close, last_value(volume ignore nulls) over w volume from g window w as (partition by asset order by ts)""")
def align_master(spark, sf_dir):
    return sync.align(bars(spark, sf_dir).select("asset", "ts", "close", "volume"), "click", ("close", "volume")).select("asset", "ts", "close", "volume")


@query(f"""with {PANEL} select ts, max(case when asset = 'click' then close end) click_close, max(case when asset = 'view' then close end) view_close from panel group by 1""")
def wide_panel(spark, sf_dir):
    return sync.wide(panel(spark, sf_dir), ["click", "view"], ["close"])


@query(f"""with {GRID} select asset, ts, close from grid where ts not in (select ts from grid where close is null)""")
def complete_hours(spark, sf_dir):
    return sync.complete_hours(sync.grid(bars(spark, sf_dir)), ["close"]).select("asset", "ts", "close")


@query(f"""with {PANEL} select asset, ts, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0e0 sin_hour, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0e0 cos_hour,
round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0e0 sin_day, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0e0 cos_day from panel""")
def time_encoding(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("asset", "ts", *[c.alias(k) for k, c in features.time_encoding().items()]))


SPLIT = f"""{PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel),
l as (select *, floor(n * 0.7e0) a, floor(n * 0.85e0) b from n),
s as (select asset, ts, close, rn, case when rn < a then 'train' when rn >= a + 48 and rn < b then 'val' when rn >= b + 48 then 'test' end split from l)"""


@query(f"with {SPLIT} select asset, ts, close, rn, split from s where split is not null")
def split_70_15_15_purged(spark, sf_dir):
    return split.split(panel(spark, sf_dir).select("asset", "ts", "close"), purge=48).select("asset", "ts", "close", F.col("rn").cast("long").alias("rn"), "split")


@query(f"with {SPLIT} select asset, split, count(*) as rows, min(ts) first_ts, max(ts) last_ts from s where split is not null group by 1, 2")
def split_summary(spark, sf_dir):
    return split.summary(split.split(panel(spark, sf_dir).select("asset", "ts", "close"), purge=48))


@query(f"""with {PANEL}, n as (select asset, ts, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel)
select asset, ts, case when rn < floor(n * 0.8e0) then 'train' else 'eval' end split from n where rn < floor(n * 0.8e0) or rn >= floor(n * 0.8e0) + 50""")
def split_two_way(spark, sf_dir):
    d = split.numbered(panel(spark, sf_dir).select("asset", "ts"))
    return d.withColumn("split", split.two_way(F.col("n"), F.col("rn"), 0.8, 50)).where("split is not null").select("asset", "ts", "split")


SEGMENTS = """longest as (select coalesce(max(c), 0) n from (select count(*) c from returns group by asset)),
segments as (select k::int segment, k * 96 train_start, k * 96 + 240 train_end, k * 96 + 288 eval_start, k * 96 + 360 eval_end, k * 96 + 408 test_start, k * 96 + 504 test_end
  from (select unnest(range(0, greatest(0, floor((n - 516) / 96e0)::bigint + 1))) k from longest))"""
RANKED = f"{RETURNS}, n as (select *, row_number() over (partition by asset order by ts) - 1 rn from returns)"
SEGMENT_ROWS = f"""{RANKED}, {SEGMENTS}, rowed as (select n.*, segment, case when rn < train_end then 'train' when rn >= eval_start and rn < eval_end then 'eval' when rn >= test_start then 'test' end split
  from n join segments on rn >= train_start and rn < test_end), seg as (select * from rowed where split is not null)"""


def segments(spark, d):
    """The segments of the longest series of d; one aggregated number."""
    return WF.segments(spark, d.groupBy("asset").count().agg(F.max("count")).first()[0] or 0)


def segment_rows(spark, sf_dir):
    d = split.numbered(returns(spark, sf_dir)).drop("n")
    return WF.rows(d, segments(spark, d))


@query(f"with {RETURNS}, {SEGMENTS} select * from segments")
def wfo_segments(spark, sf_dir):
    return segments(spark, returns(spark, sf_dir))


@query(f"with {SEGMENT_ROWS} select asset, segment, split, count(*) as rows, min(ts) first_ts, max(ts) last_ts from seg group by 1, 2, 3")
def wfo_rows_per_split(spark, sf_dir):
    return segment_rows(spark, sf_dir).groupBy("asset", "segment", "split").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""with {RANKED}, {SEGMENTS}, j as (select * from n join segments on rn >= train_start and rn < test_end),
k as (select asset, segment, 'eval' split, rn from j where rn >= train_end - 36 and rn < train_end union all
  select asset, segment, 'test', rn from j where rn >= eval_end - 36 and rn < eval_end)
select asset, segment, split, count(*) as rows, min(rn) first_rn, max(rn) last_rn from k group by 1, 2, 3""")
def wfo_context_rows(spark, sf_dir):
    d = split.numbered(returns(spark, sf_dir)).drop("n")
    got = split.with_context(d, WF, segments(spark, d), 36).where("is_context")
    return got.groupBy("asset", "segment", "split").agg(F.count("*").alias("rows"), F.min("rn").cast("long").alias("first_rn"), F.max("rn").cast("long").alias("last_rn"))


@query(f"""with {SEGMENT_ROWS}, f as (select asset, segment, quantile_cont(close, 0.5) m, greatest(quantile_cont(close, 0.75) - quantile_cont(close, 0.25), 1e-2) s,
  quantile_cont(ret, 0.5) mr, greatest(quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25), 1e-2) sr from seg where split = 'train' group by 1, 2)
select asset, segment, split, ts, round((close - m) / s, 6) + 0e0 as close, round(greatest(least((ret - mr) / sr, 5), -5), 6) + 0e0 ret from seg join f using (asset, segment)""")
def robust_scale_train_only(spark, sf_dir):
    d = segment_rows(spark, sf_dir).select("asset", "segment", "split", "ts", "close", "ret")
    return rounded(scale.by_segment(d, ["close", "ret"], bounded=("ret",)).select("asset", "segment", "split", "ts", "close", "ret"))


@query(f"""with {RETURNS}, u as (select 'close' feature, close x from returns union all select 'ret', ret from returns)
select feature, round(quantile_cont(x, 0.5), 6) + 0e0 center, round(greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-2), 6) + 0e0 scale from u group by 1""")
def scaler_fit(spark, sf_dir):
    return rounded(scale.fit(returns(spark, sf_dir), ["close", "ret"]))


@query("""with d as (select date_trunc('day', o_orderdate)::date as day, o_orderpriority k, sum(o_totalprice) v from orders group by 1, 2),
n as (select *, row_number() over (partition by k order by day) - 1 rn, count(*) over (partition by k) n from d)
select k, case when rn < floor(n * 0.7e0) then 'train' when rn < floor(n * 0.85e0) then 'val' else 'test' end split, count(*) as rows from n group by 1, 2""")
def split_orders_daily(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    d = split.numbered(d, ("k",), "day")
    return d.withColumn("split", split.split_label(F.col("n"), F.col("rn"), purge=0)).groupBy("k", "split").agg(F.count("*").alias("rows"))
