"""Audits of features, probabilities, predictions and actions; performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..operators import audit, metrics, regime, scale
from ..operators import features as f
from ..runtime import settled
from .base import PANEL, PROBS, RETURNS, panel, probs, query, r, returns, rounded

LONG = "u as (select 'close' feature, close x from returns union all select 'ret', ret from returns)"
COLS = ["close", "ret"]


@query(f"""with {RETURNS}, {LONG} select feature, count(x) n, round(min(x), 6) min, round(max(x), 6) max, round(avg(x), 6) mean, round(stddev_samp(x), 6) std, """
       + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) p{p}" for p in (25, 50, 75, 95, 99))
       + ", count(*) - count(x) nulls, 100e0 * (count(*) - count(x)) / count(*) null_pct from u group by 1")
def feature_stats(spark, sf_dir):
    return rounded(audit.feature_stats(returns(spark, sf_dir), COLS))


@query(f"""with {RETURNS}, {LONG} select feature, count(x) n, count(*) filter (x <= -1) n_low, count(*) filter (x >= 1) n_high, count(*) filter (x = -1) at_low, count(*) filter (x = 1) at_high,
round(100e0 * (count(*) filter (x <= -1) + count(*) filter (x >= 1)) / count(x), 6) clipped_pct from u group by 1""")
def clip_report(spark, sf_dir):
    return rounded(audit.clip_report(returns(spark, sf_dir), COLS, -1, 1))


@query(f"""with {RETURNS}, {LONG}, g as (select feature, 100e0 * count(*) filter (x < -2) / count(x) b, 100e0 * count(*) filter (x > 2) / count(x) a, quantile_cont(x, 0.01) p1, quantile_cont(x, 0.99) p99 from u group by 1)
select feature, round(b, 6) + 0e0 below_pct, round(a, 6) + 0e0 above_pct, round(p1, 6) + 0e0 p1, round(p99, 6) + 0e0 p99, a + b > 5 flagged from g""")
def clip_justification(spark, sf_dir):
    return rounded(audit.clip_justification(settled(returns(spark, sf_dir)), COLS, -2, 2))


OUT = """, o as (select u.feature, x, case when x < lo or x > hi then x end o from u join b using (feature))
select feature, count(*) n, count(o) n_out, round(min(o), 6) + 0e0 min_out, round(max(o), 6) + 0e0 max_out, round(100e0 * count(o) / count(*), 6) out_pct from o group by 1"""


@query(f"""with {RETURNS}, {LONG}, b as (select feature, quantile_cont(x, 0.25) - 1.5e0 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) lo, quantile_cont(x, 0.75) + 1.5e0 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) hi from u group by 1)"""
       + OUT)
def outliers_iqr(spark, sf_dir):
    return rounded(audit.outliers(returns(spark, sf_dir), COLS, "iqr", 1.5))


@query(f"with {RETURNS}, {LONG}, b as (select feature, avg(x) - 2e0 * stddev_samp(x) lo, avg(x) + 2e0 * stddev_samp(x) hi from u group by 1)" + OUT)
def outliers_zscore(spark, sf_dir):
    return rounded(audit.outliers(returns(spark, sf_dir), COLS, "zscore", 2.0))


@query(f"with {RETURNS}, {LONG} select feature, " + ", ".join(f"count(*) filter (abs(x) > {b}) above_{b}" for b in (1, 5, 10, 100, 1000)) + " from u group by 1")
def magnitude_counts(spark, sf_dir):
    return audit.magnitude_counts(returns(spark, sf_dir), COLS)


@query(f"with {RETURNS}, {LONG} select feature, round(min(x), 6) min, round(max(x), 6) max from u group by 1 having greatest(abs(min(x)), abs(max(x))) > 10")
def magnitude_alert(spark, sf_dir):
    return rounded(audit.magnitude(returns(spark, sf_dir), COLS))


@query(f"""with {RETURNS}, {LONG} select feature, count(*) filter (x is null) n_null, 0::bigint n_inf, stddev_pop(x) = 0 dead, max(abs(x)) > 10 saturated, max(abs(x)) < 1e-6 vanishing from u group by 1""")
def anomalies(spark, sf_dir):
    return audit.anomalies(returns(spark, sf_dir), COLS)


@query(f"""with {RETURNS}, {LONG}, q as (select feature, quantile_cont(x, 0.5) m, greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-2) s from u group by 1),
z as (select feature, x, greatest(least((x - m) / s, 5), -5) z from u join q using (feature)), g as (select feature, avg(x) mean, stddev_samp(x) std, avg(z) mean_b, stddev_samp(z) std_b from z group by 1)
select feature, round(mean, 6) mean, round(std, 6) std, round(mean_b, 6) + 0e0 mean_b, round(std_b, 6) std_b, round(abs(mean_b - mean), 6) mean_shift, round(std_b / std, 6) std_ratio from g""")
def stage_comparison(spark, sf_dir):
    d = settled(returns(spark, sf_dir))
    z = scale.fit_transform(d, COLS)
    return rounded(audit.compare_stages(audit.feature_stats(d, COLS), audit.feature_stats(z, COLS)))


@query(f"""with {RETURNS}, {LONG} select feature, round(avg(x), 6) mean, round(stddev_samp(x), 6) std, abs(avg(x)) > 1 or stddev_samp(x) > 5 alert from u group by 1""")
def scaling_alert(spark, sf_dir):
    return rounded(audit.scaling_alert(returns(spark, sf_dir), COLS))


@query(f"""with {PANEL}, e as (select asset, min(close) lo, max(close) hi from panel group by 1),
h as (select asset, least(floor((close - lo) * 20 / (hi - lo)), 19)::int bin, count(*) n from panel join e using (asset) group by 1, 2), s as (select asset, lo, hi, unnest(range(0, 20))::int bin from e)
select asset, bin, round(lo + (bin + 0.5e0) * (hi - lo) / 20, 6) center, coalesce(n, 0) n from s left join h using (asset, bin)""")
def histogram_values(spark, sf_dir):
    return rounded(audit.histogram(panel(spark, sf_dir), "close", 20, keys=("asset",)))


ACTIONS = RETURNS + ", acts as (select asset, ts, greatest(least(ret / 3, 1), -1) a, ret from returns)"


def actions(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("action", clip(F.col("ret") / 3, -1, 1))


@query(f"""with {ACTIONS}, b as (select asset, least(floor((a + 1) * 21 / 2), 20) bin, count(*) n from acts group by 1, 2), h as (select asset, ln(sum(n)) - sum(n * ln(n)) / sum(n) e from b group by 1)
select asset, round(100 * avg((abs(a) > 0.95e0)::int), 6) saturation_pct, round(avg(a), 6) + 0e0 mean, round(stddev_pop(a), 6) std, round(min(a), 6) min, round(max(a), 6) max, round(any_value(e), 6) entropy from acts join h using (asset) group by 1""")
def action_entropy(spark, sf_dir):
    return rounded(audit.action_distribution(actions(spark, sf_dir), "action", ("asset",)))


CAL = PANEL + ", p as (select asset, ts, (close % 100) / 100 p, coalesce((lead(close) over (partition by asset order by ts) > close)::int, 0) y from panel)"


def predictions(spark, sf_dir):
    d = panel(spark, sf_dir)
    return d.select("asset", "ts", (F.col("close") % 100 / 100).alias("p"), f.direction_target(d).cast("int").alias("y"), "close")


@query(f"with {CAL} select least(floor(p * 10), 9)::int bin, round((least(floor(p * 10), 9) + 0.5e0) / 10, 4) center, round(avg(p), 4) mean_prob, round(avg(y), 4) observed, count(*) n from p group by 1, 2")
def calibration_bins(spark, sf_dir):
    return rounded(audit.calibration(predictions(spark, sf_dir), "p", "y"), 4)


@query(f"""with {CAL}, e as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) e, avg((p - y) ** 2) brier from p),
g as (select len(list_filter(e, lambda x: x <= p))::int bin, avg(p) mp, avg(y) mt, count(*) n, any_value(brier) brier from p, e group by 1)
select bin, round(mp, 6) mean_pred, round(mt, 6) mean_true, n, round(brier, 6) brier, round((select avg(abs(mp - mt)) from g), 6) ece from g""")
def decile_ece(spark, sf_dir):
    return rounded(audit.decile_calibration(settled(predictions(spark, sf_dir)), "p", "y"))


LAGS = f"""{RETURNS}, i as (select asset, row_number() over (partition by asset order by ts) rn, close % 100 a, abs(ret) b from returns), k as (select unnest(range(-6, 7))::int lag),
lc as (select i.asset, k.lag, corr(i.a, j.b) corr from i cross join k join i j on j.asset = i.asset and j.rn = i.rn + k.lag group by 1, 2)"""


def lags(spark, sf_dir):
    d = returns(spark, sf_dir).select("asset", "ts", (F.col("close") % 100).alias("a"), F.abs("ret").alias("b"))
    return audit.lag_correlation(d, "a", "b", 6)


@query(f"with {LAGS} select asset, lag, round(corr, 6) + 0e0 corr from lc")
def lag_corr(spark, sf_dir):
    return rounded(lags(spark, sf_dir))


@query(f"with {LAGS}, b as (select asset, arg_max({{'l': lag, 'c': corr}}, {{'a': abs(corr), 'b': -lag}}) x from lc group by 1) select asset, x.l lag, round(x.c, 6) + 0e0 corr, x.l > 0 is_predictive, greatest(x.l, 0) lead_time from b")
def best_lag(spark, sf_dir):
    return rounded(audit.best_lag(lags(spark, sf_dir)))


@query(f"""with {PROBS}, h as (select asset, p1, lead(close, 1) over w / nullif(close, 0) - 1 a, lead(close, 24) over w / nullif(close, 0) - 1 b, lead(close, 168) over w / nullif(close, 0) - 1 c from probs window w as (partition by asset order by ts))
select asset, round(corr(p1, a), 6) + 0e0 corr_1, round(corr(p1, b), 6) + 0e0 corr_24, round(corr(p1, c), 6) + 0e0 corr_168 from h group by 1""")
def horizon_corr(spark, sf_dir):
    return rounded(audit.horizon_correlation(probs(spark, sf_dir), "p1", (1, 24, 168)))


@query(f"""with {RETURNS}, e as (select min(close) a0, max(close) a1, min(ret) b0, max(ret) b1 from returns), n as (select least(floor((close - a0) * 10 / (a1 - a0)), 9) i, least(floor((ret - b0) * 10 / (b1 - b0)), 9) j, count(*)::double n from returns, e group by 1, 2),
m as (select n, sum(n) over (partition by i) a, sum(n) over (partition by j) b, sum(n) over () t from n) select round(sum(n / t * ln(n * t / (a * b))), 6) mutual_information from m""")
def mutual_info(spark, sf_dir):
    return rounded(audit.mutual_information(returns(spark, sf_dir), "close", "ret"))


@query(f"""with {RETURNS} select 'close' a, 'ret' b, round(corr(close, ret), 6) + 0e0 corr from returns union all select 'close', 'volume', round(corr(close, volume), 6) + 0e0 from returns union all select 'ret', 'volume', round(corr(ret, volume), 6) + 0e0 from returns""")
def corr_pairs(spark, sf_dir):
    return rounded(audit.correlations(returns(spark, sf_dir), ["close", "ret", "volume"]))


@query(f"""with {RETURNS}, s as (select sum(close * close) aa, sum(ret * ret) bb, sum(volume * volume) cc, sum(close * ret) ab, sum(close * volume) ac, sum(ret * volume) bc from returns),
d as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) d from s)
select 'close' feature, round(aa * (bb * cc - bc * bc) / d, 6) vif from d union all select 'ret', round(bb * (aa * cc - ac * ac) / d, 6) from d union all select 'volume', round(cc * (aa * bb - ab * ab) / d, 6) from d""")
def vif(spark, sf_dir):
    """Solved by least squares in the driver; the SQL inverts the matrix of products."""
    return rounded(audit.vif(returns(spark, sf_dir), ["close", "ret", "volume"]))


@query(f"""with {RETURNS}, u as (select state, 'close' feature, close x from returns union all select state, 'ret', ret from returns), g as (select feature, avg(x) m, stddev_pop(x) s from u group by 1)
select state, feature, round(avg(x), 6) + 0e0 state_mean, round((avg(x) - any_value(m)) / (any_value(s) + 1e-10), 6) + 0e0 z, abs((avg(x) - any_value(m)) / (any_value(s) + 1e-10)) > 2 flagged from u join g using (feature) group by 1, 2""")
def attribution(spark, sf_dir):
    return rounded(audit.attribution(returns(spark, sf_dir), COLS))


@query(f"""with {PANEL}, n as (select asset, close, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel),
b as (select asset, any_value(n) n, floor(rn / floor(n / 50))::int bin, avg(close) m, stddev_pop(close) s from n where floor(rn / floor(n / 50)) < 50 group by asset, floor(rn / floor(n / 50))),
g as (select asset, any_value(n) n, max(m) filter (bin = 0) start_, max(m) filter (bin = 49) end_, max(m) peak, regr_slope(m, bin) filter (bin >= 40) slope, avg(s) filter (bin >= 40) noise from b group by 1)
select asset, n, round(start_, 6) "start", round(end_, 6) "end", round(peak, 6) peak, round(slope, 6) + 0e0 slope, round(noise, 6) noise, round(abs(slope) / (noise + 1e-9), 6) snr,
case when end_ > 10000 then 'EXPLODING' when abs(slope) / (noise + 1e-9) < 2 then 'STABLE (Noisy)' when slope > 0 and end_ < 1.5e0 * start_ then 'RISING (Controlled)' when slope > 0 then 'DIVERGING' else 'CONVERGING' end status from g""")
def trend_stats(spark, sf_dir):
    return rounded(audit.trend_stats(panel(spark, sf_dir), "close", "ts", ("asset",)))


@query(f"""with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel),
b as (select asset, floor(rn / greatest(ceil(n / 30e0), 1))::int bucket, avg(close) v, list(ts order by ts) l from n group by 1, 2) select asset, bucket, round(v, 6) as value, l[floor(len(l) / 2)::int + 1] step from b""")
def resampled(spark, sf_dir):
    return rounded(audit.resample(panel(spark, sf_dir), "close", "ts", 30, ("asset",)))


@query(f"""with {PANEL}, n as (select asset, ts, close, row_number() over (partition by asset order by ts) - 1 rn, count(*) over (partition by asset) n from panel),
b as (select asset, floor(rn / greatest(ceil(n / 30e0), 1))::int bucket, avg(close) v from n group by 1, 2), e as (select asset, bucket, v, min(v) over (partition by asset) lo, max(v) over (partition by asset) hi from b)
select asset, string_agg(substr('▁▂▃▄▅▆▇█', least(floor(coalesce((v - lo) * 8 / nullif(hi - lo, 0), 0)), 7)::int + 1, 1), '' order by bucket) sparkline from e group by 1""")
def sparklines(spark, sf_dir):
    return audit.sparkline(audit.resample(panel(spark, sf_dir), "close", "ts", 30, ("asset",)), "value", "bucket", ("asset",))


@query(f"""with {CAL}, c as (select count(*) filter (p >= 0.5e0 and y = 1) tp, count(*) filter (p < 0.5e0 and y = 0) tn, count(*) filter (p >= 0.5e0 and y = 0) fp, count(*) filter (p < 0.5e0 and y = 1) fn from p),
d as (select *, (tp + tn) / (tp + tn + fp + fn)::double accuracy, tp / (tp + fp)::double "precision", tp / (tp + fn)::double recall from c)
select tp, tn, fp, fn, round(accuracy, 6) accuracy, round("precision", 6) "precision", round(recall, 6) recall, round(2 * "precision" * recall / ("precision" + recall), 6) f1 from d""")
def classification(spark, sf_dir):
    return rounded(audit.classification(predictions(spark, sf_dir).withColumn("g", (F.col("p") >= 0.5).cast("int")), "g", "y"))


@query(f"""with {CAL}, g as (select 100 * greatest(avg(y), 1 - avg(y)) b, 100 * avg(((p >= 0.5e0)::int = y)::int) a from p)
select round(b, 6) baseline_pct, round(a, 6) accuracy_pct, round(a - b, 6) + 0e0 gain, case when a - b > 2 then 'SIGNAL' when a - b > 0.5 then 'WEAK' else 'NONE' end signal from g""")
def majority_gain(spark, sf_dir):
    return rounded(audit.majority_gain(predictions(spark, sf_dir).withColumn("g", (F.col("p") >= 0.5).cast("int")), "g", "y"))


@query(f"with {CAL} select round((count(y) - sum(y)) / (sum(y) + 1e-6), 6) pos_weight from p")
def class_weight(spark, sf_dir):
    return rounded(audit.class_weight(predictions(spark, sf_dir), "y"))


@query("""with s as (select vec_id as row, unnest(range(0, 3))::int seed, embedding from embeddings), l as (select row, seed, (embedding[seed + 1] > 0)::int label from s)
select a.seed a, b.seed b, round(avg((a.label = b.label)::int), 6) overlap, avg((a.label = b.label)::int) >= 0.8e0 stable from l a join l b on a.row = b.row and a.seed < b.seed group by 1, 2""")
def seed_overlap(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select(F.col("vec_id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed"), "embedding")
    return rounded(audit.seed_overlap(d.select("row", "seed", (F.get("embedding", F.col("seed")) > 0).cast("int").alias("label"))))


@query("""with s as (select vec_id, embedding[1]::double actual, embedding[2]::double rebuilt, label, vec_id % 3 = 0 masked from embeddings), m as (select label feature, avg((actual - rebuilt) ** 2) mse from s where masked group by 1),
k as (select feature, mse, row_number() over (order by mse, feature) b, row_number() over (order by mse desc, feature) w from m) select feature, round(mse, 6) mse, (case when b <= 3 then b end)::int best, (case when w <= 3 then w end)::int worst from k""")
def reconstruction(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = e.select(F.col("label").alias("feature"), F.get("embedding", 0).cast("double").alias("actual"), F.get("embedding", 1).cast("double").alias("rebuilt"), (F.col("vec_id") % 3 == 0).alias("masked"))
    return rounded(audit.reconstruction(d, k=3))


@query("""with s as (select label, list_sort(list_transform(embedding, lambda x: x::double)) q from embeddings) select label, round(avg(q[floor(len(q) * 0.9e0)::int + 1] - q[floor(len(q) * 0.1e0)::int + 1]), 6) mean_spread from s group by 1""")
def quantile_spread(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(audit.quantile_spread(e.select("label", F.array_sort(F.col("embedding").cast("array<double>")).alias("q")), "q", ("label",)))


@query(f"""with {PROBS} select count(*) as rows, count(*) filter (abs(p0 + p1 + p2 - 1) > 1e-6) sum_violations, round(avg(p0 + p1 + p2), 6) mean_sum, round(100 * avg((greatest(p0, p1, p2) > 0.99e0)::int), 6) certain_pct,
round(100 * avg((greatest(abs(p0 - 1e0 / 3), abs(p1 - 1e0 / 3), abs(p2 - 1e0 / 3)) <= 0.05e0)::int), 6) confused_pct, """ + ", ".join(f"round(avg({p}), 6) {p}_mean, round(stddev_samp({p}), 6) {p}_std" for p in ("p0", "p1", "p2")) + " from probs")
def probability_audit(spark, sf_dir):
    return rounded(audit.probability_audit(probs(spark, sf_dir), ["p0", "p1", "p2"]))


ENTROPY = PROBS + ", ent as (select asset, ts, -(case when p0 > 0 then p0 * ln(p0) else 0 end + case when p1 > 0 then p1 * ln(p1) else 0 end + case when p2 > 0 then p2 * ln(p2) else 0 end) / ln(3e0) e from probs)"


@query(f"""with {ENTROPY} select count(*) n, round(avg(e), 6) mean, round(stddev_samp(e), 6) std, round(min(e), 6) min, round(max(e), 6) max, round(100 * avg((e < 0.3e0)::int), 6) low_pct, round(100 * avg((e between 0.3e0 and 0.7e0)::int), 6) medium_pct,
round(100 * avg((e > 0.7e0)::int), 6) high_pct, round(100 * avg((e > 0.8e0)::int), 6) very_high_pct, case when avg(e) > 0.8e0 then 'CONFUSED' when avg(e) < 0.05e0 then 'OVERCONFIDENT' else 'OK' end alert from ent""")
def entropy_audit(spark, sf_dir):
    return rounded(audit.entropy_audit(audit.row_entropy(probs(spark, sf_dir), ["p0", "p1", "p2"])))


@query(f"""with {PROBS}, d as (select asset, ts, close, lag(close) over (partition by asset order by ts) p, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end s from probs),
e as (select s, case when p > 0 and close > 0 then ln(close / p) end ret from d), g as (select s, count(*) n, avg(ret) m from e group by 1), h as (select *, n / sum(n) over () sh from g)
select count(*) filter (sh >= 0.05e0) active, round(coalesce(stddev_pop(m) filter (sh >= 0.05e0), 0), 6) separation, count(*) filter (sh >= 0.05e0) >= 3 valid from h""")
def regime_quality(spark, sf_dir):
    d = probs(spark, sf_dir)
    return rounded(regime.quality(d.withColumn("ret", f.log_return(d, bound=None)), ["p0", "p1", "p2"]))


# ---------------------------------------------------------------- states


RUNS = RETURNS + """, chg as (select *, coalesce((state <> lag(state) over (partition by asset order by ts))::int, 1) c from returns), run as (select *, sum(c) over (partition by asset order by ts rows between unbounded preceding and current row) run from chg),
runs as (select asset, run::bigint run, any_value(state) state, min(ts) "start", max(ts) "end", count(*) length from run group by 1, 2)"""


@query(f"with {RUNS} select * from runs")
def state_runs(spark, sf_dir):
    return regime.runs(returns(spark, sf_dir))


@query(f"with {RUNS} select asset, state, count(*) runs, round(avg(length), 6) mean_length, max(length) max_length from runs group by 1, 2")
def state_run_lengths(spark, sf_dir):
    return rounded(regime.run_lengths(returns(spark, sf_dir)))


@query(f"with {RETURNS}, t as (select lag(state) over (partition by asset order by ts) prev, state as next from returns) select prev, next, count(*) n from t where prev <> next group by 1, 2 order by n desc, prev, next limit 5")
def state_transitions(spark, sf_dir):
    return regime.transitions(returns(spark, sf_dir), top=5)


@query(f"""with {RUNS}, l as (select asset, state, avg(length) ml from runs group by 1, 2), g as (select asset, state, count(*) n, 100 * avg((ret > 0)::int) w, avg(abs(ret)) a, avg(ret) m from returns group by 1, 2)
select asset, state, n, round(w, 6) win_rate, round(a, 6) mean_abs_ret, round(m, 6) + 0e0 mean_ret, round(100 * n / sum(n) over (partition by asset), 6) share_pct, round(ml, 6) mean_length from g join l using (asset, state)""")
def state_stats(spark, sf_dir):
    return rounded(regime.state_stats(returns(spark, sf_dir)))


SHARPE = "case when count({r}) >= 2 and stddev_pop({r}) > 0 then avg({r}) / stddev_pop({r}) * sqrt({n}e0) else 0e0 end"


@query(f"""with {RETURNS}, s as (select asset, state, ts, ret, close, sum(ret / 100) over w c from returns window w as (partition by asset, state order by ts rows between unbounded preceding and current row)),
d as (select *, 1 - exp(c) / max(exp(c)) over w dd from s window w as (partition by asset, state order by ts rows between unbounded preceding and current row))
select asset, state, count(*) n, round(avg(ret / 100) * 6048 * 100, 4) + 0e0 annual_ret_pct, round({SHARPE.format(r="ret / 100", n=6048)}, 6) + 0e0 sharpe, round(100 * max(dd), 6) max_dd_pct, round(avg(close), 6) mean_vol from d group by 1, 2 having count(*) >= 2""")
def fingerprint(spark, sf_dir):
    d = returns(spark, sf_dir).withColumn("ret", F.col("ret") / 100)
    got = regime.fingerprint(d, vol="close")
    return got.select("asset", "state", "n", r("annual_ret_pct", 4).alias("annual_ret_pct"), *[r(c).alias(c) for c in ("sharpe", "max_dd_pct", "mean_vol")])


@query(f"with {RETURNS} select state, count(*) n, round({SHARPE.format(r='ret', n=6048)}, 6) + 0e0 sharpe, round(100 * avg((ret > 0)::int), 6) win_rate, round(avg(ret), 6) + 0e0 mean_ret from returns group by 1 having count(*) > 10")
def state_performance(spark, sf_dir):
    return rounded(regime.performance(returns(spark, sf_dir)))


# ---------------------------------------------------------------- performance


@query(f"""with {RETURNS}, d as (select asset, ret, case when ret < 0 then ret end dn from returns)
select asset, round({SHARPE.format(r="ret", n=6048)}, 6) + 0e0 sharpe, round(case when count(dn) >= 2 and stddev_pop(dn) > 0 then avg(ret) / stddev_pop(dn) * sqrt(6048e0) else 0e0 end, 6) + 0e0 sortino, round(avg((ret > 0)::int), 6) win_rate,
round(sum(case when ret > 0 then ret end) / nullif(sum(case when ret < 0 then -ret end), 0), 6) profit_factor from d group by 1""")
def sharpe_sortino_by_asset(spark, sf_dir):
    x = F.col("ret")
    return rounded(returns(spark, sf_dir).groupBy("asset").agg(metrics.sharpe(x).alias("sharpe"), metrics.sortino(x).alias("sortino"), metrics.win_rate(x).alias("win_rate"), metrics.profit_factor(x).alias("profit_factor")))


@query(f"""with {PANEL}, d as (select asset, (max(close) over w - close) / nullif(max(close) over w, 0) dd from panel window w as (partition by asset order by ts rows between unbounded preceding and current row)) select asset, round(max(dd), 6) max_drawdown from d group by 1""")
def max_drawdown(spark, sf_dir):
    return rounded(metrics.max_drawdown(panel(spark, sf_dir), "close"))


@query("""with d as (select o_orderpriority asset, date_trunc('day', o_orderdate) ts, sum(o_totalprice) v from orders group by 1, 2), x as (select asset, (max(v) over w - v) / max(v) over w dd from d window w as (partition by asset order by ts rows between unbounded preceding and current row))
select asset, round(max(dd), 6) max_drawdown from x group by 1""")
def orders_drawdown(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.groupBy(F.col("o_orderpriority").alias("asset"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(metrics.max_drawdown(d, "v"))


@query(f"with {PANEL} select asset, round((arg_max(close, ts) - arg_min(close, ts)) / nullif(arg_min(close, ts), 0), 6) + 0e0 total_return from panel group by 1")
def total_return(spark, sf_dir):
    return rounded(panel(spark, sf_dir).groupBy("asset").agg(metrics.total_return(F.col("close"), F.col("ts")).alias("total_return")))


@query(f"""with {RETURNS}, v as (select asset, ts, close price, ret / 10 ret, (state - 1.5e0) / 1.5e0 position, 10000 * exp(sum(ret / 10) over (partition by asset order by ts rows between unbounded preceding and current row)) nav, ret * 2 bench_ret,
  row_number() over (partition by asset order by ts) <= 24 ctx from returns), k as (select *, (max(nav) over w - nav) / max(nav) over w dd, (position <> coalesce(lag(position) over (partition by asset order by ts), 0))::int tr from v where not ctx window w as (partition by asset order by ts rows between unbounded preceding and current row)),
g as (select asset, count(*) rows_, {SHARPE.format(r="ret", n=8760)} sharpe, 100 * (arg_max(nav, ts) / arg_min(nav, ts) - 1) pnl, 100 * max(dd) dd, sum(tr)::bigint trades, 100 * (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) bench, corr(ret, bench_ret) c from k group by 1)
select asset, rows_ as rows, round(sharpe, 4) + 0e0 sharpe, round(pnl, 4) + 0e0 pnl_pct, round(dd, 4) max_dd_pct, trades, round(bench, 4) + 0e0 bench_pct, round(c, 4) + 0e0 market_corr, round(pnl - bench, 4) + 0e0 alpha_pct, case when bench > 15 then 'BULLISH' when bench < -15 then 'BEARISH' else 'RANGING' end market_regime from g""")
def segment_evaluation(spark, sf_dir):
    from pyspark.sql import Window

    d = returns(spark, sf_dir).withColumn("ret", F.col("ret") / 10)
    d = d.withColumns({"nav": metrics.cumulative_value(d, "ret"), "price": F.col("close"), "position": (F.col("state") - 1.5) / 1.5, "bench_ret": F.col("ret") * 20,
                       "is_context": F.row_number().over(Window.partitionBy("asset").orderBy("ts")) <= 24})
    return rounded(metrics.evaluate_segment(d, ("asset",)), 4)


