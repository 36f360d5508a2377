"""Read-only analytics of features, probabilities, actions and predictions. Each returns a small frame."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import div, entropy
from ..functions.ranks import quantiles
from ..functions.windows import over
from .scale import long, with_quantiles
from .split import numbered

GLYPHS = "▁▂▃▄▅▆▇█"


def feature_stats(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, extremes, mean, deviation (n - 1), exact percentiles and share of NULLs of each column."""
    rows = long(df, columns, list(keys))
    out = rows.groupBy(*keys, "feature").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.count_if(F.col("x").isNull()).alias("nulls"), F.count("*").alias("rows"),
    )
    out = with_quantiles(out, quantiles(rows, [*keys, "feature"], (0.25, 0.5, 0.75, 0.95, 0.99)), [*keys, "feature"])
    return out.select(*keys, "feature", "n", "min", "max", "mean", "std", *[F.get("q", k).alias(f"p{p}") for k, p in enumerate((25, 50, 75, 95, 99))],
                      "nulls", (100 * div("nulls", "rows")).alias("null_pct"))


def clip_report(df: DataFrame, columns: list[str], low: float, high: float, keys: tuple[str, ...] = ()) -> DataFrame:
    out = long(df, columns, list(keys)).groupBy(*keys, "feature").agg(
        F.count("x").alias("n"), F.count_if(F.col("x") <= low).alias("n_low"), F.count_if(F.col("x") >= high).alias("n_high"),
        F.count_if(F.col("x") == low).alias("at_low"), F.count_if(F.col("x") == high).alias("at_high"),
    )
    return out.withColumn("clipped_pct", F.coalesce(100 * div(F.col("n_low") + F.col("n_high"), "n"), F.lit(0.0)))


def clip_justification(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """What bounds would cut, against the 1 % and 99 % percentiles; flagged beyond 5 %."""
    rows = long(df, columns, [])
    out = rows.groupBy("feature").agg(F.count("x").alias("n"), F.count_if(F.col("x") < low).alias("below"), F.count_if(F.col("x") > high).alias("above"))
    out = with_quantiles(out, quantiles(rows, ["feature"], (0.01, 0.99)), ["feature"])
    pct = 100 * div(F.col("below") + F.col("above"), "n")
    return out.select("feature", (100 * div("below", "n")).alias("below_pct"), (100 * div("above", "n")).alias("above_pct"), F.get("q", 0).alias("p1"), F.get("q", 1).alias("p99"), (pct > 5).alias("flagged"))


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 3.0) -> DataFrame:
    """Rows outside quartiles -+ k IQR, or more than k deviations from the mean: count, share, extremes."""
    rows = long(df, columns, []).where("x is not null")
    if method == "iqr":
        q = quantiles(rows, ["feature"], (0.25, 0.75))
        iqr = F.get("q", 1) - F.get("q", 0)
        bounds = q.select("feature", (F.get("q", 0) - k * iqr).alias("lo"), (F.get("q", 1) + k * iqr).alias("hi"))
    else:
        m, s = F.avg("x"), F.stddev_samp("x")
        bounds = rows.groupBy("feature").agg((m - k * s).alias("lo"), (m + k * s).alias("hi"))
    out = F.when((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")), F.col("x"))
    got = rows.join(bounds, "feature").groupBy("feature").agg(F.count("*").alias("n"), F.count(out).alias("n_out"), F.min(out).alias("min_out"), F.max(out).alias("max_out"))
    return got.withColumn("out_pct", 100 * div("n_out", "n"))


def magnitude(df: DataFrame, columns: list[str], most: float = 10.0) -> DataFrame:
    """Columns whose largest absolute value is above `most`."""
    got = long(df, columns, []).groupBy("feature").agg(F.min("x").alias("min"), F.max("x").alias("max"))
    return got.where(F.greatest(F.abs("min"), F.abs("max")) > most)


def magnitude_counts(df: DataFrame, columns: list[str], bounds: tuple[float, ...] = (1, 5, 10, 100, 1000)) -> DataFrame:
    got = long(df, columns, []).groupBy("feature").agg(*[F.count_if(F.abs("x") > b).alias(f"above_{b:g}") for b in bounds])
    return got.select("feature", *[f"above_{b:g}" for b in bounds])


def anomalies(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs and infinities, and features that are dead, saturated (beyond 10) or vanishing (all within 1e-6)."""
    inf = F.abs("x") == float("inf")
    x = F.when(~F.isnan("x") & ~inf, F.col("x"))
    got = long(df, columns, []).groupBy("feature").agg(
        F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_null"), F.count_if(inf).alias("n_inf"), F.stddev_pop(x).alias("std"), F.max(F.abs(x)).alias("top"))
    return got.select("feature", "n_null", "n_inf", (F.col("std") == 0).alias("dead"), (F.col("top") > 10).alias("saturated"), (F.col("top") < 1e-6).alias("vanishing"))


def compare_stages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of feature_stats side by side: shift of the mean and ratio of deviations; features that b lacks stay."""
    right = b.select("feature", F.col("mean").alias("mean_b"), F.col("std").alias("std_b"))
    return a.join(right, "feature", "left").select("feature", "mean", "std", "mean_b", "std_b", F.abs(F.col("mean_b") - F.col("mean")).alias("mean_shift"), div("std_b", "std").alias("std_ratio"))


def normalization_report(raw: DataFrame, scaled: DataFrame, columns: list[str], low: float = -5.0, high: float = 5.0) -> DataFrame:
    both = compare_stages(feature_stats(raw, columns), feature_stats(scaled, columns))
    return both.join(clip_report(scaled, columns, low, high).select("feature", "clipped_pct"), "feature").join(outliers(raw, columns).select("feature", "out_pct"), "feature", "left")


def clip_heatmap(stages: dict[str, DataFrame], columns: list[str], low: float, high: float) -> DataFrame:
    """Share clipped, a row a feature and a column a stage."""
    every = None
    for name, df in stages.items():
        one = clip_report(df, columns, low, high).select("feature", F.lit(name).alias("stage"), "clipped_pct")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("feature").pivot("stage", list(stages)).agg(F.first("clipped_pct"))


def scaling_alert(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled columns whose mean is beyond 1 or deviation above 5."""
    got = long(df, columns, []).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return got.withColumn("alert", (F.abs("mean") > 1) | (F.col("std") > 5))


def histogram(df: DataFrame, c: str, bins: int, low: float | None = None, high: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in equal bins, the last closed, zeros included; bounds default to the extremes of each key."""
    lo = F.min(c) if low is None else F.lit(float(low))
    hi = F.max(c) if high is None else F.lit(float(high))
    ends = df.groupBy(*keys).agg(F.count("*").alias("__n"), *([lo.alias("lo"), hi.alias("hi")] if low is None or high is None else [F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi")]))
    d = df.join(ends, list(keys)) if keys else df.join(F.broadcast(ends), how="cross")  # one row
    d = d.where((F.col(c) >= F.col("lo")) & (F.col(c) <= F.col("hi")))
    at = F.least(F.floor(F.coalesce(div((F.col(c) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    got = d.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    return spine.join(got, [*keys, "bin"], "left").select(*keys, "bin", mid.alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def action_distribution(df: DataFrame, c: str = "action", keys: tuple[str, ...] = (), bins: int = 21, saturated: float = 0.95) -> DataFrame:
    """Share near the bounds, entropy (nats) over bins of [-1, 1], moments (over n)."""
    h = histogram(df, c, bins, -1, 1, keys).groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n").cast("double"))).otherwise(0.0)).alias("s"))
    h = h.select(*keys, F.coalesce(F.ln("t") - div("s", "t"), F.lit(0.0)).alias("entropy"))
    m = df.groupBy(*keys).agg(
        (100 * F.avg((F.abs(c) > saturated).cast("double"))).alias("saturation_pct"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return m.join(h, list(keys)) if keys else m.join(F.broadcast(h), how="cross")  # one row each


def calibration(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed share of the outcome by bins of [0, 1]."""
    at = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(prob).between(0, 1)).groupBy(at.alias("bin")).agg(
        ((F.first(at) + 0.5) / bins).alias("center"), F.avg(prob).alias("mean_prob"), F.avg(F.col(outcome).cast("double")).alias("observed"), F.count("*").alias("n"))


def decile_calibration(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """Means by bins whose edges are percentiles of the prediction; ece is their mean absolute gap, brier the mean squared error."""
    brier = df.agg(F.avg(F.pow(F.col(prob) - F.col(outcome), 2)).alias("brier"))
    edges = quantiles(df, [], [k / bins for k in range(1, bins)], prob).withColumnRenamed("q", "e").join(F.broadcast(brier), how="cross")  # one row each
    d = df.join(F.broadcast(edges), how="cross")  # one row
    at = F.size(F.filter("e", lambda x: x <= F.col(prob)))
    got = d.groupBy(at.alias("bin")).agg(F.avg(prob).alias("mean_pred"), F.avg(outcome).alias("mean_true"), F.count("*").alias("n"), F.first("brier").alias("brier"))
    ece = got.agg(F.avg(F.abs(F.col("mean_pred") - F.col("mean_true"))).alias("ece"))
    return got.join(F.broadcast(ece), how="cross")  # ten rows


def lag_correlation(df: DataFrame, a: str, b: str, most: int = 24, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Correlation of a with b so many rows later, for lags -most to most: negative lags compare with earlier rows."""
    w = over(df, keys)
    lags = df.select(*keys, a, *[(F.lead(b, k) if k >= 0 else F.lag(b, -k)).over(w).alias(f"__{k + most}") for k in range(-most, most + 1)])
    got = lags.groupBy(*keys).agg(*[F.corr(a, f"__{k}").alias(f"c{k}") for k in range(2 * most + 1)])
    each = F.array(*[F.struct(F.lit(k - most).alias("lag"), F.col(f"c{k}").alias("corr")) for k in range(2 * most + 1)])
    return got.select(*keys, F.explode(each).alias("x")).select(*keys, "x.lag", "x.corr")


def best_lag(lags: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The lag of the largest absolute correlation, the smallest of equals; predictive if it is positive."""
    best = F.max_by(F.struct("lag", "corr"), F.struct(F.coalesce(F.abs("corr"), F.lit(-1.0)), -F.col("lag")))
    got = lags.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.lag").alias("lag"), F.col("b.corr").alias("corr"))
    return got.withColumns({"is_predictive": F.col("lag") > 0, "lead_time": F.greatest("lag", F.lit(0))})


def horizon_correlation(df: DataFrame, prob: str, horizons: tuple[int, ...] = (1, 24, 168), price: str = "close", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Correlation of a probability with the relative change over each horizon; 0 for 10 rows or fewer."""
    w = over(df, keys)
    d = df.select(*keys, prob, *[(div(F.lead(price, h).over(w), price) - 1).alias(f"__{h}") for h in horizons])
    return d.groupBy(*keys).agg(*[F.when(F.count(F.when(F.col(prob).isNotNull(), F.col(f"__{h}"))) > 10, F.coalesce(F.corr(prob, f"__{h}"), F.lit(0.0))).otherwise(0.0).alias(f"corr_{h}") for h in horizons])


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Of two columns cut into equal bins, in nats."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = d.agg(*[f(c).alias(f"__{n}{k}") for c, k in ((a, "a"), (b, "b")) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c, k: F.least(F.floor(F.coalesce(div((F.col(c) - F.col(f"__lo{k}")) * bins, F.col(f"__hi{k}") - F.col(f"__lo{k}")), F.lit(0.0))), F.lit(bins - 1))
    joint = d.join(F.broadcast(ends), how="cross").groupBy(at(a, "a").alias("i"), at(b, "b").alias("j")).agg(F.count("*").alias("n"))  # ends: one row
    # at most bins * bins rows from here on
    n = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    p = joint.select(F.col("n").cast("double").alias("n"), n("i").cast("double").alias("ni"), n("j").cast("double").alias("nj"), n().cast("double").alias("t"))
    return p.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mutual_information"))


def correlations(df: DataFrame, columns: list[str], least: float | None = None) -> DataFrame:
    """Correlation of each pair of columns, rows with any NULL left out; pairs above `least` in size only, if given."""
    d = df.select(*columns).dropna()
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    got = d.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    out = got.select(F.explode(each).alias("x")).select("x.a", "x.b", "x.corr")
    return out if least is None else out.where(F.abs("corr") > least)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors without an intercept: from the matrix of products, one aggregation, solved in the driver."""
    import numpy as np

    d = df.select(*columns).dropna()
    k = len(columns)
    sums = d.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [0.0 if x is None else x for x in sums]
    m = m + m.T - np.diag(np.diag(m))
    out = []
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        fit = float(m[i, rest] @ np.linalg.lstsq(m[np.ix_(rest, rest)], m[rest, i], rcond=None)[0]) if rest else 0.0
        left = m[i, i] - fit
        out.append((columns[i], float(m[i, i] / left) if left > 1e-12 * max(1.0, m[i, i]) else None))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


def attribution(df: DataFrame, columns: list[str], state: str = "state") -> DataFrame:
    """Mean of each feature in each state, as deviations (over n) from its overall mean; flagged beyond 2."""
    rows = long(df, columns, [state]).where("x is not null")
    every = rows.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    got = rows.groupBy(state, "feature").agg(F.avg("x").alias("state_mean")).join(every, "feature")
    z = (F.col("state_mean") - F.col("m")) / (F.col("s") + F.lit(1e-10))
    return got.select(state, "feature", "state_mean", z.alias("z"), (F.abs(z) > 2).alias("flagged"))


def trend_stats(df: DataFrame, c: str, order: str, keys: tuple[str, ...] = (), bins: int = 50, tail: float = 0.2) -> DataFrame:
    """A series in equal bins of rows (the tail that fills none is cut): start, end and peak of the bins' means, slope
    over the last of them, noise (their mean deviation), slope over noise, status.

    Statuses, the first that holds: INSUFFICIENT_DATA (fewer rows than bins), EXPLODING (end above 10,000 or missing),
    STABLE (Noisy) (slope below twice the noise), RISING (Controlled) (upwards to less than 1.5 times the start),
    DIVERGING, CONVERGING.
    """
    d = numbered(df, keys, order).withColumnsRenamed({"rn": "__rn", "n": "__n"})
    size = F.floor(F.col("__n") / bins)
    counts = d.groupBy(*keys).agg(F.count("*").alias("n"))
    b = d.where(size > 0).withColumn("bin", F.floor(F.col("__rn") / F.when(size > 0, size)).cast("int")).where(F.col("bin") < bins)
    b = b.groupBy(*keys, "bin").agg(F.avg(c).alias("m"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("s"))
    recent = F.col("bin") >= bins - max(3, int(bins * tail))
    got = b.groupBy(*keys).agg(
        F.max(F.when(F.col("bin") == 0, F.col("m"))).alias("start"), F.max(F.when(F.col("bin") == bins - 1, F.col("m"))).alias("end"), F.max("m").alias("peak"),
        F.coalesce(F.regr_slope(F.when(recent, F.col("m")), F.col("bin").cast("double")), F.lit(0.0)).alias("slope"),
        F.coalesce(F.avg(F.when(recent, F.col("s"))), F.lit(0.0)).alias("noise"),
    )
    out = counts.join(got, list(keys), "left") if keys else counts.join(F.broadcast(got), how="cross")  # one row each
    snr = F.abs("slope") / (F.col("noise") + 1e-9)
    state = (
        F.when(F.col("n") < bins, "INSUFFICIENT_DATA").when(F.col("end").isNull() | (F.col("end") > 1e4), "EXPLODING").when(snr < 2, "STABLE (Noisy)")
        .when((F.col("slope") > 0) & (F.col("end") < 1.5 * F.coalesce("start", F.lit(0.0))), "RISING (Controlled)").when(F.col("slope") > 0, "DIVERGING").otherwise("CONVERGING")
    )
    return out.select(*keys, "n", "start", "end", "peak", "slope", "noise", snr.alias("snr"), state.alias("status"))


def resample(df: DataFrame, c: str, order: str, buckets: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A series in at most so many buckets of rows: mean value, and the order of the middle row."""
    d = numbered(df, keys, order).withColumnsRenamed({"rn": "__rn", "n": "__n"})
    size = F.greatest(F.ceil(F.col("__n") / buckets), F.lit(1))
    d = d.withColumns({"bucket": F.floor(F.col("__rn") / size).cast("int"), "__in": F.col("__rn") % size})
    mid = F.floor(F.least(size, F.col("__n") - F.col("bucket") * size) / 2)  # the last bucket may be shorter
    return d.groupBy(*keys, "bucket").agg(F.avg(c).alias("value"), F.max(F.when(F.col("__in") == mid, F.col(order))).alias("step"))


def sparkline(df: DataFrame, c: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One glyph of eight levels a row, in order; for short (resampled) series."""
    ends = Window.partitionBy(*keys)
    lo, hi = F.min(c).over(ends), F.max(c).over(ends)
    level = F.least(F.floor(F.coalesce(div((F.col(c) - lo) * 8, hi - lo), F.lit(0.0))), F.lit(7)).cast("int")
    d = df.where(F.col(c).isNotNull()).select(*keys, order, F.substring(F.lit(GLYPHS), level + 1, F.lit(1)).alias("g"))
    return d.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "g"))), lambda x: x["g"]), "").alias("sparkline"))


def classification(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1; 0 where undefined."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    got = df.agg(F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    safe = lambda x, y: F.coalesce(div(x, y), F.lit(0.0))
    got = got.withColumns({
        "accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return got.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def majority_gain(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy in points above always answering the commoner class, and what that says of the signal."""
    up = F.avg((F.col(actual) == 1).cast("double"))
    got = df.agg((100 * F.greatest(up, 1 - up)).alias("baseline_pct"), (100 * F.avg((F.col(predicted) == F.col(actual)).cast("double"))).alias("accuracy_pct"))
    gain = F.col("accuracy_pct") - F.col("baseline_pct")
    return got.withColumns({"gain": gain, "signal": F.when(gain > 2.0, "SIGNAL").when(gain > 0.5, "WEAK").otherwise("NONE")})


def class_weight(df: DataFrame, c: str) -> DataFrame:
    """Weight of the positive class: negatives over positives."""
    pos = F.sum(F.col(c).cast("double"))
    return df.agg(((F.count(c) - pos) / (pos + F.lit(1e-6))).alias("pos_weight"))


def reconstruction(df: DataFrame, feature: str = "feature", actual: str = "actual", rebuilt: str = "rebuilt", masked: str = "masked", k: int = 5) -> DataFrame:
    """Mean squared error of each feature where it was masked, and its rank from either side up to k."""
    got = df.where(F.col(masked)).groupBy(feature).agg(F.avg(F.pow(F.col(actual) - F.col(rebuilt), 2)).alias("mse"))
    best, worst = Window.orderBy("mse", feature), Window.orderBy(F.desc("mse"), feature)  # one row a feature
    got = got.withColumns({"best": F.row_number().over(best), "worst": F.row_number().over(worst)})
    return got.select(feature, "mse", F.when(F.col("best") <= k, F.col("best")).alias("best"), F.when(F.col("worst") <= k, F.col("worst")).alias("worst"))


def quantile_spread(df: DataFrame, quantiles: str, keys: tuple[str, ...] = (), other: str | None = None) -> DataFrame:
    """Mean distance of the 90 % and 10 % quantiles of an array column and its correlation with another column, flagged below 0.3."""
    q = F.col(quantiles)
    spread = F.get(q, F.floor(F.size(q) * 0.9).cast("int")) - F.get(q, F.floor(F.size(q) * 0.1).cast("int"))
    d = df.withColumn("__s", spread)
    if other is None:
        return d.groupBy(*keys).agg(F.avg("__s").alias("mean_spread"))
    return d.groupBy(*keys).agg(F.avg("__s").alias("mean_spread"), F.corr("__s", other).alias("corr")).withColumn("flagged", F.col("corr") < 0.3)


def seed_overlap(df: DataFrame, seed: str = "seed", row: str = "row", label: str = "label", stable: float = 0.8) -> DataFrame:
    """Share of rows on which two seeds agree, for each pair of seeds. Labels of a row are compared within the row; seeds are few."""
    arr = df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(seed, label))).alias("s"))
    pairs = arr.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x[seed] > F.col(f"a.{seed}"))).alias("b"))
    got = pairs.groupBy(F.col(f"a.{seed}").alias("a"), F.col(f"b.{seed}").alias("b")).agg(F.avg((F.col(f"a.{label}") == F.col(f"b.{label}")).cast("double")).alias("overlap"))
    return got.withColumn("stable", F.col("overlap") >= stable)


def probability_audit(df: DataFrame, probs: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Sums off 1, certain rows (above 0.99) and confused rows (all within 0.05 of uniform)."""
    n = len(probs)
    s = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
    top = F.greatest(*probs)
    confused = F.greatest(*[F.abs(F.col(p) - 1 / n) for p in probs]) <= 0.05
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.abs(s - 1) > tolerance).alias("sum_violations"), F.avg(s).alias("mean_sum"),
        (100 * F.avg((top > 0.99).cast("double"))).alias("certain_pct"), (100 * F.avg(confused.cast("double"))).alias("confused_pct"),
        *[f(p).alias(f"{p}_{k}") for p in probs for k, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )


def entropy_audit(df: DataFrame, c: str = "entropy") -> DataFrame:
    """Share of rows by level of entropy (very_high is part of high), and alerts."""
    share = lambda x: 100 * F.avg(x.cast("double"))
    e = F.col(c)
    got = df.where(e.isNotNull()).agg(
        F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"),
        share(e < 0.3).alias("low_pct"), share(e.between(0.3, 0.7)).alias("medium_pct"), share(e > 0.7).alias("high_pct"), share(e > 0.8).alias("very_high_pct"),
    )
    alert = F.when(F.col("mean") > 0.8, "CONFUSED").when(F.col("mean") < 0.05, "OVERCONFIDENT").otherwise("OK")
    return got.withColumn("alert", alert)


def environment_snapshot(steps: DataFrame, t: str = "t") -> DataFrame:
    """Across episodes at each step: mean value, largest drawdown, position and its spread, share in the market."""
    d = steps.withColumn("__dd", F.col("drawdown"))
    return d.groupBy(t).agg(
        F.avg("nav").alias("mean_nav"), F.max("__dd").alias("max_drawdown"), F.avg("position").alias("mean_position"), F.stddev_samp("position").alias("std_position"),
        F.avg((F.abs("position") > 0.1).cast("double")).alias("in_market"),
    )


def training_diagnostics(df: DataFrame, keys: tuple[str, ...] = (), action: str = "action", cost: str = "cost", gain: str = "gain") -> DataFrame:
    """Share of saturated actions, means, and churn: costs over absolute gains."""
    return df.groupBy(*keys).agg(
        F.avg((F.abs(action) > 0.95).cast("double")).alias("saturation"), F.avg(action).alias("mean_action"), F.avg(F.abs(action)).alias("mean_abs_action"),
        F.coalesce(div(F.sum(cost), F.sum(F.abs(gain))), F.lit(0.0)).alias("churn_ratio"),
    )


def row_entropy(df: DataFrame, probs: list[str]) -> DataFrame:
    return df.withColumn("entropy", entropy(F.array(*probs)))


def zip_by_position(a: DataFrame, b: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of two series with the same place, up to the shorter one."""
    n = lambda d: numbered(d, keys, order).drop("n").withColumnRenamed("rn", "__rn")
    right = n(b).drop(order)
    return n(a).join(right, [*keys, "__rn"]).drop("__rn")


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON, NaN and infinities as null."""
    safe = [F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))




def from_scalars(spark: SparkSession, rows: list[tuple[str, str, int, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "run string, tag string, step bigint, value double")
