"""Augmented Dickey-Fuller decisions by moment sums, and the least order of fractional differencing that passes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import BLOCK, LENT, blocked
from .features import ffd_weights


def critical(n: int) -> float:
    """5 % point of the test with a constant. MacKinnon's published response surface (2010), -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3."""
    return -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3


def _regress(s: dict[str, float], names: list[str]) -> tuple[float, float, float]:
    """t value of the first regressor, residual sum of squares, rows; s has sums of products 'a*b', '1' included."""
    get = lambda a, b: s.get(f"{a}*{b}", s.get(f"{b}*{a}"))
    x = np.array([[get(a, b) for b in names] for a in names])
    y = np.array([get(a, "d") for a in names])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    n, rss = s["1*1"], max(0.0, get("d", "d") - float(beta @ y))
    var = rss / max(1.0, n - len(names)) * np.linalg.pinv(x)[0, 0]
    return (float(beta[0] / np.sqrt(var)) if var > 0 else -np.inf), rss, n


def adf(df: DataFrame, c: str, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """(keys, n, tau, lags, stationary): with no or one lagged difference, the better by AIC; one aggregation a frame."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(c).isNotNull()).select(*keys, order, c)
    d = d.withColumn("l", F.lag(c).over(w)).withColumn("d", F.col(c) - F.col("l")).withColumn("m", F.lag("d").over(w)).where("m is not null").withColumn("1", F.lit(1.0))
    names = ["l", "1", "m", "d"]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = d.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])

    def decide(pdf):
        out = []
        for r in pdf.itertuples(index=False):
            row = r._asdict()
            s = {f"{a}*{b}": row[f"s{k}"] for k, (a, b) in enumerate(pairs)}
            best = None
            for regressors in (["l", "1"], ["l", "1", "m"]):
                tau, rss, n = _regress(s, regressors)
                aic = n * np.log(max(rss, 1e-300) / n) + 2 * len(regressors)
                if best is None or aic < best[0]:
                    best = (aic, tau, n, len(regressors) - 2)
            out.append({**{k: row[k] for k in keys}, "n": int(best[2]), "tau": best[1], "lags": best[3], "stationary": bool(best[1] < critical(int(best[2])))})
        import pandas as pd

        return pd.DataFrame(out, columns=[*keys, "n", "tau", "lags", "stationary"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(lambda it: map(decide, it), f"{types}, n bigint, tau double, lags int, stationary boolean")


def differences(df: DataFrame, orders: list[float], price: str = "close") -> DataFrame:
    """(asset, ts, tried, x): the fractional difference of each order, as `fracdiff` gives it, where its whole window has positive prices."""
    weights = [np.array(ffd_weights(o)) for o in orders]
    b = blocked(df.select("asset", "ts", F.col(price).cast("double").alias("__p")), 101)

    def convolved(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        p = pdf["__p"].to_numpy(dtype=float)
        x = np.log(np.where(p > 0, p, np.nan))
        own, out = ~pdf[LENT].to_numpy(dtype=bool), []
        for o, w in zip(orders, weights, strict=True):
            made = np.full(len(x), np.nan)
            if len(x) >= len(w):
                made[len(w) - 1 :] = np.convolve(x, w, "valid")
            keep = own & np.isfinite(made)
            out.append(pd.DataFrame({"asset": pdf["asset"][keep], "ts": pdf["ts"][keep], "tried": o, "x": made[keep]}))
        return pd.concat(out)

    kind = lambda c: df.schema[c].dataType.simpleString()
    return b.groupBy("asset", BLOCK).applyInPandas(convolved, f"asset {kind('asset')}, ts {kind('ts')}, tried double, x double")


def least_order(df: DataFrame, floor: float = 0.3, step: float = 0.05, price: str = "close", least: int = 100) -> DataFrame:
    """(asset, d): the least order, from `floor` to 1 by `step`, whose fractional difference is stationary; 1 if none or
    with fewer than `least` rows. Rows are shuffled once, and each block of them is convolved with all orders' weights."""
    orders = [round(floor + k * step, 10) for k in range(int(round((1 - floor) / step)) + 1)]
    rows = differences(df, orders, price)
    found = adf(rows, "x", ("asset", "tried")).where((F.col("n") >= least) & F.col("stationary")).groupBy("asset").agg(F.min("tried").alias("d"))
    return df.select("asset").distinct().join(found, "asset", "left").select("asset", F.coalesce("d", F.lit(1.0)).alias("d"))


def report(tests: DataFrame) -> DataFrame:
    return tests.withColumn("report", F.concat_ws(" ", "asset", F.when(F.col("stationary"), "STATIONARY").otherwise("NON-STATIONARY"), F.concat(F.lit("tau="), F.round("tau", 3).cast("string"))))


def isolation(df: DataFrame, f, rows: int, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts", digits: int = 9) -> DataFrame:
    """(keys, rows, changed): of each series' first rows, how many have other values in the columns that f makes when later rows aren't there:
    none, if f doesn't look ahead."""
    from .split import numbered

    head = numbered(df, keys, order).where(F.col("rn") < rows).drop("rn", "n")
    values = F.struct(*[F.round(c, digits).alias(c) for c in columns])
    by = [*keys, order]
    a = head.select(*by).join(f(df).select(*by, values.alias("a")), by, "left")
    b = f(head).select(*[F.col(c).alias(f"__{c}") for c in by], values.alias("b"))
    both = a.join(b, [F.col(c) == F.col(f"__{c}") for c in by], "full_outer")
    key = [F.coalesce(c, f"__{c}").alias(c) for c in keys]
    return both.select(*key, "a", "b").groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def prefix_invariant(df: DataFrame, f, rows: int, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts") -> bool:
    """Whether columns of the first rows are the same when later rows are not there: no look-ahead."""
    return isolation(df, f, rows, columns, keys, order).where("changed > 0").isEmpty()


def kpss(df: DataFrame, c: str, lags: int = 12, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """(keys, n, kpss, stationary): level stationarity by partial sums over a long-run variance with `lags` Bartlett
    weights. Fixed value: 0.463, the 5 % point of Kwiatkowski and others (1992)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(c).isNotNull()).select(*keys, order, F.col(c).alias("x"))
    means = d.groupBy(*keys).agg(F.avg("x").alias("m"))
    d = d.join(means, list(keys)).withColumn("e", F.col("x") - F.col("m"))
    d = d.withColumns({"s": F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)), **{f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)}})
    long = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0))
    n = F.count("*")
    got = d.groupBy(*keys).agg(n.alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), long.alias("v"))
    stat = F.try_divide(F.col("q"), F.col("n") * F.col("v"))
    return got.select(*keys, "n", stat.alias("kpss"), (stat < 0.463).alias("stationary"))
