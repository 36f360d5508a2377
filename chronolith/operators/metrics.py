"""Performance of return and value series, one row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div
from ..functions.windows import upto
from ..schema import HOURS_A_YEAR, TRADING_HOURS_A_YEAR


def sharpe(r: Column, periods: float = TRADING_HOURS_A_YEAR, risk_free: float = 0.0) -> Column:
    """Mean excess return over its standard deviation (over n), a year; 0 for fewer than two rows or no spread."""
    x = r - F.lit(risk_free / periods) if risk_free else r
    s = F.stddev_pop(x)
    return F.when((F.count(x) >= 2) & (s > 0), F.avg(x) / F.nullif(s, F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def sortino(r: Column, periods: float = TRADING_HOURS_A_YEAR) -> Column:
    """As sharpe, over the standard deviation of the negative returns, of which there must be two."""
    down = F.when(r < 0, r)
    s = F.stddev_pop(down)
    return F.when((F.count(down) >= 2) & (s > 0), F.avg(r) / F.nullif(s, F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def win_rate(r: Column) -> Column:
    return F.coalesce(F.avg((r > 0).cast("double")), F.lit(0.0))


def profit_factor(r: Column) -> Column:
    """Gains over losses; NULL (no bound) without losses, 0 without either."""
    gain, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    return F.when(loss > 0, F.try_divide(gain, loss)).when(gain == 0, 0.0)


def total_return(value: Column, ts: Column) -> Column:
    first = F.min_by(value, ts)
    return div(F.max_by(value, ts) - first, first)


def drawdown(df: DataFrame, value: str, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> Column:
    """Share of the peak so far that is lost."""
    peak = F.max(value).over(upto(Window.partitionBy(*keys).orderBy(order)))
    return div(peak - F.col(value), peak)


def max_drawdown(df: DataFrame, value: str, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Largest drawdown of each series."""
    d = df.withColumn("__dd", drawdown(df, value, keys, order))
    return d.groupBy(*keys).agg(F.max("__dd").alias("max_drawdown"))


def cumulative_value(df: DataFrame, log_ret: str, start: float = 10_000.0, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> Column:
    return F.lit(start) * F.exp(F.sum(F.coalesce(F.col(log_ret), F.lit(0.0))).over(upto(Window.partitionBy(*keys).orderBy(order))))


def evaluate_segment(steps: DataFrame, keys: tuple[str, ...] = ("segment",), periods: float = HOURS_A_YEAR) -> DataFrame:
    """steps (keys, ts, nav, ret, price, bench_ret, is_context): one row a segment.

    Context rows are skipped. sharpe, pnl_pct, max_dd_pct, trades (changes of `position`, if there), bench_pct,
    alpha_pct, market_regime (bull beyond +15 %, bear beyond -15 %), corr with the market (more than 10 rows).
    """
    d = steps.where(~F.coalesce(F.col("is_context"), F.lit(False)))
    d = d.withColumn("__dd", drawdown(d, "nav", keys))
    w = Window.partitionBy(*keys).orderBy("ts")
    d = d.withColumn("__trade", (F.col("position") != F.lag("position", 1, 0.0).over(w)).cast("long"))
    out = d.groupBy(*keys).agg(
        F.count("*").alias("rows"), sharpe(F.col("ret"), periods).alias("sharpe"), (100 * total_return(F.col("nav"), F.col("ts"))).alias("pnl_pct"),
        (100 * F.max("__dd")).alias("max_dd_pct"), F.sum("__trade").alias("trades"), (100 * total_return(F.col("price"), F.col("ts"))).alias("bench_pct"),
        F.when(F.count("*") > 10, F.corr("ret", "bench_ret")).alias("market_corr"),
    )
    regime = F.when(F.col("bench_pct") > 15, "BULLISH").when(F.col("bench_pct") < -15, "BEARISH").otherwise("RANGING")
    return out.withColumns({"alpha_pct": F.col("pnl_pct") - F.col("bench_pct"), "market_regime": regime})


def status(ok: Column, checkpoint: Column, ratio: Column, least: float = 0.30) -> Column:
    """SUCCESS, RECOVERED (stopped, but with a checkpoint and enough of the run done), FAILED."""
    return F.when(ok, "SUCCESS").when(checkpoint & (ratio >= least), "RECOVERED").otherwise("FAILED")


def summary(results: DataFrame) -> DataFrame:
    """Walk-forward means over segments that did not fall back, and counts of each status."""
    own = F.coalesce(F.col("strategy"), F.lit("")) != "fallback"
    return results.agg(
        F.count_if(own).alias("segments"), F.avg(F.when(own, F.col("sharpe"))).alias("mean_sharpe"), F.avg(F.when(own, F.col("pnl_pct"))).alias("mean_pnl_pct"),
        F.avg(F.when(own, F.col("max_dd_pct"))).alias("mean_max_dd_pct"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("SUCCESS", "RECOVERED", "FAILED")],
    )


def verdict(alpha: Column, sharpe_: Column, pnl: Column, entropy_: Column, saturation: Column, churn: Column) -> Column:
    """PASS, MIXED or FAIL of a segment; alpha and pnl in percent. A missing figure counts for nothing.

    Two faults, or one with alpha below -5, fail; two merits, or alpha above 5, pass. Bounds are fixed values.
    """
    count = lambda flags: sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    faults = count([entropy_ < -20, saturation > 0.98, churn > 0.3, alpha < -10, sharpe_ < -1, pnl < -20])
    merits = count([alpha > 0, sharpe_ > 1])
    return F.when((faults >= 2) | ((faults == 1) & (alpha < -5)), "FAIL").when((merits >= 2) | (alpha > 5), "PASS").otherwise("MIXED")


def fallback(df: DataFrame, strategy: str, keys: tuple[str, ...] = ("segment",)) -> DataFrame:
    """Results of a strategy that needs no model: flat (zeros) or buy_and_hold."""
    if strategy == "flat":
        return df.groupBy(*keys).agg(*[F.lit(0.0).alias(c) for c in ("sharpe", "pnl_pct", "max_dd_pct")])
    w = Window.partitionBy(*keys).orderBy("ts")
    d = df.withColumns({"__dd": drawdown(df, "close", keys), "__r": div("close", F.lag("close").over(w)) - 1})
    return d.groupBy(*keys).agg(sharpe(F.col("__r"), HOURS_A_YEAR).alias("sharpe"), (100 * total_return(F.col("close"), F.col("ts"))).alias("pnl_pct"), (100 * F.max("__dd")).alias("max_dd_pct"))
