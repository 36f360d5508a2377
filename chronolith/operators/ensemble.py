"""Aggregation of several models' actions, and the scaling that their disagreement and unfamiliar inputs call for.

Rows hold arrays: actions (one a member) and, for weighting by confidence, spreads. Everything is a projection.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, div, dot, median, pop_std, softmax, total
from ..functions.scans import recursion

METHODS = ("mean", "median", "confidence", "conservative", "pessimistic_bound")


@dataclass
class Config:
    """Defaults of the ensemble."""

    aggregation: str = "confidence"
    temperature: float = 1.0
    risk_aversion: float = 1.0
    pessimistic_scaling: bool = True
    least_scale: float = 0.1
    min_agreement: float = 0.0
    disagreement_action: float = 0.0
    confidence_epsilon: float = 1e-6
    ood_threshold: float = 2.5
    ood_warning: float = 1.5
    fallback_action: float = 0.0
    fallback_scale: float = 0.25
    ema_alpha: float = 0.01
    calibrate_spread: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def aggregate(actions: Column, spreads: Column | None = None, method: str = "mean", temperature: float = 1.0, risk_aversion: float = 1.0) -> Column:
    """One action of the members'. conservative: the one nearest to 0, the first of equals; pessimistic_bound: the mean,
    less so the more they differ; confidence: weighted by softmax of minus the spreads."""
    if method == "mean":
        return mean(actions)
    if method == "median":
        return median(actions)
    if method == "confidence":
        return dot(softmax(F.transform(spreads, lambda s: -s), temperature), actions)
    if method == "conservative":
        size = F.transform(actions, F.abs)
        return F.element_at(actions, F.array_position(size, F.array_min(size)).cast("int"))
    if method == "pessimistic_bound":
        return mean(actions) * clip(1 - F.lit(risk_aversion) * pop_std(actions), 0, 1)
    raise ValueError(f"unknown aggregation: {method}")


def pessimistic(action: Column, actions: Column, risk_aversion: float = 1.0, least: float = 0.1) -> Column:
    return action * clip(1 - F.lit(risk_aversion) * pop_std(actions), least, 1)


def agreement(actions: Column) -> Column:
    return clip(1 - pop_std(actions), 0, 1)


def gate(action: Column, ood: Column, threshold: float = 2.5, warning: float = 1.5, fallback: float = 0.0, scale: float = 0.25) -> dict[str, Column]:
    """Action and mode for how unfamiliar the input is."""
    return {
        "final_action": F.when(ood > threshold, F.lit(fallback)).when(ood > warning, action * scale).otherwise(action),
        "mode": F.when(ood > threshold, "OOD_FALLBACK").when(ood > warning, "OOD_WARNING").otherwise("NORMAL"),
    }


def quantile_spread(quantiles: Column, default: float = 0.1) -> Column:
    """Largest less smallest quantile of all critics; the default where there are none."""
    return F.coalesce(F.array_max(quantiles) - F.array_min(quantiles), F.lit(default))


def member_confidence(spread: Column) -> Column:
    return 1 / (spread + F.lit(1e-6))


def normalized_spreads(spreads: Column, ema: Column, epsilon: float = 1e-6) -> Column:
    """Spreads over their running mean; as they are where there is none yet."""
    return F.transform(spreads, lambda s: F.coalesce(div(s, ema + F.lit(epsilon)), s))


def running_spread(df: DataFrame, spreads: str, alpha: float = 0.01, keys: tuple[str, ...] = ("model",), order: str = "step", name: str = "spread_ema") -> DataFrame:
    """df with the running mean of the rows' mean spreads before each row: NULL in a key's first row, the first row's mean in the
    second, and from there moved by alpha towards each. Only earlier rows count; a recursion over blocks."""
    d = df.withColumn("__mean", mean(F.col(spreads)))

    def maps(r):
        return [(np.where(r["rn"] <= 1, 0.0, 1 - alpha), np.where(r["rn"] == 0, 0.0, np.where(r["rn"] == 1, 1.0, alpha) * np.nan_to_num(r["prev___mean"])))]

    return recursion(d, keys, order, ["__mean"], [name], [0.0], maps, lambda r, y: [np.where(r["rn"] == 0, np.nan, y[0])], ("__mean",)).drop("__mean")


def agreed(action: Column, actions: Column, least: float, otherwise: float = 0.0) -> Column:
    """The action where the members agree at least so far, else a fixed one; least 0: the action always."""
    return action if least <= 0 else F.when(agreement(actions) < least, F.lit(float(otherwise))).otherwise(action)


def predict(df: DataFrame, config: Config, actions: str = "actions", spreads: str = "spreads", ood: str | None = None, spread_ema: str | None = None, keys: tuple[str, ...] = ("model",), order: str = "step") -> DataFrame:
    """df with action, agreement, final_action and mode. spread_ema: the column that calibrates the spreads; without one, and with
    config.calibrate_spread, the running mean of each key's earlier rows does."""
    if config.calibrate_spread and spread_ema is None and config.aggregation == "confidence":
        made = predict(running_spread(df, spreads, config.ema_alpha, keys, order, "__spread_ema"), config, actions, spreads, ood, "__spread_ema")
        return made.drop("__spread_ema")
    a, s = F.col(actions), F.col(spreads) if config.aggregation == "confidence" else None
    if s is not None and spread_ema is not None:
        s = normalized_spreads(s, F.col(spread_ema), config.confidence_epsilon)
    act = aggregate(a, s, config.aggregation, config.temperature, config.risk_aversion)
    if config.pessimistic_scaling:
        act = pessimistic(act, a, config.risk_aversion, config.least_scale)
    act = agreed(act, a, config.min_agreement, config.disagreement_action)
    out = df.withColumns({"action": act, "agreement": agreement(a)})
    score = F.lit(0.0) if ood is None else F.col(ood)
    return out.withColumns(gate(F.col("action"), score, config.ood_threshold, config.ood_warning, config.fallback_action, config.fallback_scale))


def compare(results: DataFrame, kind: str = "kind", metric: str = "sharpe") -> DataFrame:
    """Ensemble against single runs: change of the mean, in percent, and reduction of the variance in percent."""
    pick = lambda f, k: f(F.when(F.col(kind) == k, F.col(metric)))
    got = results.agg(pick(F.avg, "single").alias("single_mean"), pick(F.avg, "ensemble").alias("ensemble_mean"), pick(F.var_pop, "single").alias("sv"), pick(F.var_pop, "ensemble").alias("ev"))
    delta = F.col("ensemble_mean") - F.col("single_mean")
    return got.select("single_mean", "ensemble_mean", delta.alias("delta"), (100 * div(delta, F.abs("single_mean"))).alias("delta_pct"), (100 * (1 - div("ev", "sv"))).alias("variance_reduction_pct"))
