"""Regimes: states of rows, their runs and statistics, and a hidden-Markov model with mixture emissions.

The model is fitted per key (segment) by expectation-maximisation in numpy, one key a task, or over blocks of series of any length
(`fit_blocks`); its parameters are one row a key. Beliefs use past rows only (forward filter); smoothed ones are offered apart, as
they look ahead. Both are worked out over blocks.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import argmax, div
from ..functions.windows import BLOCK, BLOCK_ROWS, block_of, over, upto
from ..schema import TRADING_HOURS_A_YEAR
from .metrics import sharpe

TINY = 1e-10


# ---------------------------------------------------------------- states of rows


def dominant(probs: list[str]) -> Column:
    """Number of the most probable state, the first of equals."""
    return argmax(F.array(*probs))


def runs(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """One row a run of equal states: (keys, state, run, start, end, length)."""
    w = over(df, keys, (order,))
    new = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1))
    d = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(upto(w)))
    return d.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))


def run_lengths(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    return runs(df, state, keys, order).groupBy(*keys, state).agg(F.count("*").alias("runs"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"))


def transitions(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts", top: int | None = None) -> DataFrame:
    """Changes of state and how often each occurs; the `top` commonest, ties by the states' numbers."""
    d = df.withColumn("prev", F.lag(state).over(over(df, keys, (order,))))
    got = d.where(F.col("prev") != F.col(state)).groupBy("prev", F.col(state).alias("next")).agg(F.count("*").alias("n"))
    return got if top is None else got.orderBy(F.desc("n"), "prev", "next").limit(top)


def state_stats(df: DataFrame, ret: str = "ret", state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Rows, share, win rate, mean absolute and mean return, mean run length of each state."""
    total = Window.partitionBy(*keys)
    got = df.groupBy(*keys, state).agg(
        F.count("*").alias("n"), (100 * F.avg((F.col(ret) > 0).cast("double"))).alias("win_rate"), F.avg(F.abs(ret)).alias("mean_abs_ret"), F.avg(ret).alias("mean_ret"))
    got = got.withColumn("share_pct", 100 * div("n", F.sum("n").over(total)))
    return got.join(run_lengths(df, state, keys, order).select(*keys, state, "mean_length"), [*keys, state])


def describe(volatility: Column, win_rate: Column) -> Column:
    """A state in words: volatility below 0.05, below 0.15 or more; direction by the win rate (percent), 50 within 2."""
    v = F.when(volatility < 0.05, "Low volatility").when(volatility < 0.15, "Medium volatility").otherwise("High volatility")
    d = F.when(win_rate > 52, "bullish").when(win_rate < 48, "bearish").otherwise("neutral")
    return F.concat_ws(", ", v, d)


def fingerprint(df: DataFrame, ret: str = "ret", vol: str = "parkinson", state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Annual return, Sharpe, largest drawdown of the value within the state's own rows, mean volatility; two rows at least."""
    w = upto(Window.partitionBy(*keys, state).orderBy(order))
    d = df.withColumn("__nav", 10_000.0 * F.exp(F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(w)))
    d = d.withColumn("__dd", 1 - F.col("__nav") / F.max("__nav").over(w))
    return d.groupBy(*keys, state).agg(
        F.count("*").alias("n"), (F.avg(ret) * TRADING_HOURS_A_YEAR * 100).alias("annual_ret_pct"), sharpe(F.col(ret)).alias("sharpe"),
        (100 * F.max("__dd")).alias("max_dd_pct"), F.avg(vol).alias("mean_vol")).where(F.col("n") >= 2)


def performance(df: DataFrame, ret: str = "ret", state: str = "state", keys: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """Sharpe, win rate and mean return in each state of more than `least` rows."""
    got = df.groupBy(*keys, state).agg(F.count("*").alias("n"), sharpe(F.col(ret)).alias("sharpe"), (100 * F.avg((F.col(ret) > 0).cast("double"))).alias("win_rate"), F.avg(ret).alias("mean_ret"))
    return got.where(F.col("n") > least)


def quality(df: DataFrame, probs: list[str], ret: str = "ret", least: float = 0.05) -> DataFrame:
    """How many states hold `least` of the rows, how far apart their mean returns are (over n); valid from three states on."""
    d = df.withColumn("__s", dominant(probs)).groupBy("__s").agg(F.count("*").alias("n"), F.avg(ret).alias("m"))
    d = d.withColumn("__share", div("n", F.sum("n").over(Window.partitionBy())))  # one row a state
    active = F.col("__share") >= least
    got = d.agg(F.count_if(active).alias("active"), F.coalesce(F.stddev_pop(F.when(active, F.col("m"))), F.lit(0.0)).alias("separation"))
    return got.withColumn("valid", F.col("active") >= 3)


# ---------------------------------------------------------------- the model's parameters


def sticky(a: np.ndarray, penalty: float) -> np.ndarray:
    """Transition matrix drawn towards staying by `penalty`, at most a half; one with non-finite entries is replaced first."""
    k = len(a)
    if not np.isfinite(a).all():
        a = np.full((k, k), 0.3 / (k - 1))
        np.fill_diagonal(a, 0.7)
    p = min(penalty, 0.5)
    a = a * (1 - p) + p * np.eye(k)
    return a / a.sum(axis=1, keepdims=True)


def transition_diagnostics(a: np.ndarray) -> dict[str, float | str]:
    stay = float(np.diag(a).mean())
    spread = float(-(a * np.log(np.maximum(a, TINY))).sum(axis=1).mean())
    return {"mean_stay": stay, "mean_row_entropy": spread, "kind": "STICKY" if stay > 0.8 else "VOLATILE" if stay < 0.5 else "MODERATE"}


def transition_report(df: DataFrame, state: str = "state", keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """(keys, mean_stay, mean_row_entropy, kind) of each series' observed transitions: shares of the next state by the present one, averaged over
    the states that have a next row."""
    d = df.withColumn("__next", F.lead(state).over(over(df, keys, (order,)))).where("__next is not null")
    n = d.groupBy(*keys, state, "__next").agg(F.count("*").alias("__n"))
    p = F.col("__n") / F.sum("__n").over(Window.partitionBy(*keys, state))  # one row a pair of states
    rows = n.withColumn("__p", p).groupBy(*keys, state).agg(
        F.coalesce(F.sum(F.when(F.col(state) == F.col("__next"), F.col("__p"))), F.lit(0.0)).alias("stay"), F.sum(-F.col("__p") * F.ln("__p")).alias("e"))
    got = rows.groupBy(*keys).agg(F.avg("stay").alias("mean_stay"), F.avg("e").alias("mean_row_entropy"))
    return got.withColumn("kind", F.when(F.col("mean_stay") > 0.8, "STICKY").when(F.col("mean_stay") < 0.5, "VOLATILE").otherwise("MODERATE"))


def state_means(model: dict) -> np.ndarray:
    """Mean of each feature in each state, over its mixture."""
    return np.einsum("km,kmf->kf", model["weights"], model["means"])


def sorted_by(model: dict, feature: int) -> dict:
    """The model with its states in rising order of a feature's mean."""
    o = np.argsort(state_means(model)[:, feature], kind="stable")
    return {"start": model["start"][o], "trans": model["trans"][np.ix_(o, o)], "weights": model["weights"][o], "means": model["means"][o], "vars": model["vars"][o]}


def aligned(means: np.ndarray, archetypes: np.ndarray, weights: np.ndarray) -> tuple[int, ...]:
    """The order of states nearest to the archetypes by weighted squared distance; states are few, so all orders are tried."""
    cost = (weights * (means[:, None, :] - archetypes[None, :, :]) ** 2).sum(axis=2)
    return min(permutations(range(len(means))), key=lambda o: sum(cost[s, k] for k, s in enumerate(o)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis) + TINY)


def log_emissions(x: np.ndarray, model: dict) -> np.ndarray:
    """Log density of rows (n, f) in each state, a mixture of Gaussians with diagonal covariance."""
    v = model["vars"]
    parts = -0.5 * (np.log(2 * np.pi * v)[None] + (x[:, None, None, :] - model["means"][None]) ** 2 / v[None]).sum(axis=3)
    return _log_sum(np.log(model["weights"] + TINY)[None] + parts, axis=2)


def forward(logs: np.ndarray, model: dict) -> np.ndarray:
    """Beliefs (n, states) from rows up to each."""
    move, out = np.log(model["trans"] + TINY), np.empty_like(logs)
    a = np.log(model["start"] + TINY) + logs[0] if len(logs) else None
    for t in range(len(logs)):
        if t:
            a = _log_sum(a[:, None] + move, axis=0) + logs[t]
        a = a - _log_sum(a, axis=0)
        out[t] = np.exp(a)
    return out


def smoothed(logs: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Beliefs from all rows, expected numbers of moves, log likelihood (scaled forward-backward)."""
    n, k = logs.shape
    top = logs.max(axis=1)
    b = np.exp(logs - top[:, None])
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    for t in range(n):
        a = (model["start"] if t == 0 else alpha[t - 1] @ model["trans"]) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = model["trans"] @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    moves = model["trans"] * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return gamma, moves, float(np.log(scale).sum() + top.sum())


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Centres of the best of several runs, each started by distance-weighted draws."""
    best, least = None, np.inf
    for _ in range(tries):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack((c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]))
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
        if cost < least:
            best, least = c, cost
    return best


def fit_model(x: np.ndarray, states: int = 4, mixtures: int = 2, rounds: int = 200, tolerance: float = 1e-3, floor: float = 1e-2, tries: int = 3, seed: int = 42, penalty: float = 0.1) -> dict:
    """Expectation-maximisation from k-means centres; of several tries the one with most states in use (5 % of rows), then
    the likeliest. Fewer than 100 rows: ValueError."""
    if len(x) < 100:
        raise ValueError("fewer than 100 rows to fit a regime model to")
    best, rank = None, (-1, -np.inf)
    for k in range(tries):
        rng = np.random.default_rng(seed + 17 * k)
        c, spread = kmeans(x, states, rng), np.maximum(x.var(axis=0), floor)
        m = {
            "start": np.full(states, 1 / states), "trans": sticky(np.full((states, states), 1 / states), 0.5), "weights": np.full((states, mixtures), 1 / mixtures),
            "means": c[:, None, :] + rng.standard_normal((states, mixtures, x.shape[1])) * 0.1 * np.sqrt(spread), "vars": np.tile(spread, (states, mixtures, 1)),
        }
        before = -np.inf
        for _ in range(rounds):
            logs = log_emissions(x, m)
            gamma, moves, like = smoothed(logs, m)
            parts = np.log(m["weights"] + TINY)[None] - 0.5 * (np.log(2 * np.pi * m["vars"])[None] + (x[:, None, None, :] - m["means"][None]) ** 2 / m["vars"][None]).sum(axis=3)
            share = np.exp(parts - parts.max(axis=2, keepdims=True))
            share = gamma[:, :, None] * share / share.sum(axis=2, keepdims=True)
            total = share.sum(axis=0) + TINY
            means = np.einsum("nkm,nf->kmf", share, x) / total[..., None]
            varis = np.einsum("nkm,nkmf->kmf", share, (x[:, None, None, :] - means[None]) ** 2) / total[..., None]
            m = {"start": gamma[0] / gamma[0].sum(), "trans": (moves + TINY) / (moves + TINY).sum(axis=1, keepdims=True), "weights": total / total.sum(axis=1, keepdims=True), "means": means, "vars": np.maximum(varis, floor)}
            if like - before < tolerance:
                break
            before = like
        used = int((np.bincount(gamma.argmax(axis=1), minlength=states) >= 0.05 * len(x)).sum())
        if (used, like) > rank:
            best, rank = m, (used, like)
    best["trans"] = sticky(best["trans"], penalty)
    return best


PARAMETERS = "start array<double>, trans array<array<double>>, weights array<array<double>>, means array<array<array<double>>>, vars array<array<array<double>>>"


def fit(df: DataFrame, columns: list[str], keys: tuple[str, ...], order: str = "ts", sort_by: str | None = None, **options) -> DataFrame:
    """Parameters of one model a key, from its finite rows; a key with too few rows gets none."""
    place = columns.index(sort_by) if sort_by else 0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[columns].to_numpy(dtype=float)
        x = x[np.isfinite(x).all(axis=1)]
        if len(x) < 100:
            return pd.DataFrame(columns=[*keys, "start", "trans", "weights", "means", "vars"])
        m = sorted_by(fit_model(x, **options), place)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **{k: v.tolist() for k, v in m.items()}}])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, order, *columns).groupBy(*keys).applyInPandas(one, f"{types}, {PARAMETERS}")


# ---------------------------------------------------------------- beliefs, over blocks of a series
#
# A row moves a vector of beliefs by the transition matrix and then weighs it by the row's emissions, so a block of rows is one k x k
# matrix, scaled. Blocks' matrices, a small row each, are carried forwards (what is believed before a block) and backwards (what later rows say
# of its end); then every block is worked out from those two vectors. One long series is many tasks.

_MODEL = ("start", "trans", "weights", "means", "vars")


def _arrays(row) -> dict[str, np.ndarray] | None:
    """Model parameters of a row (of a frame, or a mapping) as arrays; None where it has none."""
    if row["start"] is None:
        return None
    deep = lambda v: np.array([deep(x) for x in v]) if hasattr(v, "__len__") else float(v)
    return {k: deep(row[k]) for k in _MODEL}


def block_matrix(emissions: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """diag(e_1) A diag(e_2) ... A diag(e_n), scaled to a largest entry of 1, by products of neighbours, then of those, and so on."""
    k = len(trans)
    m = trans[None] * emissions[:, None, :]
    m[0] = np.diag(emissions[0])
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate((np.matmul(m[: len(m) // 2 * 2 : 2], m[1::2]), odd))
        m /= np.maximum(m.max(axis=(1, 2), keepdims=True), 1e-300)
    return m[0].reshape(k, k)


def _scaled(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(axis=1)
    return np.exp(logs - top[:, None]), top


def filtered(logs: np.ndarray, model: dict, prior: np.ndarray) -> np.ndarray:
    """Beliefs (n, states) of rows in order, from the prior of the first."""
    move, out = np.log(model["trans"] + TINY), np.empty_like(logs)
    a = np.log(prior + TINY) + logs[0]
    for t in range(len(logs)):
        if t:
            a = _log_sum(a[:, None] + move, axis=0) + logs[t]
        a = a - _log_sum(a, axis=0)
        out[t] = np.exp(a)
    return out


def both_ways(logs: np.ndarray, model: dict, prior: np.ndarray, beyond: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Smoothed beliefs of a block, expected moves into its rows, and its share of the log likelihood. before: beliefs before the
    block, None for the series' first; beyond: what later rows say of its last row's state."""
    b, top = _scaled(logs)
    n, k = logs.shape
    alpha, beta, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
    for t in range(n):
        a = (prior if t == 0 else alpha[t - 1] @ model["trans"]) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    beta[-1] = beyond / max(float(alpha[-1] @ beyond), 1e-300)
    for t in range(n - 2, -1, -1):
        beta[t] = model["trans"] @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    later = b * beta / scale[:, None]
    moves = model["trans"] * (alpha[:-1].T @ later[1:])
    if before is not None:
        moves = moves + model["trans"] * np.outer(before, later[0])
    return gamma, moves, float(np.log(scale).sum() + top.sum())


def _in_blocks(df: DataFrame, model: DataFrame | dict, columns: list[str], keys: tuple[str, ...], order: str, size: int, work, schema: str, tiny: float) -> DataFrame:
    """work(rows in order, which are finite, their log emissions, model, prior, before, beyond) of every block; the vectors are None
    where the block has no finite row, all are None where the key has no model. tiny is added to the matrix."""
    by = [*keys, BLOCK]
    d = df.withColumn(BLOCK, block_of(df, order, size))
    kind = lambda c: d.schema[c].dataType.simpleString()
    blocks = d.groupBy(*by).agg(F.lit(1).alias("one")).drop("one")
    if isinstance(model, dict):
        fixed = {k: np.asarray(v, dtype=float).tolist() for k, v in model.items()}
        one = df.sparkSession.createDataFrame([tuple(fixed[k] for k in _MODEL)], PARAMETERS)
        blocks = blocks.join(F.broadcast(one), how="cross")  # one row
    else:
        m = model.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *_MODEL)
        met = F.lit(True)
        for k in keys:
            met = met & blocks[k].eqNullSafe(m[f"__k_{k}"])
        blocks = blocks.join(m, met, "left").drop(*[f"__k_{k}" for k in keys])

    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])  # columns of their own, apart from those of d

    def finite(pdf):
        x = pdf[columns].to_numpy(dtype=float)
        return np.isfinite(x).all(axis=1), x

    def matrix(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at) or not len(pdf):
            return at.assign(m=None).head(0)
        m, (good, x) = _arrays(at.iloc[0]), finite(pdf.sort_values(order, kind="stable"))
        made = None
        if m is not None and good.any():
            made = block_matrix(_scaled(log_emissions(x[good], m))[0], m["trans"] + tiny).ravel().tolist()
        return at.assign(m=[made])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK).reset_index(drop=True)
        m, n = _arrays(pdf.iloc[0]), len(pdf)
        prior, before, beyond = [None] * n, [None] * n, [None] * n
        if m is not None:
            k = len(m["start"])
            steps = [None if v is None else np.asarray(v, dtype=float).reshape(k, k) for v in pdf["m"]]
            belief = None
            for j, step in enumerate(steps):
                if step is not None:
                    p = m["start"] + tiny if belief is None else belief @ (m["trans"] + tiny)
                    prior[j], before[j] = (p / p.sum()).tolist(), None if belief is None else belief.tolist()
                    belief = p @ step
                    belief = belief / max(belief.sum(), 1e-300)
            end = np.ones(k)
            for j in range(n - 1, -1, -1):
                if steps[j] is not None:
                    beyond[j] = end.tolist()
                    end = (m["trans"] + tiny) @ (steps[j] @ end)
                    end = end / max(end.max(), 1e-300)
        return pdf.drop(columns="m").assign(prior=prior, before=before, beyond=beyond)

    def one_block(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        m, (good, x) = _arrays(at.iloc[0]), finite(pdf)
        vectors = [None if at[c].iloc[0] is None else np.asarray(at[c].iloc[0], dtype=float) for c in ("prior", "before", "beyond")]
        return work(pdf, good, x, log_emissions(x[good], m) if m is not None and good.any() else None, m, *vectors)

    types = ", ".join(f"`{k}` {kind(k)}" for k in by) + ", " + PARAMETERS
    slim = d.select(*dict.fromkeys([*by, order, *columns]))
    matrices = slim.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(matrix, f"{types}, m array<double>")
    carried = matrices.groupBy(*keys).applyInPandas(carry, f"{types}, prior array<double>, before array<double>, beyond array<double>")
    return d.groupBy(*by).cogroup(carried.groupBy(*by)).applyInPandas(one_block, schema)


def _beliefs(df: DataFrame, model: DataFrame | dict, columns: list[str], keys: tuple[str, ...], order: str, states: int, prefix: str, f, tiny: float, size: int) -> DataFrame:
    """Rows whose columns are all finite get beliefs, all others NULLs."""
    names, own = [f"{prefix}{k}" for k in range(states)] + [f"{prefix}entropy"], df.columns

    def work(pdf, good, x, logs, m, prior, before, beyond):
        out = np.full((len(pdf), states + 1), np.nan)
        if logs is not None:
            b = f(logs, m, prior, before, beyond)
            p = b / b.sum(axis=1, keepdims=True)
            out[good, :states] = b
            out[good, states] = -(p * np.log2(np.maximum(p, 1e-300))).sum(axis=1) / np.log2(states)
        for k, n in enumerate(names):
            pdf[n] = pd.Series(out[:, k]).astype(object).where(~np.isnan(out[:, k]), None)
        return pdf[[*own, *names]]

    schema = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields] + [f"`{n}` double" for n in names])
    return _in_blocks(df, model, columns, keys, order, size, work, schema, tiny)


def forward_filter(df: DataFrame, model: DataFrame | dict, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts", states: int = 4, size: int = BLOCK_ROWS) -> DataFrame:
    """df with hmm_prob_0.. and hmm_entropy (0 to 1): beliefs from past rows only."""
    f = lambda logs, m, prior, before, beyond: filtered(logs, m, prior)
    return _beliefs(df, model, columns, keys, order, states, "hmm_prob_", f, TINY, size).withColumnRenamed("hmm_prob_entropy", "hmm_entropy")


def smoothed_beliefs(df: DataFrame, model: DataFrame | dict, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts", states: int = 4, size: int = BLOCK_ROWS) -> DataFrame:
    """df with prob_0.. and prob_entropy from all rows: looks ahead, for training rows only."""
    f = lambda logs, m, prior, before, beyond: both_ways(logs, m, prior, beyond, before)[0]
    return _beliefs(df, model, columns, keys, order, states, "prob_", f, 0.0, size)


# ---------------------------------------------------------------- fitting over blocks

_SUMS = "first array<double>, moves array<double>, share array<double>, sums array<double>, squares array<double>, like double, n bigint"


def expectation(df: DataFrame, model: DataFrame | dict, columns: list[str], keys: tuple[str, ...] = ("asset",), order: str = "ts", size: int = BLOCK_ROWS) -> DataFrame:
    """One row a key: expected first state, moves, shares of mixture parts, sums of x and squares in them, log likelihood, rows: summed
    over the key's blocks. Squares are about the model's means, so that they don't cancel."""
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}

    def work(pdf, good, x, logs, m, prior, before, beyond):
        if logs is None:
            return pd.DataFrame(columns=[*keys, "first", "moves", "share", "sums", "squares", "like", "n"])
        x = x[good]
        gamma, moves, like = both_ways(logs, m, prior, beyond, before)
        parts = np.log(m["weights"] + TINY)[None] - 0.5 * (np.log(2 * np.pi * m["vars"])[None] + (x[:, None, None, :] - m["means"][None]) ** 2 / m["vars"][None]).sum(axis=3)
        share = np.exp(parts - parts.max(axis=2, keepdims=True))
        share = gamma[:, :, None] * share / share.sum(axis=2, keepdims=True)
        off = x[:, None, None, :] - m["means"][None]
        made = {
            "first": (gamma[0] if before is None else np.zeros_like(gamma[0])).tolist(), "moves": moves.ravel().tolist(), "share": share.sum(axis=0).ravel().tolist(),
            "sums": np.einsum("nkm,nkmf->kmf", share, off).ravel().tolist(), "squares": np.einsum("nkm,nkmf->kmf", share, off**2).ravel().tolist(), "like": like, "n": len(x),
        }
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **made}])

    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    each = _in_blocks(df, model, columns, keys, order, size, work, f"{schema}, {_SUMS}", 0.0)
    return each.groupBy(*keys).agg(*[_element_sums(c).alias(c) for c in ("first", "moves", "share", "sums", "squares")], F.sum("like").alias("like"), F.sum("n").alias("n"))


def _element_sums(c: str) -> Column:
    """Sums of arrays by place: a map-side aggregation of struct-free doubles is made of a few hundred places at most."""
    add = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    return F.aggregate(F.collect_list(c), F.lit(None).cast("array<double>"), add)


def maximization(sums: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("asset",), floor: float = 1e-2) -> DataFrame:
    """The next parameters of each key (with like and n) from its sums and the present ones; one small row a key."""
    kinds = ", ".join(f"`{k}` {model.schema[k].dataType.simpleString()}" for k in keys)

    def one(now: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(got) or not len(now):
            return now.assign(like=None, n=0).head(0)
        m, s = _arrays(now.iloc[0]), got.iloc[0]
        k, parts, f = m["means"].shape
        take = lambda c, shape: np.asarray(s[c], dtype=float).reshape(shape)
        total = take("share", (k, parts)) + TINY
        shift = take("sums", (k, parts, f)) / total[..., None]
        moves = take("moves", (k, k)) + TINY
        first = take("first", k)
        new = {
            "start": first / first.sum(), "trans": moves / moves.sum(axis=1, keepdims=True), "weights": total / total.sum(axis=1, keepdims=True), "means": m["means"] + shift,
            "vars": np.maximum(take("squares", (k, parts, f)) / total[..., None] - shift**2, floor),
        }
        return pd.DataFrame([{**{c: now[c].iloc[0] for c in keys}, **{c: v.tolist() for c, v in new.items()}, "like": float(s["like"]), "n": int(s["n"])}])

    return model.select(*keys, *_MODEL).groupBy(*keys).cogroup(sums.groupBy(*keys)).applyInPandas(one, f"{kinds}, {PARAMETERS}, like double, n bigint")


def fit_blocks(df: DataFrame, columns: list[str], start: DataFrame, keys: tuple[str, ...] = ("asset",), order: str = "ts", rounds: int = 200, tolerance: float = 1e-3, floor: float = 1e-2, size: int = BLOCK_ROWS) -> DataFrame:
    """Parameters (keys, start, trans, ..., like, n) by expectation-maximisation over blocks, all keys at once, from the parameters `start`.

    For series too long for one task: each round is one aggregation over all blocks; only parameters, one row a key, come to the
    driver between rounds, and rounds end when no key's likelihood rises by `tolerance` or more.
    """
    spark, now, before = df.sparkSession, start.select(*keys, *_MODEL), {}
    for _ in range(rounds):
        after = maximization(expectation(df, now, columns, keys, order, size), now, keys, floor)
        rows = after.collect()  # one small row a key
        now = spark.createDataFrame(rows, after.schema)
        likes = {tuple(r[k] for k in keys): r["like"] for r in rows}
        if all(like - before.get(k, -np.inf) < tolerance for k, like in likes.items()):
            break
        before = likes
    return now
