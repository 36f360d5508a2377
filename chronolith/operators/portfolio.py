"""Position simulation: one fold per episode, in the order of its rows. Rewards and schedules beside it.

A step: clip the action; scale it by volatility; round it to the grid; trade only if the target changes; pay costs on
what is traded; pay funding on shorts; take the next price; value, return, peak, drawdown; update the variance; reward.
A target that is held is not traded back as the price drifts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..functions.scans import recursion
from .split import numbered

START = 10_000.0


@dataclass(frozen=True)
class Rules:
    """Defaults of the simulation."""

    commission: float = 0.0006
    slippage: float = 0.0001
    funding: float = 0.0
    grid: float = 0.1
    target_vol: float = 0.05
    vol_window: int = 24
    leverage: float = 5.0
    reward_scale: float = 1.0
    w_cost: float = 0.0
    anneal: float = 1.0
    inaction_below: float = 0.05
    inaction_penalty: float = 0.01
    regret: bool = True
    warm_up: int = 200
    eta: float = 0.02


@dataclass(frozen=True)
class Breaker:
    """Forces a flat position for `cooldown` steps once volatility or drawdown is beyond bounds."""

    baseline_vol: float
    vol_times: float = 3.0
    max_drawdown: float = 0.2
    cooldown: int = 12
    window: int = 25


class Sharpener:
    """Differential Sharpe ratio of a stream; a reward uses the moments before its own update."""

    def __init__(self, eta: float, warm_up: int, floor: float):
        self.a, self.b, self.eta, self.warm_up, self.floor = 0.0, 1e-6, eta, warm_up, floor

    def reward(self, x: float, age: int) -> float:
        da, db = x - self.a, x * x - self.b
        if age < self.warm_up:
            out = 10 * math.log1p(max(x, self.floor))
        else:
            out = min(5.0, max(-5.0, 10 * (self.b * da - 0.5 * self.a * db) / max(self.b - self.a**2, 1e-8) ** 1.5))
        self.a += self.eta * da
        self.b += self.eta * db
        return out


class Account:
    """One episode's running values; `step` takes it a row further. What it holds can be stored between rows (`state`) and taken up again."""

    #: What a step tells, in order.
    TELLS = ("nav", "ret", "position", "cost", "drawdown", "reward", "trades", "alpha_ema", "panic")
    #: What is held between steps, with its type in SQL.
    HOLDS = {
        "t": "bigint", "cash": "double", "units": "double", "held": "double", "peak": "double", "var": "double", "mean": "double", "square": "double", "wait": "bigint", "trades": "bigint", "ema": "double", "done": "boolean",
    }

    def __init__(self, rules: Rules, breaker: Breaker | None = None, state: tuple | None = None, navs: list[float] | None = None):
        """navs: the last values, for the breaker: as many as its window at most."""
        self.rules, self.breaker, self.navs = rules, breaker, list(navs or [])
        self.sharpener = Sharpener(rules.eta, rules.warm_up, -0.9 if rules.regret else -0.99)
        self.alpha, self.floor = 2 / (rules.vol_window + 1), rules.target_vol / rules.leverage
        self.rate = (rules.commission + rules.slippage) * rules.anneal
        if state is None:
            state = (0, START, 0.0, 0.0, START, rules.target_vol**2, self.sharpener.a, self.sharpener.b, 0, 0, 0.0, False)
        (self.t, self.cash, self.units, self.held, self.peak, self.var, self.sharpener.a, self.sharpener.b, self.wait, self.trades, self.ema, self.done) = state

    @property
    def state(self) -> tuple:
        return (self.t, float(self.cash), float(self.units), float(self.held), float(self.peak), float(self.var), float(self.sharpener.a), float(self.sharpener.b), self.wait, self.trades, float(self.ema), bool(self.done))

    def step(self, p: float, action: float, following: float) -> tuple[float, ...]:
        """Acts at price p and is valued at the following one."""
        rules = self.rules
        raw = min(1.0, max(-1.0, float(action))) if self.wait == 0 else 0.0
        self.wait = max(0, self.wait - 1)
        nav = self.cash + self.units * p
        scale = min(rules.leverage, max(0.1, rules.target_vol / max(math.sqrt(self.var), self.floor)))
        target = min(1.0, max(-1.0, raw * scale))
        if rules.grid > 0:
            target = min(1.0, max(-1.0, round(target / rules.grid) * rules.grid))  # halves to even
        delta, cost = abs(target - self.held), 0.0
        if target != self.held:
            new = nav * target / p
            cost = abs(new - self.units) * p * self.rate
            self.cash -= (new - self.units) * p + cost
            self.units, self.held, self.trades = new, target, self.trades + 1
        if self.units < 0 and rules.funding > 0:
            self.cash -= abs(self.units) * p * rules.funding
        nav_new = self.cash + self.units * following
        ret = (nav_new - nav) / max(nav, 1e-8)
        self.peak = max(self.peak, nav_new)
        self.var = self.alpha * ret * ret + (1 - self.alpha) * self.var
        bench = (following - p) / max(p, 1e-8)
        gain = self.sharpener.reward(ret - bench if rules.regret else ret, self.t)
        idle = -rules.inaction_penalty if rules.regret and abs(self.held) < rules.inaction_below else 0.0
        churn = min(0.0, max(-0.1, -10 * delta * rules.anneal))
        reward = (gain + idle) * rules.reward_scale + rules.w_cost * churn * 0.05
        self.done = nav_new <= 0
        self.ema = (1 - rules.eta) * self.ema + rules.eta * (ret - bench)
        breaker = self.breaker
        if breaker:
            self.navs = [*self.navs, nav_new][-breaker.window :]
            moves = np.diff(np.log(self.navs)) if min(self.navs) > 0 else np.zeros(0)
            vol = float(np.std(moves)) if len(moves) > 1 else 0.0
            if self.wait == 0 and (vol > breaker.baseline_vol * breaker.vol_times or (self.peak - nav_new) / self.peak > breaker.max_drawdown):
                self.wait = breaker.cooldown
        self.t += 1
        return nav_new, ret, self.held, cost, (self.peak - nav_new) / self.peak, -1.0 if self.done else reward, float(self.trades), self.ema, float(self.wait > 0)


def sharpe_rewards(df: DataFrame, ret: str, eta: float = 0.02, warm_up: int = 200, floor: float = -0.9, keys: tuple[str, ...] = ("asset",), order: str = "ts", name: str = "reward") -> DataFrame:
    """df with the differential Sharpe reward of each row's return; floor: -0.9 for returns above a benchmark, -0.99 for plain ones.
    The moments are recursions over blocks; a reward takes those before its own row."""
    x = lambda r: np.nan_to_num(r[ret])

    def finish(r, y):
        a, b = ((m - eta * v) / (1 - eta) for m, v in zip(y, (x(r), x(r) ** 2), strict=True))
        late = 10 * (b * (x(r) - a) - 0.5 * a * (x(r) ** 2 - b)) / np.maximum(b - a * a, 1e-8) ** 1.5
        return [np.where(r["rn"] < warm_up, 10 * np.log1p(np.maximum(x(r), floor)), np.clip(late, -5, 5))]

    maps = lambda r: [(np.full(len(r["rn"]), 1 - eta), eta * x(r)), (np.full(len(r["rn"]), 1 - eta), eta * x(r) ** 2)]
    return recursion(df, keys, order, [ret], [name], [0.0, 1e-6], maps, finish)


def simulate(price: np.ndarray, action: np.ndarray, rules: Rules, breaker: Breaker | None = None) -> dict[str, list[float]]:
    """Steps 0 to len(price) - 2: the action at a row acts at its price and is valued at the next. Ends early when broke."""
    account, told = Account(rules, breaker), []
    for t in range(len(price) - 1):
        if account.done:
            break
        told.append(account.step(price[t], action[t], price[t + 1]))
    return {k: [row[j] for row in told] for j, k in enumerate(Account.TELLS)}


def backtest(df: DataFrame, rules: Rules = Rules(), keys: tuple[str, ...] = ("asset",), order: str = "ts", price: str = "close", action: str = "action", breaker: Breaker | None = None) -> DataFrame:  # noqa: B008
    """One row a step of each episode (keys): t, ts, price, next value, return, position, cost, drawdown, reward, and so on."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = Account.TELLS

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        got = simulate(pdf[price].to_numpy(dtype=float), pdf[action].fillna(0.0).to_numpy(dtype=float), rules, breaker)
        n = len(got["nav"])
        out = pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "t": range(n), order: pdf[order].iloc[:n], "price": pdf[price].iloc[:n], "next_price": pdf[price].iloc[1 : n + 1].to_numpy(), **got})
        return out

    schema = f"{types}, t bigint, `{order}` {df.schema[order].dataType.simpleString()}, price double, next_price double, " + ", ".join(f"{n} double" for n in names)
    return df.select(*dict.fromkeys([*keys, order, price, action])).groupBy(*keys).applyInPandas(one, schema)


def episodes(df: DataFrame, starts: DataFrame, length: int, keys: tuple[str, ...] = ("asset",), order: str = "ts") -> DataFrame:
    """Rows of each episode (asset, episode, start): `length` + 1 rows from a start by number; rows of several are repeated."""
    d = numbered(df, keys, order).drop("n")
    s = starts.withColumn("rn", F.explode(F.sequence(F.col("start"), F.col("start") + length)))
    return d.join(s.select(*keys, "episode", "rn"), [*keys, "rn"])


def lanes(df: DataFrame, starts: DataFrame, length: int, steps: int, rules: Rules = Rules(), keys: tuple[str, ...] = ("asset",), order: str = "ts", action: str = "action", breaker: Breaker | None = None) -> DataFrame:  # noqa: B008
    """The log of lanes that restart in place: (keys, lane, step) with the episode it belongs to and what `backtest` gives.

    starts: (keys, lane, episode, start), a lane's episodes in order and the row number each starts at. A lane plays an episode for
    `length` steps, or until broke or out of rows, and then takes its next one, `steps` steps in all. Episodes don't depend on one another, so
    each is a task's work of its own; when a lane comes to it follows from the lengths of those before, one small row each.
    """
    from pyspark.sql import Window

    by = [*keys, "lane", "episode"]
    d = numbered(df, keys, order).drop("n")
    rows = starts.select(*by, F.explode(F.sequence("start", F.col("start") + length)).alias("rn")).join(d, [*keys, "rn"]).drop("rn")
    played = backtest(rows, rules, tuple(by), order, action=action, breaker=breaker)
    sizes = played.groupBy(*by).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys, "lane").orderBy("episode").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = played.join(sizes, by).withColumn("step", F.col("__before") + F.col("t")).where(F.col("step") < steps)
    return out.drop("__before")


def buy_and_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.lit(1.0))


def oracle(df: DataFrame, price: str = "close") -> DataFrame:
    """The sign of the next return: an upper bound, not a strategy."""
    from ..functions.windows import over

    nxt = F.lead(price).over(over(df))
    return df.withColumn("action", F.coalesce(F.signum(nxt - F.col(price)), F.lit(0.0)))


def episode_end(steps: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Terminal record of each episode: value, reward, length, trades."""
    last = F.max_by(F.struct("nav", "position", "trades"), "t")
    got = steps.groupBy(*keys).agg(last.alias("l"), F.sum("reward").alias("episode_reward"), F.count("*").alias("episode_length"), F.max("drawdown").alias("max_drawdown"))
    return got.select(*keys, F.col("l.nav").alias("final_nav"), F.col("l.position").alias("final_position"), F.col("l.trades").alias("trades"), "episode_reward", "episode_length", "max_drawdown")


def reward_parts(steps: DataFrame, rules: Rules, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """steps with what their reward is made of: gain (differential Sharpe), idle and churn."""
    from pyspark.sql import Window

    bench = (F.col("next_price") - F.col("price")) / F.greatest("price", F.lit(1e-8))
    d = steps.withColumn("__x", F.col("ret") - bench if rules.regret else F.col("ret"))
    d = sharpe_rewards(d, "__x", rules.eta, rules.warm_up, -0.9 if rules.regret else -0.99, keys, "t", "gain").drop("__x")
    before = F.lag("position", 1, 0.0).over(Window.partitionBy(*keys).orderBy("t"))
    idle = F.when(F.abs("position") < rules.inaction_below, -rules.inaction_penalty).otherwise(0.0) if rules.regret else F.lit(0.0)
    return d.withColumns({"idle": idle, "churn": F.least(F.lit(0.0), F.greatest(F.lit(-0.1), -10 * F.abs(F.col("position") - before) * rules.anneal))})


def breaker_stats(steps: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Steps spent in cooldown and how often one began."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("t")
    d = steps.withColumn("__on", ((F.col("panic") > 0) & (F.lag("panic", 1, 0.0).over(w) == 0)).cast("long"))
    return d.groupBy(*keys).agg(F.sum("__on").alias("triggers"), F.count_if(F.col("panic") > 0).alias("panic_steps"), (F.sum("__on") / F.greatest(F.count("*"), F.lit(1))).alias("trigger_rate"))


def nav(cash: Column, units: Column, price: Column) -> Column:
    return cash + units * price


# ---------------------------------------------------------------- rewards and schedules


def lexicographic_reward(ret: Column, sortino: Column, position: Column, change: Column, turnover: Column, w_ret: float = 1.0, w_sortino: float = 0.5, w_idle: float = 0.1, cost_base: float = 0.1, cost_slope: float = 0.1) -> Column:
    """Return and Sortino parts, less the squared position, less changes weighed by the turnover so far."""
    return w_ret * ret + w_sortino * sortino - w_idle * position * position - (F.lit(cost_base) + F.lit(cost_slope) * turnover) * F.abs(change)


def curriculum(progress: Column, start: float = 0.15, end: float = 0.75, top: float = 0.4) -> Column:
    """0 until start, `top` from end on, linear between."""
    return clip((progress - start) / (end - start), 0, 1) * top


def cost_anneal(progress: Column, ratio: float) -> Column:
    return F.least(F.lit(1.0), progress / ratio) if ratio > 0 else F.lit(1.0)


def noise_scale(noise: float, progress: Column, vol: Column, target: float = 0.05) -> Column:
    """Deviation of observation noise: less as training goes on, more when markets are quiet."""
    return noise * (1 - 0.5 * progress) * clip(target / F.greatest(vol, F.lit(1e-8)), 0.5, 2.0)


def preference(fixed: float | None, progress: Column) -> Column:
    """Weight of costs: a fixed one if given, else the curriculum's."""
    return F.lit(fixed) if fixed is not None else curriculum(progress)


def guard(df: DataFrame, signals: list[str], patience: int = 3, keys: tuple[str, ...] = ("run",), order: str = "step") -> DataFrame:
    """Rows with, for each boolean signal, how many checks in a row it has held, and whether to stop: one held `patience`
    times, or two hold at once. Runs are gaps and islands: no fold is needed."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for s in signals:
        out = out.withColumn("__g", F.sum((~F.col(s)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        run = F.sum(F.col(s).cast("int")).over(Window.partitionBy(*keys, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"{s}_run", run).drop("__g")
    now = sum((F.col(s).cast("int") for s in signals), F.lit(0))
    return out.withColumn("stop", (F.greatest(*[F.col(f"{s}_run") for s in signals], F.lit(0)) >= patience) | (now >= 2))
