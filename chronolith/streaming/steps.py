"""The portfolio simulation as a stream: every new price values the step before it, row by row, from state that outlives restarts.

A key's state is the account (one struct), the row that waits for the next price, and the last rows of what rolling figures look
back on (a list of fixed length). An episode that gets no row for `idle` of event time is closed by a timer: its last values come
out once more, marked, and the next row begins a new episode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.portfolio import Account, Breaker, Rules
from ..runtime import ship

#: Values that the rolling volatility looks back on; turnover and downside deviation take one less.
HISTORY = 25
#: Spark's own name of the state store that this needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TELLS = (*Account.TELLS, "nav_vol", "turnover", "downside")


def rolling(history: list[tuple[float, float, float]]) -> tuple[float | None, float, float]:
    """(volatility of the value's log returns, turnover, downside deviation) of the last (value, change, return) rows."""
    navs = [h[0] for h in history]
    moves = np.diff(np.log(navs)) if min(navs) > 0 else np.zeros(0)
    last = history[1 - HISTORY :]
    changes, falls = [h[1] for h in last], [h[2] for h in last if h[2] < 0]
    return float(np.std(moves)) if len(moves) > 1 else None, float(np.mean(changes)) * (HISTORY - 1), float(np.std(falls)) if falls else 1e-8


class Steps(StatefulProcessor):
    def __init__(self, rules: Rules, breaker: Breaker | None, keys: tuple[str, ...], order: str, price: str, action: str, idle_ms: int | None, restart: bool):
        self.rules, self.breaker, self.idle_ms, self.restart = rules, breaker, idle_ms, restart
        self.keys, self.order, self.price, self.action = keys, order, price, action

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", ", ".join(f"{k} {v}" for k, v in Account.HOLDS.items()))
        self.waiting = handle.getValueState("waiting", "episode bigint, at bigint, price double, action double")
        self.history = handle.getListState("history", "nav double, change double, ret double")

    def _taken_up(self) -> tuple[Account | None, tuple | None, list[tuple[float, float, float]]]:
        if not self.waiting.exists():
            return None, None, []
        past = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        state = tuple(self.account.get()) if self.account.exists() else None
        return Account(self.rules, self.breaker, state, [h[0] for h in past]), tuple(self.waiting.get()), past

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        account, waiting, past = self._taken_up()
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for at, price, action in zip(pdf[self.order].astype("datetime64[us]").astype("int64"), pdf[self.price].to_numpy(dtype=float), pdf[self.action].fillna(0.0).to_numpy(dtype=float), strict=True):
            if waiting is not None and at <= waiting[1]:
                continue  # late, or repeated
            if waiting is None:
                account, waiting, past = Account(self.rules, self.breaker), (0, int(at), price, action), []
                continue
            if account.done:
                if not self.restart:
                    waiting = (waiting[0], int(at), waiting[2], waiting[3])
                    continue
                account, past, waiting = Account(self.rules, self.breaker), [], (waiting[0] + 1, int(at), price, action)
                continue
            held = account.held
            told = account.step(waiting[2], waiting[3], price)
            past = [*past, (told[0], abs(account.held - held), told[1])][-HISTORY:]
            out.append((*key, waiting[0], account.t - 1, waiting[1], "step", waiting[2], price, *told, *rolling(past)))
            waiting = (waiting[0], int(at), price, action)
        if waiting is not None:
            self.waiting.update(waiting)
            self.account.update(account.state)
            if past:
                self.history.put(past)
            elif self.history.exists():
                self.history.clear()
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(waiting[1] // 1000 + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        account, waiting, past = self._taken_up()
        out = []
        if waiting is not None:
            told = [None] * len(Account.TELLS)
            if past:
                told[0], told[1], told[2], told[6] = past[-1][0], past[-1][2], account.held, float(account.trades)
                told[4] = (account.peak - past[-1][0]) / account.peak
            out = [(*key, waiting[0], account.t, waiting[1], "closed", waiting[2], None, *told, *(rolling(past) if past else (None, None, None)))]
            for state in (self.waiting, self.account, self.history):
                state.clear()
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [*self.keys, "episode", "t", self.order, "event", "price", "next_price", *TELLS]
        out = pd.DataFrame(rows, columns=names)
        out[self.order] = pd.to_datetime(out[self.order].astype("int64"), unit="us")
        return out.astype({c: float for c in ("price", "next_price", *TELLS)} | {"episode": "int64", "t": "int64"})

    def close(self) -> None:
        pass


def steps(
    rows: DataFrame, rules: Rules = Rules(), keys: tuple[str, ...] = ("asset",), order: str = "ts", price: str = "close", action: str = "action",  # noqa: B008
    breaker: Breaker | None = None, idle: str | None = None, late: str = "0 seconds", restart: bool = False,
) -> DataFrame:
    """One row a step, as `portfolio.backtest` gives them, with episode, event (`step`, or `closed` by a timer) and rolling figures.

    Works on streams and on tables. Rows of a key that aren't after the last one taken are late, and dropped. Once broke, an episode ends; with
    `restart` the next row begins another in place. idle: event time (e.g. `12 hours`) after which an episode without rows is closed; it
    needs a time column, on which the watermark is put.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    if breaker and breaker.window != HISTORY:
        raise ValueError(f"the breaker of a stream looks back on {HISTORY} values")
    d = rows.select(*dict.fromkeys([*keys, order, price, action]))
    d = d.withColumn(order, d[order].cast("timestamp"))
    d = d.withWatermark(order, late) if idle else d
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["episode bigint, t bigint", f"`{order}` timestamp", "event string, price double, next_price double", *[f"{c} double" for c in TELLS]])
    processor = Steps(rules, breaker, tuple(keys), order, price, action, idle_ms, restart)
    return d.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime" if idle else "None")


def replayed(spark: SparkSession, source: str, target: str, state: str, schema: str, files: int | None = None, **how) -> None:
    """Runs `steps` over the parquet files of a folder as a stream, some at a time if `files` says so, until none is left; starts where it has stopped."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    q = steps(reader.parquet(source), **how).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(target)
    q.awaitTermination()
