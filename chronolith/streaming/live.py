"""Live variants over Structured Streaming: hourly bars, deduplication, running regime beliefs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.regime import TINY, log_emissions


def hourly_bars(events: DataFrame, late: str = "2 hours", asset: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Bars of a stream of events, complete once the watermark passes; slide gives overlapping windows."""
    at = F.struct(ts, tie)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    got = events.withWatermark(ts, late).groupBy(span.alias("w"), F.col(asset).alias("asset")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return got.select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest(events: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last row (by `tie`) of each key and time, once the watermark passes. State is one row a key and time within the watermark."""
    names = [c for c in events.columns if c != ts and c not in keys]
    got = events.withWatermark(ts, late).groupBy(ts, *keys).agg(F.max_by(F.struct(*names), tie).alias("row"))
    return got.select(*keys, ts, *[F.col("row").getField(c).alias(c) for c in names])


def sessions(events: DataFrame, gap: str = "3 hours", late: str = "2 hours", asset: str = "event_type", ts: str = "ts") -> DataFrame:
    """Spells of activity, ended by a gap."""
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), F.col(asset).alias("asset")).agg(F.count("*").alias("n"))
    return got.select("asset", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def beliefs(rows: DataFrame, model: dict, columns: list[str], states: int = 4, asset: str = "asset", ts: str = "ts") -> DataFrame:
    """Running beliefs of each asset; the state is the last belief and its time. Rows not after that time are late, and dropped."""
    m = {k: np.asarray(v, dtype=float) for k, v in model.items()}
    move = np.log(m["trans"] + TINY)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, belief = (state.get[0], np.array(state.get[1])) if state.exists else (None, None)
        out = []
        pdf = pd.concat(list(batches)).sort_values(ts)
        for t, x in zip(pdf[ts], pdf[columns].to_numpy(dtype=float), strict=True):
            if (last is not None and t.value <= last) or not np.isfinite(x).all():
                continue
            e = log_emissions(x[None], m)[0]
            a = e + (np.log(m["start"] + TINY) if belief is None else np.log(np.exp(np.log(belief + TINY)[:, None] + move).sum(axis=0) + TINY))
            belief = np.exp(a - a.max())
            belief /= belief.sum()
            last = t.value
            out.append((key[0], t, *belief))
        if last is not None:
            state.update((last, belief.tolist()))
        yield pd.DataFrame(out, columns=[asset, ts, *[f"hmm_prob_{k}" for k in range(states)]])

    schema = f"{asset} string, {ts} timestamp, " + ", ".join(f"hmm_prob_{k} double" for k in range(states))
    return rows.select(asset, ts, *columns).groupBy(asset).applyInPandasWithState(step, schema, "last bigint, belief array<double>", "append", GroupStateTimeout.NoTimeout)
