"""Frames that queries start from, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, sync
from ..runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.bars(events(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.panel(bars(spark, sf_dir))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with ret (log return, not clipped) and a state by its sign and size."""
    p = panel(spark, sf_dir)
    p = p.withColumn("ret", features.log_return(p, bound=None))
    return p.where("ret is not null").withColumn("state", (F.col("ret") > 0).cast("int") + 2 * (F.abs("ret") > 0.5).cast("int"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with three probabilities made of prices and their sum's parts."""
    p = panel(spark, sf_dir)
    t = F.col("open") + F.col("high") + F.col("close") + 0.001
    return p.withColumns({"p0": (F.col("open") + 0.001) / t, "p1": F.col("high") / t, "p2": F.col("close") / t})


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


BARS = """bars as (select event_type asset, date_trunc('hour', ts)::timestamp ts, arg_min(value, {'a': ts, 'b': event_id}) as open, max(value) high, min(value) low,
  arg_max(value, {'a': ts, 'b': event_id}) as close, count(*)::double volume from events group by 1, 2)"""
GRID = (
    BARS
    + """, hours as (select unnest(generate_series((select min(ts) from bars), (select max(ts) from bars), interval 1 hour)) ts),
grid as (select h.ts, a.asset, b.open, b.high, b.low, b.close, b.volume from hours h cross join (select distinct asset from bars) a left join bars b on b.ts = h.ts and b.asset = a.asset)"""
)
PANEL = (
    GRID
    + """, filled as (select asset, ts, last_value(open ignore nulls) over w as open, last_value(high ignore nulls) over w high, last_value(low ignore nulls) over w low,
  last_value(close ignore nulls) over w as close, last_value(volume ignore nulls) over w volume from grid window w as (partition by asset order by ts)),
panel as (select * from filled where open is not null)"""
)
LN = "case when {p} is null or {c} is null then null when {p} > 0 and {c} > 0 then ln({c} / {p}) else 0e0 end"
RETURNS = (
    PANEL
    + ", lagged as (select *, lag(close) over (partition by asset order by ts) p from panel), returned as (select asset, ts, open, high, low, close, volume, "
    + LN.format(p="p", c="close")
    + " ret from lagged), returns as (select *, (ret > 0)::int + 2 * (abs(ret) > 0.5e0)::int state from returned where ret is not null)"
)
PROBS = PANEL + """, probs as (select *, (open + 0.001e0) / t p0, high / t p1, close / t p2 from (select *, open + high + close + 0.001e0 t from panel))"""


