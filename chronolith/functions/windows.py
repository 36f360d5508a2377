"""Ordered windows per asset, also over blocks of time so that one long series is many tasks.

`blocked` deals the rows of a complete hourly grid to (asset, block) and gives each block the `lookback` rows before
it. Windows that look back no further are exact within a block, so a series of any length is worked on in parallel,
with one shuffle of 1 + lookback / size of the rows. `unblocked` drops the rows lent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Hours of a block; halos of the default lookbacks (up to 720 rows) add a tenth.
BLOCK_HOURS = 8192
BLOCK, LENT = "__block", "__lent"
#: Rows of a block where the order is a number, hours where it is a time.
BLOCK_ROWS = 8192


def hour_index(ts: str = "ts") -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)


def blocked(df: DataFrame, lookback: int, size: int = BLOCK_HOURS, ts: str = "ts") -> DataFrame:
    own = F.floor(hour_index(ts) / size)
    upto = F.floor((hour_index(ts) + lookback) / size)
    df = df.withColumn("__own", own).withColumn(BLOCK, F.explode(F.sequence(own, upto)))
    return df.withColumn(LENT, F.col(BLOCK) != F.col("__own")).drop("__own")


def unblocked(df: DataFrame) -> DataFrame:
    return df.where(~F.col(LENT)).drop(BLOCK, LENT)


def block_of(df: DataFrame, order: str, size: int = BLOCK_ROWS) -> Column:
    """Number of the block that a row lies in, rising with the order column: a time or a number; orders of other types have one block."""
    kind = df.schema[order].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(hour_index(order) / size)
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.floor(F.col(order) / size).cast("long")
    return F.lit(0).cast("long")


def dealt(df: DataFrame, keys: Sequence[str] = ("asset",), order: str = "ts", size: int = BLOCK_ROWS, previous: Sequence[str] = (), anchors: Sequence[str] = ()) -> DataFrame:
    """df with its block, __rn (the row's number in its series, from 0), __n (rows of the series), __first (number of the first row whose anchors
    all have values) and __prev_c (the value of c in the row before) for each column of `previous`.

    Rows are numbered within their block; what a block adds to later ones is one small row, and only those are taken in order.
    """
    keys = list(keys)
    d = df.withColumn(BLOCK, block_of(df, order, size))
    w = Window.partitionBy(*keys, BLOCK).orderBy(order)
    d = d.withColumns({"__in": F.row_number().over(w) - 1, **{f"__prev_{c}": F.lag(c).over(w) for c in previous}})
    has = F.lit(True)
    for c in anchors:
        has = has & F.col(c).isNotNull() & (~F.isnan(c) if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(True))
    blocks = d.groupBy(*keys, BLOCK).agg(
        F.count("*").alias("__rows"), F.min(F.when(has, F.col("__in"))).alias("__head"), *[F.max_by(c, F.struct("__in")).alias(f"__last_{c}") for c in previous]
    )
    all_ = Window.partitionBy(*keys)
    after = all_.orderBy(BLOCK)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__rows").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumns({"__n": F.sum("__rows").over(all_), "__first": F.min(F.col("__before") + F.col("__head")).over(all_), **{f"__last_{c}": F.lag(f"__last_{c}").over(after) for c in previous}})
    blocks = blocks.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, BLOCK]})
    met = F.lit(True)
    for k in [*keys, BLOCK]:
        met = met & d[k].eqNullSafe(F.col(f"__k_{k}"))
    d = d.join(blocks, met)
    d = d.withColumns({"__rn": F.col("__before") + F.col("__in"), **{f"__prev_{c}": F.when(F.col("__in") > 0, F.col(f"__prev_{c}")).otherwise(F.col(f"__last_{c}")) for c in previous}})
    return d.select(*df.columns, BLOCK, "__rn", "__n", "__first", *[f"__prev_{c}" for c in previous])


def over(df: DataFrame, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",)) -> WindowSpec:
    """The window of an ordered series; within blocks if df has been dealt to blocks."""
    keys = [*keys, BLOCK] if BLOCK in df.columns else list(keys)
    return Window.partitionBy(*keys).orderBy(*order)


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(1 - n, 0)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, NULL until `least` of them (n by default) are not NULL."""
    return F.when(F.count(c).over(rows(w, n)) >= (n if least is None else least), agg(c).over(rows(w, n)))


def fill_forward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("asset",), ts: str = "ts", size: int = BLOCK_HOURS) -> DataFrame:
    """Each NULL takes the last value before it. Blocks of time are filled in parallel; only the last values of the
    blocks, one row an asset and block, are carried on in order."""
    df = df.withColumn(BLOCK, F.floor(hour_index(ts) / size))
    last = df.groupBy(*keys, BLOCK).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"__{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, BLOCK, *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    own = upto(Window.partitionBy(*keys, BLOCK).orderBy(ts))
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in columns})
    df = df.join(last, [*keys, BLOCK], "left")
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(BLOCK, *[f"__{c}" for c in columns])


def fill_backward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """Each NULL takes the next value after it. Looks ahead: only for heads of series, after fill_forward.

    In falling order the next value is the last one seen: such a frame takes one step a row, one that ends with the series a pass.
    """
    w = upto(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return df.withColumns({c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(w)) for c in columns})
