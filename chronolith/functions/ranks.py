"""Exact order statistics of many columns at once, in bounded memory.

Mergeable rank sketches bracket each wanted rank; one pass counts what lies below the brackets, and only the values within them,
a few of ten thousand, equal ones as one row, are put in order to find the ranks themselves. Nothing holds all values of a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a sketch: ranks are off by one in so many at most.
ACCURACY = 10_000


def quantiles(rows: DataFrame, by: Sequence[str], probabilities: Sequence[float], x: str = "x", accuracy: int = ACCURACY) -> DataFrame:
    """(by, q): values at each probability, linear between neighbours as `percentile` takes them; NULLs don't count.

    A group without values has no row. by may be empty: one row, or none.
    """
    by, ps = list(by), [float(p) for p in probabilities]
    d = rows.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"))
    n = F.count("*").cast("double")
    around = [p + s * 2 / accuracy for p in ps for s in (-1, 1)]
    inside = [min(1.0, max(0.0, p)) for p in around]
    # two ranks of slack beside the sketch's error: neighbours are wanted too
    marks = d.groupBy(*by).agg(n.alias("__n"), F.percentile_approx("__x", F.array(*[F.lit(p) for p in inside]), accuracy).alias("__m"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    few = F.col("__n") <= accuracy  # all of a small group lies within its brackets
    low = [F.when(few | F.lit(around[2 * k] <= 0), F.col("__min")).otherwise(F.get("__m", F.lit(2 * k))) for k in range(len(ps))]
    high = [F.when(few | F.lit(around[2 * k + 1] >= 1), F.col("__max")).otherwise(F.get("__m", F.lit(2 * k + 1))) for k in range(len(ps))]
    marks = marks.select(*by, "__n", F.array(*low).alias("__low"), F.array(*high).alias("__high"))
    met = marks.withColumnsRenamed({k: f"__k_{k}" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    both = d.join(met, on) if by else d.join(F.broadcast(met), how="cross")  # one row
    # a value counts for the last bracket that it lies above, and is a candidate of those that it lies in
    at = F.filter(F.sequence(F.lit(0), F.lit(len(ps) - 1)), lambda k: (F.col("__x") >= F.get("__low", k)) & (F.col("__x") <= F.get("__high", k)))
    below = both.groupBy(*by).agg(F.array(*[F.count_if(F.col("__x") < F.get("__low", F.lit(k))) for k in range(len(ps))]).alias("__below"))
    near = both.select(*by, "__x", F.explode(at).alias("__p")).groupBy(*by, "__p", "__x").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    facts = marks.select(*[F.col(k).alias(f"__k_{k}") for k in by], "__n")
    under = below.select(*[F.col(k).alias(f"__b_{k}") for k in by], "__below")
    near = near.withColumn("__upto", upto)
    for side, mark in ((facts, "__k_"), (under, "__b_")):
        on = F.lit(True)
        for k in by:
            on = on & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
        near = near.join(side, on) if by else near.join(F.broadcast(side), how="cross")  # one row
    p = F.get(F.array(*[F.lit(v) for v in ps]), F.col("__p"))
    rank = p * (F.col("__n") - 1)
    seen = F.col("__upto") + F.get("__below", F.col("__p"))
    value = lambda place: F.min(F.when(seen > place, F.col("__x")))
    each = near.groupBy(*by, "__p").agg(value(F.floor(rank)).alias("a"), value(F.ceil(rank)).alias("b"), F.first(rank - F.floor(rank)).alias("f"))
    each = each.withColumn("v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("b")))
    q = F.transform(F.array_sort(F.collect_list(F.struct("__p", "v"))), lambda s: s["v"])
    return each.groupBy(*by).agg(q.alias("q")).where(F.size("q") > 0)
