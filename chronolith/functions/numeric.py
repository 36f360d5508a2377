"""Guarded scalar expressions: NULL instead of NaN, infinities or an ANSI error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ln(c: Column | str) -> Column:
    """Natural logarithm; NULL for what is not positive."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def sqrt(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 0, F.sqrt(c))


def div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Between low and high; NULL stays NULL (least and greatest would pass it over)."""
    c = col(c)
    out = c if low is None else F.greatest(c, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def argmax(probs: Column | str) -> Column:
    """Place of the largest element of an array, the first of equals, from 0."""
    probs = col(probs)
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def entropy(probs: Column | str, base: float | None = 2.0) -> Column:
    """Shannon entropy of an array that sums to 1 (after normalising), over log(n): 0 to 1; base None: nats, as it is."""
    probs = col(probs)
    p = F.transform(probs, lambda x: F.try_divide(x, total(probs)))
    nats = -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
    return nats if base is None else nats / F.ln(F.size(probs).cast("double"))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    s = F.transform(scores, lambda x: x / F.lit(float(temperature)))
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / total(e))


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.ln(total(F.transform(a, lambda x: F.exp(x - top))) + F.lit(1e-10))


def pop_std(a: Column) -> Column:
    """Standard deviation (over n) of an array."""
    n = F.size(a)
    mean = total(a) / n
    return F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)


def median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, ((n + 2) / 2).cast("int"))) / 2
