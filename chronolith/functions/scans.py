"""Recursions over blocks of a series, so that one long series is many tasks.

A step of a recursion is an affine map y -> a y + b, and maps compose. Each block of time gives one map, made of its rows; the maps
of a series' blocks, one small row each, are carried in order; then every block is worked out from the value that it starts with.
Both passes over the rows are grouped by series and block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .windows import BLOCK, BLOCK_ROWS, dealt

Rows = dict[str, np.ndarray]


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the map of all rows up to it: (n, k) each. By doubling, in log2(n) steps over whole arrays."""
    a, b, s = a.copy(), b.copy(), 1
    while s < len(a):
        b[s:] = b[s:] + a[s:] * b[:-s]
        a[s:] = a[s:] * a[:-s]
        s *= 2
    return a, b


def smoothing(x: np.ndarray, pos: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Maps of an average that is the mean of its first n values, and then moves by alpha towards each; pos counts from the first value on."""
    head, before = pos < n, pos < 0
    return np.where(head, 1.0, 1 - alpha), np.where(before, 0.0, np.where(head, x / n, alpha * x))


def known(y: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """y where n values have been seen, NaN before."""
    return np.where(pos >= n - 1, y, np.nan)


def recursion(
    df: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], outputs: Sequence[str], start: Sequence[float],
    maps: Callable[[Rows], Sequence[tuple[np.ndarray, np.ndarray]]], finish: Callable[[Rows, list[np.ndarray]], Sequence[np.ndarray]], previous: Sequence[str] = (), size: int = BLOCK_ROWS,
    anchors: Sequence[str] | None = None,
) -> DataFrame:
    """df with the outputs of len(start) recursions side by side.

    maps(rows) gives (a, b) for each recursion, finish(rows, values) the outputs, NaN as NULL. rows has arrays of the inputs, of
    `rn` (the row's number in its series), `pos` (from the first row on in which all anchors, or else inputs, have values, negative before) and
    `prev_c` for each column of `previous`. df is read three times: what is dear to make is better settled first.
    """
    need = [*inputs, "__rn", "__first", *[f"__prev_{c}" for c in previous]]
    d = dealt(df, keys, order, size, previous, inputs if anchors is None else anchors)
    names, by = df.columns, [*keys, BLOCK]
    type_of = lambda c: d.schema[c].dataType.simpleString()

    def rows_of(pdf: pd.DataFrame) -> Rows:
        rows = {(c if c in inputs else c.removeprefix("__")): pdf[c].to_numpy(dtype=float) for c in need}
        first = rows.pop("first")
        rows["pos"] = np.where(np.isfinite(first), rows["rn"] - first, -1.0)
        return rows

    def maps_of(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        pairs = maps(rows)
        with np.errstate(invalid="ignore", over="ignore"):
            return composed(np.column_stack([p[0] for p in pairs]).astype(float), np.column_stack([p[1] for p in pairs]).astype(float))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        a, b = maps_of(rows_of(pdf))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "a": a[-1].tolist(), "b": b[-1].tolist()}])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        y, begins = np.array(start, dtype=float), []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            begins.append(y.tolist())
            y = np.asarray(a, dtype=float) * y + np.asarray(b, dtype=float)
        return pdf[by].assign(y=begins)

    def work(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn").reset_index(drop=True)
        rows = rows_of(pdf)
        a, b = maps_of(rows)
        y = a * np.asarray(begin["y"].iloc[0], dtype=float)[None] + b
        with np.errstate(divide="ignore", invalid="ignore"):
            made = finish(rows, list(y.T))
        for name, values in zip(outputs, made, strict=True):
            pdf[name] = pd.Series(values).astype(object).where(np.isfinite(values), None)
        return pdf[[*names, *outputs]]

    types = ", ".join(f"`{k}` {type_of(k)}" for k in by)
    maps_ = d.select(*dict.fromkeys([*by, *need])).groupBy(*by).applyInPandas(one, f"{types}, a array<double>, b array<double>")
    begins = maps_.groupBy(*keys).applyInPandas(carry, f"{types}, y array<double>")
    schema = ", ".join([f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields] + [f"`{o}` double" for o in outputs])
    return d.groupBy(*by).cogroup(begins.groupBy(*by)).applyInPandas(work, schema)
