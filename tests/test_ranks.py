"""Exact order statistics against sorting, also with brackets that hold few of the rows."""

import numpy as np
import pytest

from chronolith.functions.ranks import quantiles


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equal_to_sorting(spark, accuracy):
    rng, rows, ps = np.random.default_rng(0), [], (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    made = {"normal": rng.normal(size=5000), "ties": rng.integers(0, 4, size=3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "heavy": np.exp(rng.normal(size=4000) * 9), "same": np.full(500, -3.0)}
    for k, v in made.items():
        rows += [(k, float(x)) for x in v] + [(k, None)] * 3
    rows += [("none", None), (None, 4.0), (None, 6.0)]
    d = spark.createDataFrame(rows, "feature string, x double").repartition(6)
    got = {r["feature"]: r["q"] for r in quantiles(d, ["feature"], ps, accuracy=accuracy).collect()}
    assert set(got) == {*made, None} and got[None][3] == 5.0
    for k, v in made.items():
        np.testing.assert_allclose(got[k], np.quantile(v, ps), rtol=1e-12)


def test_no_key_and_no_rows(spark):
    d = spark.range(1001).selectExpr("cast(id as double) x", "'b' as q")
    assert quantiles(d, [], (0.1, 0.5), accuracy=50).first()["q"] == [100.0, 500.0]
    assert quantiles(d.where("false"), [], (0.5,)).count() == 0


def test_only_brackets_are_sorted(spark):
    """Rows that reach the ordering: a few of the table's."""
    d = spark.range(200_000).selectExpr("cast(id % 2 as string) feature", "cast(hash(id) as double) x")
    df = quantiles(d, ["feature"], (0.5,), accuracy=1000)
    want = d.groupBy("feature").agg({"x": "median"}).collect()
    assert sorted((r[0], r[1]) for r in want) == sorted((r["feature"], r["q"][0]) for r in df.collect())
    assert "percentile(" not in df._jdf.queryExecution().toString()
