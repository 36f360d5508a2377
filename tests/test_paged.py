"""Paged sources with short, repeated, empty and failing pages."""

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronolith.sources import paged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
T0 = datetime(2024, 1, 1)
N = 200


def rows_of(asset):
    """Hours of an asset, a gap of two days in them."""
    n = {"a": N, "b": 30, "none": 0}[asset]
    return [(T0 + timedelta(hours=k + (48 if k >= 60 else 0)), 1.0, 2.0, 0.5, float(k), 3.0) for k in range(n)]


def interface(folder, fails=0):
    def fetch(asset, start, end):
        mark = f"{folder}/{asset}-{start:%d%H}"
        failed = len([f for f in os.listdir(folder) if f.startswith(os.path.basename(mark) + ".")])
        if failed < fails:
            open(f"{mark}.{failed}", "w").close()
            raise ConnectionError("too many requests")
        own = [r for r in rows_of(asset) if r[0] < end]
        k = next((j for j, r in enumerate(own) if r[0] >= start), len(own))
        return own[max(0, k - 1) : k + 7]  # seven rows at most, and one that was there already

    return fetch


def want(*assets):
    return sorted((a, *r) for a in assets for r in rows_of(a))


def test_each_row_once(spark, tmp_path):
    paged.register(spark, "plain_pages", interface(tmp_path))
    d = paged.bars(spark, "plain_pages", ["a", "b", "none"], T0, T0 + timedelta(days=12), chunk_hours=50)
    assert sorted(map(tuple, d.collect())) == want("a", "b") and d.rdd.getNumPartitions() > 12
    assert paged.bars(spark, "plain_pages", ["a"], T0, T0).count() == 0
    some = paged.bars(spark, "plain_pages", ["a"], T0 + timedelta(hours=5), T0 + timedelta(hours=9))
    assert [r["close"] for r in some.orderBy("ts").collect()] == [5.0, 6.0, 7.0, 8.0]


def test_failing_pages_are_tried_again(spark, tmp_path):
    paged.register(spark, "failing_pages", interface(tmp_path, 2))
    d = paged.bars(spark, "failing_pages", ["a", "b"], T0, T0 + timedelta(days=12), chunk_hours=100, tries=3, pause=0.001)
    assert sorted(map(tuple, d.collect())) == want("a", "b") and os.listdir(tmp_path)
    paged.register(spark, "dead_pages", interface(tmp_path, 10**6))
    with pytest.raises(Exception, match="too many requests"):
        paged.bars(spark, "dead_pages", ["a"], T0, T0 + timedelta(days=1), tries=2, pause=0.001).collect()


def test_a_stream_goes_on_where_it_has_stopped(spark, tmp_path):
    clock = f"{tmp_path}/clock"
    pages = tmp_path / "pages"
    pages.mkdir()

    def latest():
        with open(clock) as f:
            return T0 + timedelta(hours=int(f.read()))

    paged.register(spark, "live_pages", interface(str(pages)), latest)

    def run(hours):
        with open(clock, "w") as f:
            f.write(str(hours))
        s = spark.readStream.format("live_pages").option("assets", "a,b").option("start", T0.isoformat()).option("chunk_hours", "30").load()
        q = s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out")

    assert run(10).count() == 20
    assert run(10).count() == 20
    got = run(300)
    assert sorted(map(tuple, got.select("asset", "ts", "open", "high", "low", "close", "volume").collect())) == want("a", "b")
    assert got.groupBy("asset", "ts").count().where(F.col("count") > 1).count() == 0
