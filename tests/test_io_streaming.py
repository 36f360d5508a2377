"""Sources, sinks and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import regime
from chronolith.schema import BAR, feature_columns, regime_last
from chronolith.sources import readers, writers
from chronolith.streaming import live

T0 = datetime(2024, 1, 1)


def frame(spark, n=50):
    return spark.createDataFrame([("a", T0 + timedelta(hours=k), 1.0, 2.0, 0.5, 1.0 + k, 3.0) for k in range(n)], BAR)


def test_files(spark, tmp_path):
    d = frame(spark)
    writers.csv(d, f"{tmp_path}/c.csv")
    writers.panel(d.withColumn("split", F.lit("train")), f"{tmp_path}/p.parquet", ("split",))
    assert readers.load(spark, f"{tmp_path}/c.csv").exceptAll(d).count() == 0
    assert readers.load(spark, f"{tmp_path}/p.parquet").where("split = 'train'").count() == 50
    with pytest.raises(ValueError):
        writers.panel(d.drop("ts"), f"{tmp_path}/q.parquet")
        readers.load(spark, f"{tmp_path}/q.parquet")
    assert readers.first_of(spark, [(f"{tmp_path}/no.parquet", lambda: None), (f"{tmp_path}/c.csv", lambda: d)]).count() == 50
    with pytest.raises(FileNotFoundError):
        readers.first_of(spark, [(f"{tmp_path}/no.parquet", lambda: None)])


def test_results_and_metadata(spark, tmp_path):
    writers.append(spark.createDataFrame([(1, 0.5)], "segment int, sharpe double"), f"{tmp_path}/r")
    writers.append(spark.createDataFrame([(2, "x")], "segment int, note string"), f"{tmp_path}/r")
    got = writers.results(spark, f"{tmp_path}/r")
    assert got.count() == 2 and {"sharpe", "note", "added_at"} <= set(got.columns)
    writers.metadata(spark, {"context_rows": 336}, f"{tmp_path}/m")
    assert writers.read_metadata(spark, f"{tmp_path}/m") == {"context_rows": 336}
    calls = []
    make = lambda: (calls.append(1), spark.range(3))[1]
    assert writers.once(spark, f"{tmp_path}/o", make).count() == 3 and writers.once(spark, f"{tmp_path}/o", make).count() == 3 and calls == [1]


def test_paged_source():
    data = [(T0 + timedelta(hours=k), k) for k in range(100)]
    fetch = lambda a, b: [r for r in data if a <= r[0] < b][:7]
    assert list(readers.pages(T0, T0 + timedelta(hours=60), fetch, timedelta(hours=10))) == data[:60]


def test_normalize_and_columns(spark):
    d = spark.createDataFrame([(T0, 1.0, 2.0, 0.5, 1.5)], "Date timestamp_ntz, Open double, High double, Low double, Close double")
    assert readers.normalize(d, "x").first()["volume"] == 0.0
    with pytest.raises(ValueError):
        readers.normalize(d.drop("Open"), "x")
    assert feature_columns(spark.createDataFrame([], "asset string, ts timestamp_ntz, close double, rsi double, hmm_prob_0 double, n int").schema) == ["rsi"]
    with pytest.raises(ValueError):
        regime_last(["rsi"])


def run(df, spark, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


def test_live_bars_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    late = e.agg((F.max("ts") + F.expr("interval 9 hours")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    e.union(late).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    got = run(live.hourly_bars(stream), spark).where("asset <> 'end'").select("asset", "ts", "close", "volume")
    want = e.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").cast("double").alias("volume"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_live_beliefs_equal_batch(spark, tmp_path):
    model = {"start": [0.5, 0.5], "trans": [[0.9, 0.1], [0.2, 0.8]], "weights": [[1.0], [1.0]], "means": [[[-1.0]], [[1.0]]], "vars": [[[1.0]], [[1.0]]]}
    d = spark.createDataFrame([("a", T0 + timedelta(hours=k), float((k % 7) - 3)) for k in range(30)], "asset string, ts timestamp, x double")
    d.coalesce(1).write.parquet(f"{tmp_path}/b")
    got = run(live.beliefs(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/b"), model, ["x"], 2), spark)
    want = regime.forward_filter(d, model, ["x"], states=2)
    both = got.withColumnRenamed("hmm_prob_0", "p").join(want, ["asset", "ts"])
    assert both.count() == 30 and both.where("abs(p - hmm_prob_0) > 1e-6").count() == 0


def test_live_sessions_and_latest_rows_equal_batch(spark, tmp_path):
    """Repeated rows of a key: the last by event_id; a session that is still open doesn't come out."""
    at = [0, 1, 2, 9, 10, 30]
    rows = [(T0 + timedelta(hours=h), k, "a", float(k)) for k, h in enumerate(at)] + [(T0 + timedelta(hours=1), 50, "a", 7.0), (T0 + timedelta(hours=1), 40, "a", None)]
    d = spark.createDataFrame(rows, "ts timestamp, event_id bigint, event_type string, value double")
    d.coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = lambda: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/s")
    got = [(r["start"], r["end"], r["n"]) for r in run(live.sessions(stream()), spark).orderBy("start").collect()]
    whole = [(r["start"], r["end"], r["n"]) for r in live.sessions(d).orderBy("start").collect()]
    assert [x[2] for x in whole] == [5, 2, 1] and got == whole[:2]
    last = {r["ts"]: (r["event_id"], r["value"]) for r in run(live.latest(stream(), ["event_type"]), spark).collect()}
    want = {r["ts"]: (r["event_id"], r["value"]) for r in live.latest(d, ["event_type"]).collect()}
    assert len(want) == 6 and (50, 7.0) in want.values() and last == {t: v for t, v in want.items() if t != max(want)}
