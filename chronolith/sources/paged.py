"""Paged interfaces as a Spark data source, for tables and for streams.

A partition is an asset and a span of time; within it a cursor goes from page to page: pages may be short, may repeat rows that
were there already, may be empty (nothing more in the span: gaps don't end the scan, as the next span is another partition) and may fail,
which is tried again some times before the task fails and Spark runs it anew. Each row of a span comes out once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..runtime import ship
from ..schema import BAR

#: fetch(asset, from, to) -> rows (ts, open, high, low, close, volume) with from <= ts < to in rising order, as many as the interface gives at once.
Fetch = Callable[[str, datetime, datetime], list[tuple]]


class Span(InputPartition):
    def __init__(self, asset: str, start: datetime, end: datetime):
        self.asset, self.start, self.end = asset, start, end


def spans(assets: list[str], start: datetime, end: datetime, chunk: timedelta) -> list[Span]:
    """Cut at multiples of the chunk from a fixed day, so that spans don't depend on where a scan begins."""
    zero, out = datetime(2000, 1, 1), []
    at = start
    while at < end:
        to = min(end, zero + chunk * ((at - zero) // chunk + 1))
        out += [Span(a, at, to) for a in assets]
        at = to
    return out


def scan(fetch: Fetch, span: Span, tries: int, pause: float) -> Iterator[tuple]:
    cursor, last = span.start, None
    while cursor < span.end:
        for k in range(tries):
            try:
                page = fetch(span.asset, cursor, span.end)
                break
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(pause * 2**k)
        fresh = [row for row in page if span.start <= row[0] < span.end and (last is None or row[0] > last)]
        if not fresh:
            return
        yield from ((span.asset, *row) for row in fresh)
        last = fresh[-1][0]
        cursor = last + timedelta(microseconds=1)


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: dict[str, str]):
        self.fetch, self.assets = fetch, [a for a in options["assets"].split(",") if a]
        self.chunk = timedelta(hours=float(options.get("chunk_hours", 24 * 180)))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.start = datetime.fromisoformat(options["start"])
        self.end = datetime.fromisoformat(options["end"]) if "end" in options else None

    def partitions(self) -> list[Span]:
        if self.end is None:
            raise ValueError("a scan needs an end")
        return spans(self.assets, self.start, self.end, self.chunk)

    def read(self, partition: Span | None) -> Iterator[tuple]:
        return scan(self.fetch, partition, self.tries, self.pause) if partition is not None else iter(())  # without spans Spark asks once, for none


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: rows before an offset have been taken. The newest is what `latest()` says: rows before it are complete."""

    def __init__(self, fetch: Fetch, latest: Callable[[], datetime], options: dict[str, str]):
        self.table, self.latest = _Reader(fetch, options), latest

    def initialOffset(self) -> dict:
        return {"at": self.table.start.isoformat()}

    def latestOffset(self) -> dict:
        at = max(self.table.start, self.latest())
        return {"at": (min(at, self.table.end) if self.table.end else at).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(self.table.assets, datetime.fromisoformat(start["at"]), datetime.fromisoformat(end["at"]), self.table.chunk)

    def read(self, partition: Span | None) -> Iterator[tuple]:
        return self.table.read(partition)


def register(spark: SparkSession, name: str, fetch: Fetch, latest: Callable[[], datetime] | None = None) -> None:
    """Makes `spark.read.format(name)` and, with `latest`, `spark.readStream.format(name)` read bars through fetch.

    Options: assets (comma-separated), start and end (ISO times; a stream may have no end), chunk_hours, tries, pause (seconds, doubled each time).
    fetch runs in the executors, and is sent there.
    """
    ship(spark)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BAR

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            if latest is None:
                raise ValueError(f"{name} has no stream: nothing tells its newest time")
            return _StreamReader(fetch, latest, dict(self.options))

    spark.dataSource.register(Paged)


def bars(spark: SparkSession, name: str, assets: list[str], start: datetime, end: datetime, **options) -> DataFrame:
    reader = spark.read.format(name).option("assets", ",".join(assets)).option("start", start.isoformat()).option("end", end.isoformat())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
