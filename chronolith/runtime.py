"""What executors need: this package, importable in their Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir, for what streams read, write and note. Where that is unset a temporary folder is set for
    it in a session of one machine; a cluster must name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_settled: list[tuple[SparkSession, str]] = []


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what reads it several times doesn't make it several times. The files go when the process ends,
    or by `sweep`."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    _settled.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def sweep() -> None:
    """Deletes what was settled: frames that read it can't be read any more."""
    while _settled:
        spark, p = _settled.pop()
        with contextlib.suppress(Exception):  # at the end the session may have gone
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a context, by Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_chronolith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chronolith-")) / "chronolith_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    # a stream's own runner, on the driver, doesn't look where added files are
    known = sc.environment.get("PYTHONPATH")
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(root.parent), *([known] if known else [])])
    sc._chronolith_shipped = True
