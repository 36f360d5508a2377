"""Exact dedup by a persistent digest index: bucketed and sorted by hash, probed by sort-merge anti-join, then appended to.

DataFrame functions only. Texts are equal when identical after lower-casing A-Z; null counts as empty.

Defined results: an empty table gives an empty result; rows of one doc_id and one text (repeated rows) are
one document, so all of them are kept or none; a row without doc_id counts in its group's size and is never
the one that stays, unless no row of the group has an id when the index first meets it: then keep_id is null and all its rows
without an id stay. group_size counts the rows of all batches that the index has seen, each batch once however often it is added.
Columns besides the id and the text are passed over, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, delete, lookup, shared_dir, stored, table, tidy


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each row's normalised text as 32 bytes."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))


#: Digests of a bucket, about: some 200 MB.
PER_BUCKET = 4_000_000
#: Appends after which the index is written anew, one sorted file a bucket.
APPENDS = 16
_NOTES = "seq bigint, kind string, version string, batch string, attempt string, buckets int"


class DigestIndex:
    """Digests seen so far with the id that stays and the number of rows, in a table bucketed and sorted by digest.

    `path` is a folder that all executors share; a path that already holds an index is opened, not overwritten. Each append has a batch
    id and an attempt of its own, and counts from when its note (a small table beside the rows) is written: an append that was cut short
    leaves rows that nothing reads, and a batch whose note is there isn't added again. `compact` writes one row a digest and one sorted file
    a bucket to a new folder, with as many buckets as the rows call for, and then notes it; it runs by itself after APPENDS appends, or when
    buckets hold twice what they should. One writer at a time.
    """

    SCHEMA = "digest binary, keep_id bigint, group_size bigint, attempt string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark, self.path, self.note = spark, path, f"{path}-notes"
        if not self._notes():
            self._write_note("version", uuid.uuid4().hex, None, None, buckets or max(16, -(-rows // PER_BUCKET)))
        self._open()

    def _notes(self) -> list[Row]:
        """A row each append and version, in order: as many as batches were added, whatever their sizes."""
        try:
            return sorted(self.spark.read.schema(_NOTES).parquet(self.note).collect(), key=lambda r: r["seq"])
        except AnalysisException:  # no such folder: a new index
            return []

    def _write_note(self, kind: str, version: str, batch: str | None, attempt: str | None, buckets: int) -> None:
        seq = max((r["seq"] for r in self._notes()), default=-1) + 1
        values = zip(_NOTES.split(", "), (seq, kind, version, batch, attempt, buckets), strict=True)
        row = [F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for c, v in values]
        self.spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(self.note)

    def _open(self) -> None:
        notes = self._notes()
        now = [r for r in notes if r["kind"] == "version"][-1]
        self.version, self.buckets = now["version"], now["buckets"]
        self.batches = {r["batch"] for r in notes if r["kind"] == "batch"}
        self.attempts = ["base", *(r["attempt"] for r in notes if r["kind"] == "batch" and r["version"] == self.version)]
        self.name = self._table(self.version, self.buckets)

    def _table(self, version: str, buckets: int) -> str:
        name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{version}').hex}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{version}'"
            )
        return name

    def _append(self, rows: DataFrame, name: str, buckets: int) -> None:
        rows.repartition(buckets, "digest").write.mode("append").format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)

    def entries(self) -> DataFrame:
        """What was appended: a digest's first row has keep_id, later ones only add to its group."""
        return self.spark.table(self.name).where(F.col("attempt").isin(self.attempts))

    def read(self) -> DataFrame:
        """One row a digest; a bucket's rows lie together, so nothing is shuffled."""
        return self.entries().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    @staticmethod
    def batch_id(seen: DataFrame) -> str:
        """The same for the same rows, in any order: their number and the sums of two hashes of each."""
        h = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
        r = seen.agg(F.count("*").alias("n"), h("doc_id", "digest").alias("a"), h("digest", F.lit(1), "doc_id").alias("b")).first()
        return f"{r['n']}:{r['a']}:{r['b']}"

    @tidy
    def add(self, seen: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends the digests of `seen` (doc_id, digest) that the index lacks, and the sizes of the groups that it has;
        returns the former as written. A batch that was added already (`batch`, or else the same rows) changes nothing, and returns none.

        Rows of one digest are reduced before the shuffle (max and count), so a group may hold any share of all rows.
        Within one batch the largest doc_id stays; against an earlier batch the indexed row stays.
        """
        batch, attempt = batch or self.batch_id(seen), uuid.uuid4().hex
        groups = stored(seen.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"), F.count("*").alias("group_size")))
        if batch in self.batches:
            return groups.limit(0)
        known = self.entries().select("digest").hint("merge")
        fresh = stored(groups.join(known, "digest", "left_anti"))
        again = stored(groups.join(known, "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("long")))
        self._append(fresh.union(again).withColumn("attempt", F.lit(attempt)), self.name, self.buckets)
        self._write_note("batch", self.version, batch, attempt, self.buckets)
        self._open()
        if len(self.attempts) > APPENDS or self.entries().count() > 2 * PER_BUCKET * self.buckets:
            self.compact()
        return fresh

    def compact(self) -> None:
        """Writes the index anew: one row a digest, buckets by its size, one sorted file each. The old rows go once the new are noted."""
        rows = self.read()
        version, buckets = uuid.uuid4().hex, max(self.buckets, -(-rows.count() // PER_BUCKET))
        name = self._table(version, buckets)
        self._append(rows.withColumn("attempt", F.lit("base")), name, buckets)
        self._write_note("version", version, None, None, buckets)
        old_name, old = self.name, f"{self.path}/{self.version}"
        self._open()
        self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
        delete(self.spark, [old])

    def find(self, seen: DataFrame) -> DataFrame:
        """`seen` with keep_id and group_size of each row's digest."""
        return lookup(seen, self.read(), "digest", "doc_id")

    def close(self) -> None:
        """Takes the table out of the catalogue. Its files stay, for the next session that opens the path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def batches_of(seen: DataFrame, n: int) -> list[DataFrame]:
    """The rows of seen by n ranges of doc_id, largest ids first, so that of all batches the largest id stays; without ids last."""
    least, most = seen.agg(F.min("doc_id"), F.max("doc_id")).first()
    if least is None or least == most or n == 1:
        return [seen]
    cuts = sorted({least + (most - least) * k // n for k in range(1, n)}, reverse=True)
    above = F.lit(False)
    out = []
    for c in cuts:
        now = F.coalesce(F.col("doc_id") > c, F.lit(False))
        out.append(seen.where(now & ~above))
        above = now
    return [*out, seen.where(~above)]


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; new digests are appended to the index, batch by batch."""
    seen = stored(digests(docs, id_col, text_col))
    for batch in batches_of(seen, batches):
        index.add(batch)
    return index.find(seen).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@tidy
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: the second is deduplicated against what the first has put into the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = DigestIndex(spark, shared_dir(spark), rows=docs.count())
    out = stored(exact_dedup(docs, index, batches=2))
    index.close()
    delete(spark, [index.path, index.note])
    return out


ORACLE = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256
  from documents),
g as (select text_sha256, max(doc_id) keep_id, count(*) group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from d join g using (text_sha256)
"""
