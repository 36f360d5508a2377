"""What the operators of this package share: tables in the shared folder, word hashes, keyed lookups, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship  # noqa: F401  for the operators

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes worked on at once in a Python worker; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Bytes whose words are hashed at once: the arrays for that are 8 bytes a byte, several of them.
PIECE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset a temporary folder is set for it, but only in a session of
    one machine (tests); a cluster must name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Paths stored by the innermost `tidy` function that runs in this thread (or context), and whether there is one.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)
#: Paths that returned frames still read, of all threads.
_left: list[str] = []
_lock = threading.Lock()


def _note(paths: list[str], scope: list[str] | None) -> None:
    if scope is not None:
        scope += paths
        return
    with _lock:
        _left.extend(paths)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and any executor can be lost."""
    path = shared_dir(df.sparkSession)
    _note([path], _scope.get())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _session(values) -> SparkSession:
    for v in values:
        if isinstance(v, SparkSession):
            return v
        if isinstance(v, DataFrame):
            return v.sparkSession
    return SparkSession.active()


def tidy(f):
    """f, after which the tables that it stored are deleted but for those that its result (frames, or one) still reads.

    Those belong to the function around it, if that is tidy too, or stay until `release`. What runs in other threads is apart.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        around, made, result = _scope.get(), [], None
        token = _scope.set(made)
        try:
            result = f(*args, **kwargs)
        finally:
            _scope.reset(token)
            frames = [d for d in (result if isinstance(result, tuple) else (result,)) if isinstance(d, DataFrame)]
            read = {file.rsplit("/", 2)[-2] for d in frames for file in d.inputFiles()}
            _note([p for p in made if p.rsplit("/", 1)[-1] in read], around)
            delete(_session([*frames, *args, *kwargs.values()]), [p for p in made if p.rsplit("/", 1)[-1] not in read])
        return result

    return run


@contextlib.contextmanager
def scope(spark: SparkSession):
    """All that is stored within, results' tables too, is deleted at the end: results are to be written or counted before."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, made)


def release(spark: SparkSession) -> None:
    """Deletes all that finished operators have left for their results: those can't be read any more."""
    with _lock:
        paths, _left[:] = list(_left), []
    delete(spark, paths)


@atexit.register
def _at_exit() -> None:
    """What is left goes with the process, if its session still runs."""
    session = SparkSession.getActiveSession() if _left else None
    if session is not None:
        with contextlib.suppress(Exception):  # the JVM may be on its way out
            release(session)


def trim() -> None:
    """Gives memory that is no longer used back to the system, where the C library can: processes here live long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse_clash(keep: list[str], added: tuple[str, ...]) -> None:
    """ValueError if columns to keep have the name of one that is added."""
    if clash := set(added) & set(keep):
        raise ValueError(f"columns to keep have the names of added ones: {sorted(clash)}")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null: word starts are counted without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other characters unchanged; texts of ASCII only take the fast lower()."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def lookup(rows: DataFrame, facts: DataFrame, key: str, row_id: str, how: str = "left", salts: int = 256) -> DataFrame:
    """rows with the columns of facts, which has one row for each key (left join, or as `how` says).

    A key may hold a third of all rows: rows are first reduced to one per key and salt, the facts are
    joined to those (at most `salts` a key), and rows then find them by key and salt.
    Null keys find nothing.
    """
    salt = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    salted = rows.withColumn("__salt", salt)
    few = salted.where(F.col(key).isNotNull()).groupBy(key, "__salt").agg(F.lit(1).alias("__one")).drop("__one")
    return salted.join(few.join(facts, key), [key, "__salt"], how).drop("__salt")


# ---------------------------------------------------------------- words as numbers

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they can be inverted modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, n of each at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        got = _powers[base] = (both[0], both[1])
        if size > 4 * CHUNK_BYTES:  # a giant text; its tables don't stay
            _powers.pop(base)
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    pw, inv = _power(_B1, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(((_LOWER[buf] if lower else buf).astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a run of texts: starts and ends (bytes in buf), first (index of each text's first word, and the end), hash."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = _SPACE):
        """apart: of each byte, whether it separates words."""
        offsets = offsets.astype(np.int64)
        inside = ~apart[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(buf), dtype=bool)
        after = np.empty(len(buf), dtype=bool)
        if len(buf):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = np.empty(len(self.starts), dtype=np.uint64)
        k = 0
        while k < len(self.starts):  # a piece at a time: a word's hash doesn't depend on its place
            a = self.starts[k]
            j = max(k + 1, int(np.searchsorted(self.ends, a + PIECE_BYTES, side="right")))
            self.hash[k:j] = _word_hashes(buf[a : self.ends[j - 1]], self.starts[k:j] - a, self.ends[k:j] - a, lower)
            k = j

    def runs(self, k: int, base: int = _B2) -> np.ndarray:
        """Hash of the k words from each word on; only those within one text mean something (see `whole`)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        pw, inv = _power(base, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * pw[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inv[: n - k + 1] + np.uint64(k))

    def span(self, a: np.ndarray, b: np.ndarray, base: int = _B2) -> np.ndarray:
        """Hash of the words a to b (exclusive) for arrays of both; equals `runs` where the lengths are equal."""
        n = len(self.hash)
        pw, inv = _power(base, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * pw[:n], out=sums[1:])
        return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of runs of a string column's rows, each of about `limit` bytes; null is empty."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- merged partition sketches


def sketch_bits(spark: SparkSession, docs: DataFrame, text: str, per_byte: float, least: int = 16, most: int = 27) -> int:
    """log2 of a sketch's cells for all bytes of a text column: the cells grow with the input up to 2**most."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, total * per_byte))))))


def gaps(at: np.ndarray) -> bytes:
    """Rising numbers as the steps between them, a byte each: 255 stands for a step that goes on in the next byte."""
    step = np.diff(at.astype(np.int64), prepend=0)
    size = step // 255 + 1
    out = np.full(int(size.sum()), 255, dtype=np.uint8)
    out[np.cumsum(size) - 1] = step % 255
    return out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def packed(cells: np.ndarray, bits: int, blocks: int):
    """(block, bytes) of a partition's sketch: the steps between each block's cells, a cell hit again twice at most."""
    cells = np.sort(cells)
    if len(cells) > 2:
        cells = cells[np.concatenate(([True, True], cells[2:] != cells[:-2]))]
    width = (1 << bits) // blocks
    cut = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(width))
    for b in range(blocks):
        if cut[b] < cut[b + 1]:
            yield b, gaps(cells[cut[b] : cut[b + 1]] - np.uint64(b * width))


def _with_part(add):
    return lambda key, found: add(key[:-1], found).append_column("part", pa.array([key[-1].as_py()], pa.int32()))


def merged(parts: DataFrame, keys: list[str], add, schema: str, last=None, fan: int = 16) -> DataFrame:
    """One row for each key from a row for each key and partition: a tree in which a task merges about `fan` rows a key.

    add(key values, table of rows) -> table of one row, of the schema (keys first); `last` stands for it in the last
    step. Memory doesn't grow with the number of partitions.
    """
    left = parts.rdd.getNumPartitions()
    parts = parts.withColumn("part", F.spark_partition_id())
    while True:
        left = -(-left // fan)
        parts = parts.withColumn("part", F.pmod(F.col("part"), F.lit(left)))
        parts = parts.groupBy(*keys, "part").applyInArrow(_with_part(last if last and left == 1 else add), f"{schema}, part int")
        if left == 1:
            return parts.drop("part")


def repeated_cells(parts: DataFrame, bits: int, blocks: int) -> np.ndarray:
    """Bitmap of the cells that all partitions' sketches (row, block, cells) together hit twice or more.

    Merged by block in the executors; what comes to the driver is at most 2**bits / 8 bytes a sketch row,
    whatever the input.
    """
    width = (1 << bits) // blocks

    def counted(found):
        count = np.zeros(width, dtype=np.uint8)
        for cells in found["cells"]:
            at, times = np.unique(ungaps(cells.as_py()), return_counts=True)
            count[at] = np.minimum(count[at] + np.minimum(times, 2), 2)
        return count

    def row(key, data):
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([data], pa.binary())})

    def add(key, found):
        return row(key, gaps(np.repeat(np.arange(width), counted(found))))

    def last(key, found):
        return row(key, np.packbits(counted(found) > 1).tobytes())

    out = np.zeros((2, 1 << bits >> 3), dtype=np.uint8)
    for r in merged(parts, ["row", "block"], add, "row int, block int, cells binary", last).collect():
        out[r["row"], r["block"] * (width >> 3) : (r["block"] + 1) * (width >> 3)] = np.frombuffer(r["cells"], dtype=np.uint8)
    trim()
    return out


def cells_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of a hash in each of the two sketch rows: its highest bits, and bits of its second mixing."""
    return h >> np.uint64(64 - bits), mix(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - bits)


def maybe_repeated(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether both cells of a hash were hit twice: true for every hash that occurs twice, and for few others."""
    a, b = cells_of(h, bits)
    hit = lambda m, c: (m[(c >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1
    return (hit(bitmap[0], a) & hit(bitmap[1], b)).astype(bool)


# ---------------------------------------------------------------- bitmaps of ids


def has(bitmap: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    """Whether ids may be among those of a bitmap: true for all of them, and for few others."""
    cell = ids >> np.uint64(64 - bits)
    return ((bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)


def id_bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits of the cells that the ids (w) lie in; packed by block in the executors, 2**bits / 8 bytes in all."""
    width = 1 << (bits - 6)
    cells = ids.select(F.shiftrightunsigned("w", 64 - bits).alias("cell")).distinct().withColumn("block", F.shiftright("cell", bits - 6).cast("int"))

    def pack(key, found):
        on = np.zeros(width, dtype=bool)
        on[found["cell"].to_numpy() & (width - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in cells.groupBy("block").applyInArrow(pack, "block int, cells binary").collect():
        out[r["block"] * (width >> 3) : (r["block"] + 1) * (width >> 3)] = np.frombuffer(r["cells"], dtype=np.uint8)
    trim()
    return out


def bits_for(n: int) -> int:
    """log2 of a bitmap's bits for n ids: 32 an id, up to 2**27."""
    return int(min(27, max(12, np.ceil(np.log2(32 * max(1, n))))))


# ---------------------------------------------------------------- components


#: An id that more rows than this share is looked up by salted keys.
HOT = 50_000


def _met(rows: DataFrame, facts: DataFrame, key: str, row_id: str, most: int) -> DataFrame:
    """rows with the columns of facts by key, which `most` rows share at most: by salted keys if those are many."""
    return lookup(rows, facts, key, row_id, "inner") if most > HOT else rows.join(facts, key)


@tidy
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id reachable.

    Contraction by random priorities: each id points to the neighbour (or itself) whose hashed id is smallest,
    pointers are followed once more, and edges are rewritten between the ids pointed to, until none is left.
    Every round is written to the shared folder. No ids are gathered in the driver. Where an id has very many edges, or
    very many point to one, they are looked up by salted keys.
    """
    rest = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[tuple[DataFrame, int]] = []
    while True:
        both = rest.union(rest.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("i"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("m"), F.count("*").alias("n"))
        near = stored(near.select("id", F.least("m", rank("id"))["i"].alias("to"), "n"))
        ids, most = near.agg(F.count("*"), F.max("n")).first()
        if not ids:
            break
        if len(maps) >= rounds:
            raise RuntimeError("components: no end within the given rounds")
        jump = _met(near, near.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to", "id", most).select("id", F.col("to2").alias("to"))
        jump = stored(jump)
        maps.append((jump, ids))
        moved = _met(rest, jump.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a", "b", most)
        moved = _met(moved, jump.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b", "a", most)
        rest = stored(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if not maps:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = maps[-1][0]
    for m, ids in reversed(maps[:-1]):
        later = root.select(F.col("id").alias("to"), F.col("to").alias("root"))
        if ids > HOT:
            root = lookup(m, later, "to", "id").select("id", F.coalesce("root", "to").alias("to"))
        else:
            root = m.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    root = stored(root)
    least = stored(root.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component"), F.count("*").alias("n")))
    most = least.agg(F.max("n")).first()[0]
    return _met(root, least.drop("n"), "to", "id", most).select("id", "component")
