"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors are compared once and counted as often as they occur. Vectors are scaled to length 1 and turned into the
axes of their principal components, largest variance first. They are dealt to blocks by halving a bounded sample along
its widest axes; two blocks, or two tiles within them, whose boxes lie further apart than vectors of the threshold can
be are never compared. In the other pairs of tiles products over the leading axes are accumulated first; what the
other axes can still add is at most the product of the two suffix norms; a pair whose sum cannot reach the threshold is
dropped, and a tile in which none can is left. Pairs that remain are completed over all axes; those within 1e-9 of the
threshold are decided by the cosine of the vectors as they came. All in double precision, and exact: the sample only
decides which block a vector is in. On vectors without any structure few blocks lie apart, and the work grows with the
square of the number of different vectors.

A task returns for each vector its number of links and one vector it is connected to there, never pairs, so a
group of copies of any size stays linear; counts are added and components made over the cluster.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are
components of their own; vectors of different lengths don't link; equal vectors link with each other; rows that share a
vec_id are several vectors of one id, each with its own links, and their components are joined; rows without vec_id are
returned with component_id null and kept false, and link with nothing; an empty table gives an empty result; further
columns (labels too) are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lookup, merged, ship, stored, table, tidy

#: Bytes of a block (at most, about), vectors of a tile, and the least number of blocks.
BLOCK_BYTES, TILE, LEAST_BLOCKS = 8 << 20, 512, 6
#: Bytes of the sample that blocks are made from, at most, and its vectors for each leaf of the tree, at least.
SAMPLE_BYTES, LEAF_SAMPLE = 16 << 20, 16
#: Share of a tile's pairs beyond which all its products are completed at once.
DENSE = 0.02


def vectors_of(column: pa.Array):
    """(places, rows of doubles) for each length among a list column's usable vectors, each scaled by a power of two."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null is NaN
    end = np.cumsum(size)
    count = lambda good: np.concatenate(([0], np.cumsum(good)))
    bad, some = count(~np.isfinite(flat)), count(flat != 0)
    fine = (size > 0) & (bad[end] == bad[end - size]) & (some[end] > some[end - size])
    for dim in np.unique(size[fine]).tolist():
        at = np.flatnonzero(fine & (size == dim))
        raw = flat[(end[at] - dim)[:, None] + np.arange(dim)]
        yield at, np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def prepared(vectors: DataFrame, with_data: bool) -> DataFrame:
    """(vec_id, dim, key[, data]): of each row its vector's length, the hash of its numbers, and those; null if it can't link."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            dims, keys, data = np.zeros(n, dtype=np.int32), np.full(n, None, dtype=object), np.full(n, None, dtype=object)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, raw in vectors_of(batch.column(1)):
                for k, x in zip(at.tolist(), raw, strict=True):
                    if named[k]:
                        data[k] = x.tobytes()
                        dims[k], keys[k] = len(x), hashlib.blake2b(data[k], digest_size=16).digest()
            columns = [batch.column(0), pa.array(dims), pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: 3 + with_data], names=["vec_id", "dim", "key", "data"][: 3 + with_data])

    return vectors.mapInArrow(run, "vec_id bigint, dim int, key binary" + ", data binary" * with_data)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of all vectors (data) scaled to length 1: columns by falling variance. dim * dim numbers a partition are merged."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "m"])

    def add(key, found):
        total = np.sum([np.frombuffer(m.as_py()) for m in found["m"]], axis=0)
        return pa.table({"k": pa.array([0], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    got = merged(vectors.select("data").mapInArrow(moments, "k int, m binary"), ["k"], add, "k int, m binary").first()
    if got is None:
        return np.eye(dim)
    # about the origin, not the mean: cosine bounds need the turned vectors themselves
    return np.linalg.eigh(np.frombuffer(got["m"]).reshape(dim, dim))[1][:, ::-1].copy()


class Tree:
    """Leaves of turned vectors: a sample is halved along its widest axis until there are as many as wanted."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, places of the lower and upper half; a leaf has axis -1
        self.leaves = 0
        self._grow(sample, max(1, min(leaves, len(sample) // LEAF_SAMPLE)))

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        place = len(self.nodes)
        self.nodes.append((-1, 0.0, self.leaves, 0))
        axis = int(np.argmax(np.ptp(x, axis=0))) if leaves > 1 else 0
        cut = float(np.quantile(x[:, axis], (leaves // 2) / leaves)) if leaves > 1 else 0.0
        low = x[:, axis] <= cut if leaves > 1 else np.zeros(0, dtype=bool)
        if leaves > 1 and low.any() and not low.all():
            a = self._grow(x[low], leaves // 2)
            b = self._grow(x[~low], leaves - leaves // 2)
            self.nodes[place] = (axis, cut, a, b)
        else:
            self.leaves += 1
        return place

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                out[at] = a
            elif len(at):
                low = x[at, axis] <= cut
                todo += [(a, at[low]), (b, at[~low])]
        return out


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, t: float) -> np.ndarray:
    """Whether boxes (of unit vectors) lie so far apart that no cosine between them reaches t."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return np.einsum("...i,...i->...", gap, gap) > 2 - 2 * t + 1e-9


def steps(dim: int) -> list[int]:
    """Numbers of leading axes after which bounds are taken."""
    return sorted({min(dim, max(4, dim // 4)), min(dim, max(4, dim // 2)), dim})


def tile_links(a: np.ndarray, b: np.ndarray, ra: list[np.ndarray], rb: list[np.ndarray], cuts: list[int], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) in tiles a and b, and cosines, of the pairs of t - 1e-9 or more. ra, rb: suffix norms after each cut."""
    k = cuts[0]
    part = a[:, :k] @ b[:, :k].T
    low = t - 1e-9
    i, j = np.nonzero(part + np.multiply.outer(ra[0], rb[0]) >= low)
    if len(i) > DENSE * part.size:
        part += a[:, k:] @ b[:, k:].T
        i, j = np.nonzero(part >= low)
        return i, j, part[i, j]
    value = part[i, j]
    for c, (k0, k1) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
        value = value + np.einsum("ij,ij->i", a[i, k0:k1], b[j, k0:k1])
        good = value + ra[c][i] * rb[c][j] >= low
        i, j, value = i[good], j[good], value[good]
    return i, j, value


def tiles(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The places `at` of x in tiles, halved along the widest axis until they are small enough."""
    todo, out = [at], []
    while todo:
        some = todo.pop()
        if len(some) <= TILE:
            out += [some] if len(some) else []
            continue
        half = len(some) // 2
        some = some[np.argpartition(x[some, int(np.argmax(np.ptp(x[some], axis=0)))], half)]
        todo += [some[:half], some[half:]]
    return out


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, the least place each place is connected to, after the links (i, j)."""
    while True:
        a, b = root[i], root[j]
        new = a != b
        if not new.any():
            return root
        i, j = i[new], j[new]
        np.minimum.at(root, np.maximum(a, b)[new], np.minimum(a, b)[new])
        while not np.array_equal(up := root[root], root):
            root = up


def block_links(raw: np.ndarray, times: np.ndarray, half: np.ndarray, same: bool, turn: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of a pair of blocks (half: which vector is of which; same: a block with itself): number of each vector,
    where a vector counts as often as it occurs (times); the place of the least vector it is connected to; pairs of tiles compared."""
    n, dim = raw.shape
    x, cuts = _unit(raw) @ turn, steps(dim)
    norms = [np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", x[:, k:], x[:, k:]))) for k in cuts]
    count, root, done = np.zeros(n, dtype=np.int64), np.arange(n), 0
    first = tiles(x, np.flatnonzero(half == 0))
    second = first if same else tiles(x, np.flatnonzero(half == 1))
    box = lambda group: (np.array([x[g].min(axis=0) for g in group]).reshape(-1, dim), np.array([x[g].max(axis=0) for g in group]).reshape(-1, dim))
    (low, high), (low2, high2) = box(first), box(second)
    for p, one in enumerate(first):
        far = apart(low[p], high[p], low2, high2, t)
        for q in range(p if same else 0, len(second)):
            if far[q]:
                continue
            two, done = second[q], done + 1
            i, j, value = tile_links(x[one], x[two], [r[one] for r in norms], [r[two] for r in norms], cuts, t)
            if same and p == q:
                up = i < j
                i, j, value = i[up], j[up], value[up]
            i, j = one[i], two[j]
            edge = np.flatnonzero(np.abs(value - t) <= 1e-9)
            if len(edge):
                a, b = raw[i[edge]], raw[j[edge]]
                dot = lambda v, w: np.einsum("ij,ij->i", v, w)
                value[edge] = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
            good = value >= t
            i, j = i[good], j[good]
            if len(i):
                np.add.at(count, i, times[j])
                np.add.at(count, j, times[i])
                root = _joined(root, i, j)
    return count, root, done


@tidy
def vector_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    distinct = stored(prepared(given, True).where("key is not null").groupBy("dim", "key").agg(F.count("*").alias("n"), F.first("data").alias("data")))
    named = prepared(given, False).select("vec_id", "key")
    found = None
    for kind in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect():  # lengths of vectors, few
        more = _linked(distinct.where(F.col("dim") == kind["dim"]).select("key", "n", "data"), kind["dim"], kind["n"], threshold)
        found = more if found is None else found.union(more)
    if found is None:
        none = F.lit(0).cast("long").alias("n_links")
        return named.select("vec_id", none, F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found)
    links = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    edges = found.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    own = named.where("key is not null")
    shared = stored(own.groupBy("vec_id").agg(F.min("key").alias("b"), F.max("key").alias("c")).where("b <> c").select("vec_id", "b"))
    edges = edges.union(own.join(shared, "vec_id").where("key <> b").select("key", "b"))
    facts = own.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).join(components(edges), F.col("key") == F.col("id"), "left")
    facts = stored(facts.select("key", "least", "n", F.coalesce("component", "key").alias("c")).join(links, "key", "left"))
    least = stored(facts.groupBy("c").agg(F.min("least").alias("component_id")))
    facts = stored(lookup(facts, least, "c", "key", "inner").select("key", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    out = lookup(named, facts, "key", "vec_id")
    group = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("vec_id") == group, F.lit(False)).alias("kept"))


def _linked(vectors: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """(key, n_links, least): of each pair of blocks, what its task found for each vector that has links there."""
    turn = axes(vectors, dim)
    blocks = max(LEAST_BLOCKS, -(-n * dim * 8 // BLOCK_BYTES))
    sample = vectors.orderBy("key").select("data").limit(max(LEAF_SAMPLE, SAMPLE_BYTES // (8 * dim))).toArrow()
    tree = Tree(_unit(_matrix(sample["data"], dim)) @ turn, blocks)
    pairs = block_pairs(vectors, dim, turn, tree, -(-blocks // tree.leaves), threshold)
    return compared(vectors, dim, turn, tree, -(-blocks // tree.leaves), pairs, threshold)


def _own(keys: pa.Array, x: np.ndarray, tree: Tree, subs: int) -> np.ndarray:
    """The block of each turned vector: its leaf, and within that one of `subs` by its key."""
    part = np.array([int.from_bytes(k[:4], "little") % subs for k in keys.to_pylist()], dtype=np.int64)
    return tree.leaf(x) * subs + part


def block_pairs(vectors: DataFrame, dim: int, turn: np.ndarray, tree: Tree, subs: int, t: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks that hold vectors and whose boxes don't lie apart. A box is 16 bytes an axis, a block
    BLOCK_BYTES: the boxes that come to the driver and go to the workers are a small fixed share of the data."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((turn, tree))

    def bounds(batches):
        turn, tree = shared.value
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = _unit(_matrix(batch.column(1), dim)) @ turn
            own = _own(batch.column(0), x, tree, subs)
            for b in np.unique(own).tolist():
                some = x[own == b]
                low, high = found.get(b, (np.full(dim, np.inf), np.full(dim, -np.inf)))
                found[b] = [np.minimum(low, some.min(axis=0)), np.maximum(high, some.max(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array([v[k].tobytes() for v in found.values()], pa.binary()) for k in (0, 1))], names=["block", "low", "high"])

    def add(key, found):
        low = np.min([np.frombuffer(v.as_py()) for v in found["low"]], axis=0)
        high = np.max([np.frombuffer(v.as_py()) for v in found["high"]], axis=0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())})

    parts = vectors.select("key", "data").mapInArrow(bounds, "block bigint, low binary, high binary")
    boxes = merged(parts, ["block"], add, "block bigint, low binary, high binary").toArrow().sort_by("block")
    ids, low, high = boxes["block"].to_numpy(), _matrix(boxes["low"], dim), _matrix(boxes["high"], dim)
    held = spark.sparkContext.broadcast((ids, low, high))

    def near(batches):
        ids, low, high = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                j = k + np.flatnonzero(~apart(low[k], high[k], low[k:], high[k:], t))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[k])), pa.array(ids[j])], names=["i", "j"])

    return stored(spark.range(0, len(ids), 1, max(1, min(len(ids) // 64, 1024))).mapInArrow(near, "i bigint, j bigint"))


def compared(vectors: DataFrame, dim: int, turn: np.ndarray, tree: Tree, subs: int, pairs: DataFrame, t: float) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((turn, tree))

    def place(batches):
        turn, tree = shared.value
        for batch in batches:
            own = _own(batch.column(0), _unit(_matrix(batch.column(2), dim)) @ turn, tree, subs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["key", "n", "data", "own"])

    meet = pairs.select(F.col("i").alias("own"), "i", "j", F.lit(0).alias("half")).union(pairs.where("i < j").select("j", "i", "j", F.lit(1)))
    dealt = vectors.mapInArrow(place, "key binary, n bigint, data binary, own bigint").join(meet, "own").drop("own")

    def work(key, found):
        found = found.sort_by("key")
        count, least, _ = block_links(_matrix(found["data"], dim), found["n"].to_numpy(), found["half"].to_numpy(), key[0].as_py() == key[1].as_py(), shared.value[0], t)
        has = np.flatnonzero(count)
        return pa.table({"key": found["key"].take(pa.array(has)), "n_links": pa.array(count[has]), "least": found["key"].take(pa.array(least[has]))})

    return dealt.groupBy("i", "j").applyInArrow(work, "key binary, n_links bigint, least binary")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))
