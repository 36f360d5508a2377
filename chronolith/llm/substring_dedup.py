"""Substring dedup with a count-min prefilter: repeated windows of words are cut from all but the smallest document.

A word goes if a window of `window` consecutive words of its document covers it whose word sequence also starts in a
document with a smaller id. Three passes over the texts, all in the executors:

1. Every window has one anchor, the run of `GRAM` words within it whose hash is least (the first of equals), so equal
   windows have equal anchors. Each partition sketches its anchors' hashes; the merged sketches, two rows of cells,
   overestimate how often an anchor occurs: an anchor that occurs twice is never missed.
2. Only anchors estimated repeated go on, each as one row for its group of windows (those that share the anchor, which
   start at consecutive words). Groups are counted exactly by the hash of all their words: a group that a smaller
   document has too is cut whole. If all documents with an anchor have the same words around it, that settles it.
3. Where the words around an anchor differ between documents, windows are grouped one by one, exactly.

A window is known by a 128-bit hash of its words (two independent 64-bit ones). The merged sketch takes
2 * 2**bits / 8 bytes in the driver and in each Python worker, 2**27 cells a row at most (32 MB): beyond about 10**8
anchors it lets more windows through to the exact grouping, and still loses none.

Defined results: a null text has no words; rows without doc_id keep all words, and their windows count for no one;
rows that share an id are one document, whose windows are never cut because of each other; a text of fewer words than
a window keeps them; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bits_for, cells_of, chunks, has, id_bitmap, maybe_repeated, mix, packed, repeated_cells, ship, sketch_bits, stored, table, tidy

GRAM = 20
#: Blocks in which a sketch is merged.
BLOCKS = 64
_B3, _B4 = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F | 1


class Anchored:
    """The anchor of each window of a run of texts."""

    def __init__(self, words: Words, window: int):
        n, gram = len(words.hash), min(GRAM, window)
        self.words, self.window = words, window
        last = words.first[1:][words.text_of()] if n else np.zeros(0, dtype=np.int64)
        self.starts = np.flatnonzero(np.arange(n) + window <= last)  # first words of whole windows
        if not len(self.starts):
            self.anchor = self.starts
            return
        runs = words.runs(gram)
        self.runs = runs
        span = window - gram + 1
        # least run hash in each window, its place in the low 24 bits: the first of equals
        keys = (runs & ~np.uint64(0xFFFFFF)) | (np.arange(len(runs), dtype=np.uint64) & np.uint64(0xFFFFFF))
        least, size = keys, 1
        while 2 * size <= span:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(keys) - span + 1], least[span - size : span - size + len(keys) - span + 1])
        at = (least[self.starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        self.anchor = at + ((self.starts - at + 0x800000) >> 24 << 24)  # places beyond 2**24, in texts that long

    def groups(self):
        """first window, last window (their first words) and anchor of each group of windows."""
        if not len(self.starts):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        new = np.flatnonzero(np.concatenate(([True], (np.diff(self.anchor) != 0) | (np.diff(self.starts) != 1))))
        end = np.concatenate((new[1:], [len(self.starts)])) - 1
        return self.starts[new], self.starts[end], self.anchor[new]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _texts(batches):
    """(batch of ids, bytes, offsets) of each run of a partition's rows (doc_id, text_id, text)."""
    for batch in batches:
        for i, j, buf, offsets in chunks(batch.column(2)):
            yield batch.slice(i, j - i), buf, offsets


def _sketches(docs: DataFrame, window: int, bits: int) -> DataFrame:
    def sketch(batches):
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def out():
            rows, blocks, cells = [], [], []
            for row in (0, 1):
                for block, data in packed(np.concatenate(held[row]), bits, BLOCKS):
                    rows.append(row), blocks.append(block), cells.append(data)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["row", "block", "cells"])

        for _, buf, offsets in _texts(batches):
            a = Anchored(Words(buf, offsets), window)
            _, _, anchors = a.groups()
            if len(anchors):
                for row, cell in enumerate(cells_of(a.runs[anchors], bits)):
                    held[row].append(cell)
                size += len(anchors)
            if size > 1 << 20:
                yield out()
                held, size = [[], []], 0
        if size:
            yield out()

    return docs.mapInArrow(sketch, "row int, block int, cells binary")


def _removed(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Words covered by windows that start at first to last."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _may_be_among(ids: DataFrame) -> Column:
    """Whether a row's (doc_id, text_id) may be among those of ids, by a bitmap of at most 2**27 bits: rows that can't needn't be shuffled."""
    key = F.xxhash64("doc_id", "text_id")
    bits = bits_for(ids.count())
    held = ids.sparkSession.sparkContext.broadcast(id_bitmap(ids.select(key.alias("w")), bits))

    @F.pandas_udf("boolean")
    def may(w: pd.Series) -> pd.Series:
        return pd.Series(has(held.value, bits, w.to_numpy().view(np.uint64)))

    return may(key)


@tidy
def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space; if wanted), kept_sha256."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_id"), F.col(text_col).alias("text"))
    own = docs.where("doc_id is not null and text is not null")
    bits = sketch_bits(spark, own, "text", per_byte=0.04)
    bitmap = spark.sparkContext.broadcast(repeated_cells(_sketches(own, window, bits), bits, BLOCKS))

    def groups(batches):
        for rows, buf, offsets in _texts(batches):
            a = Anchored(Words(buf, offsets), window)
            first, last, anchor = a.groups()
            if not len(anchor):
                continue
            hit = maybe_repeated(a.runs[anchor], bitmap.value, bits)
            first, last, anchor = first[hit], last[hit], anchor[hit]
            text = a.words.text_of()[first]
            offset = (anchor - first).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(a.runs[anchor]),
                    _signed(a.words.span(first, last + window, _B3) ^ mix(offset)),
                    _signed(a.words.span(first, last + window, _B4)),
                    rows.column(0).take(pa.array(text)),
                    rows.column(1).take(pa.array(text)),
                    pa.array((first - a.words.first[text]).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)),
                ],
                names=["anchor", "g1", "g2", "doc_id", "text_id", "first", "n"],
            )

    found = stored(own.mapInArrow(groups, "anchor bigint, g1 bigint, g2 bigint, doc_id bigint, text_id bigint, first int, n int"))
    bitmap.destroy()
    # exact, by the group's words; one row a group and anchor, however many documents have it
    exact = stored(found.groupBy("anchor", "g1", "g2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    forms = stored(exact.groupBy("anchor").agg(F.count("*").alias("forms")))
    exact = stored(exact.join(forms, "anchor").where("rows > 1 or forms > 1").select("g1", "g2", "least", (F.col("forms") > 1).alias("apart")))
    settled = stored(found.join(exact, ["g1", "g2"]).where("doc_id > least or apart"))
    cut = settled.where("doc_id > least").select("doc_id", "text_id", "first", "n")

    # around anchors with different surroundings, what no smaller document has as a group goes window by window
    open_ = settled.where("doc_id = least").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "n")).alias("at"))
    open_ = stored(open_)

    def windows(batches):
        for rows, buf, offsets in _texts(batches):
            w = Words(buf, offsets)
            pieces, owner = [], []
            for k, groups_ in enumerate(rows.column(3)):
                for g in groups_.as_py():
                    s = w.first[k] + g["first"]
                    pieces.append(np.arange(s, s + g["n"]))
                    owner.append(np.full(g["n"], k))
            s, k = np.concatenate(pieces), np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(w.span(s, s + window, _B3)),
                    _signed(w.span(s, s + window, _B4)),
                    rows.column(0).take(pa.array(k)),
                    rows.column(1).take(pa.array(k)),
                    pa.array((s - w.first[k]).astype(np.int32)),
                ],
                names=["g1", "g2", "doc_id", "text_id", "first"],
            )

    near = own.where(_may_be_among(open_)).join(open_, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "at")
    single = stored(near.mapInArrow(windows, "g1 bigint, g2 bigint, doc_id bigint, text_id bigint, first int"))
    least = stored(single.groupBy("g1", "g2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    more = single.join(least, ["g1", "g2"]).where("doc_id > least").select("doc_id", "text_id", "first", F.lit(1).alias("n"))
    gone = stored(cut.union(more).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "n")).alias("gone")))

    def cut_texts(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                n_words, n_removed, kept, sha = [], [], [], []
                for text, at in zip(batch.column(1), batch.column(2), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n, spans = len(words), at.as_py()
                    if spans:
                        first = np.array([x["first"] for x in spans])
                        last = first + np.array([x["n"] for x in spans]) - 1
                        drop = _removed(n, first, last, window)
                        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    left = b" ".join(words)
                    n_words.append(n), n_removed.append(n - len(words)), kept.append(left), sha.append(hashlib.sha256(left).hexdigest())
                columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
                if with_text:
                    columns["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns | {"kept_sha256": pa.array(sha, pa.string())})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, " + "kept string, " * with_text + "kept_sha256 string"
    touched = _may_be_among(gone)
    whole = docs.where(~touched).select("doc_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    rows = docs.where(touched).join(gone, ["doc_id", "text_id"], "left").select("doc_id", "text", "gone")
    return whole.mapInArrow(cut_texts, schema).union(rows.mapInArrow(cut_texts, schema))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) i from d),
g as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) h from s),
m as (select h, min(doc_id) least from g group by 1),
b as (select g.doc_id, g.i from g join m using (h) where g.doc_id > m.least),
e as (select doc_id, unnest(range(1, len(w) + 1)) i from d),
l as (select e.doc_id, e.i, b.i as s from e left join b using (doc_id, i)),
c as (select doc_id, i, max(s) over (partition by doc_id order by i rows between unbounded preceding and current row) s from l),
k as (select c.doc_id, count(*) filter (s is not null and i - s < 50) n_removed,
        coalesce(string_agg(d.w[i], ' ' order by i) filter (s is null or i - s >= 50), '') t
      from c join d using (doc_id) group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join k using (doc_id)
"""
