"""Phrase collocations by contiguous pattern growth from frequent prefixes.

Texts are cut into pieces and words, per language. A phrase can't be more frequent than the words and phrases in it, so
words are counted first, then the pairs of frequent words, then, in sketches, runs of three to five words whose pairs are frequent. What is
projected for growth are the occurrences of frequent pairs that a sketch lets go on: each with the up to three words to its right
that it lets through, equal ones of a task counted together. Sorted by those words, a prefix's occurrences lie together; each
task takes the prefixes of a range and extends them to the right, depth first, as long as they are frequent (`grow`). A prefix with
a great share of all occurrences is split over tasks: what touches the edge of a batch is passed on as a partial count,
whatever it is, and partial counts are summed.

Frequent words and pairs reach the tasks as bitmaps of at most 2**27 bits, longer runs as count-min sketches of at most 2**24 cells, merged from
the tasks' ones: both only let through more than is frequent, never less, and counts of phrases are exact. 64-bit hashes stand for words (of
one language), as elsewhere in this package.

Defined results: null text is empty, null language is `und`; a phrase never crosses the end of a piece or a text; words that only differ in
the case of A-Z are one; repeated rows count as often as they stand; equal scores and counts are ordered by the phrase's bytes. Scores are whole numbers
from decimals of 38 digits: beyond those (1000 * a * n or l * r of 10**38) there is an error, not a wrong number. Columns besides
the two are passed over, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, Words, bits_for, chunks, has, id_bitmap, merged, mix, ship, stored, table, tidy, trim

#: Words of a phrase at most.
LONGEST = 5
#: Words whose equal windows are counted together in a task before they are passed on.
FLUSH = 1 << 20
#: Words of a task whose spelling it remembers having passed on.
SPELT = 1 << 17
_BETWEEN, _ENDS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN[[0x20, 0x09]] = True
_BETWEEN |= _ENDS
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_W = [f"w{k}" for k in range(1, LONGEST + 1)]


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


class Texts:
    """Words of some texts: id (by language), code of the language, and whether the next word follows in the same piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, codes: np.ndarray, seeds: np.ndarray):
        self.buf, self.words = buf, Words(buf, offsets, lower=True, apart=_BETWEEN)
        text = self.words.text_of()
        self.lang = codes[text]
        self.id = mix(self.words.hash + seeds[self.lang])
        ends = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(_ENDS[buf], out=ends[1:])
        self.joint = np.zeros(len(self.id), dtype=bool)
        if len(self.id) > 1:
            self.joint[:-1] = (text[1:] == text[:-1]) & (ends[self.words.starts[1:]] == ends[self.words.ends[:-1]])

    def spelling(self, k: int) -> str:
        return _LOWER[self.buf[self.words.starts[k] : self.words.ends[k]]].tobytes().decode("utf-8", "replace")


def each_text(batches, langs: dict[str, int]):
    """Texts of a task's batches (lang, text); langs collects the codes."""
    for batch in batches:
        codes = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"].to_pylist()], dtype=np.int64)
        seeds = np.array([_seed(x) for x in langs], dtype=np.uint64)
        for i, j, buf, offsets in chunks(batch["text"]):
            yield Texts(buf, offsets, codes[i:j], seeds)


def counted(d: DataFrame, pick, schema: str) -> DataFrame:
    """pick(texts) -> (ids, values beside them) of each run of texts; equal ids of a task are counted: a language for codes, or values, and n."""

    def count(batches):
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            ids, *beside = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, n = np.unique(ids, return_index=True, return_counts=True)
            if schema.startswith("lang"):
                made = [pa.array(np.array(list(langs), dtype=object)[beside[0][first]], pa.string()), pa.array(ids[first].view(np.int64))]
            else:
                made = [pa.array(x[first].view(np.int64)) for x in beside]
            return pa.RecordBatch.from_arrays([*made, pa.array(n.astype(np.int64))], [c.split()[0] for c in schema.split(", ")])

        for t in each_text(batches, langs):
            held.append(pick(t))
            size += len(held[-1][0])
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        held.clear()
        trim()

    return d.mapInArrow(count, schema)


#: Cells of a sketch of runs of m words, at most; rows of it are blocks of so many.
SKETCH_BITS, BLOCK_BITS = 24, 18


def frequent_runs(t: Texts, words: tuple[np.ndarray, int], pairs: tuple[np.ndarray, int]) -> np.ndarray:
    """Whether a word begins a frequent pair."""
    ok = t.joint.copy()
    if len(ok) > 1:
        on = has(*words, t.id)
        ok[:-1] &= on[:-1] & on[1:]
        at = np.flatnonzero(ok)
        ok[at] = has(*pairs, mix(t.id[at] * _PAIR + t.id[at + 1]))
    return ok


def longer(t: Texts, ok: np.ndarray):
    """(m, places, ids) of the runs of m words, three and more, all of whose pairs are frequent."""
    at = np.flatnonzero(ok)
    key = mix(t.id[at] * _PAIR + t.id[np.minimum(at + 1, len(ok) - 1)])
    for m in range(3, LONGEST + 1):
        go = ok[np.minimum(at + m - 2, len(ok) - 1)] & (at + m - 1 < len(ok))
        at, key = at[go], key[go]
        key = mix(key * _PAIR + t.id[at + m - 1])
        yield m, at, key


def sketches(d: DataFrame, words: tuple[np.ndarray, int], pairs: tuple[np.ndarray, int], bits: int, least: int) -> np.ndarray:
    """Bitmaps, one for each m, of the cells that runs of m words hit `least` times or more, in tasks' sketches merged by block."""
    kind = np.min_scalar_type(2 * least)
    width = 1 << min(bits, BLOCK_BITS)
    schema = "m int, block int, cells binary"

    def count(batches):
        cells = np.zeros((LONGEST - 2, 1 << bits), dtype=kind)
        for t in each_text(batches, {}):
            for m, _, key in longer(t, frequent_runs(t, words, pairs)):
                at, n = np.unique((key >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                cells[m - 3, at] = np.minimum(cells[m - 3, at] + np.minimum(n, least).astype(kind), least)
        for m in range(3, LONGEST + 1):
            for b in range((1 << bits) // width):
                block = cells[m - 3, b * width : (b + 1) * width]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([b], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["m", "block", "cells"])
        del cells, block
        trim()

    def total(found):
        sums = np.zeros(width, dtype=kind)
        for c in found["cells"]:
            sums = np.minimum(sums + np.frombuffer(c.as_buffer(), dtype=kind), least).astype(kind)
        return sums

    def row(key, data):
        return pa.table({"m": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([data], pa.binary())})

    parts = merged(stored(d.mapInArrow(count, schema)), ["m", "block"], lambda key, found: row(key, total(found).tobytes()), schema, lambda key, found: row(key, np.packbits(total(found) >= least).tobytes()))
    out = np.zeros((LONGEST - 2, 1 << bits >> 3), dtype=np.uint8)
    for r in parts.collect():
        out[r["m"] - 3, r["block"] * (width >> 3) : (r["block"] + 1) * (width >> 3)] = np.frombuffer(r["cells"], dtype=np.uint8)
    trim()
    return out


def windows(d: DataFrame, words: tuple[np.ndarray, int], pairs: tuple[np.ndarray, int], runs: tuple[np.ndarray, int]) -> DataFrame:
    """Projected occurrences (lang, w1 to w5, n): a frequent pair and the words after it that may be frequent with it; and the
    spelling of words of frequent pairs (w1, word)."""
    shape = pa.schema([("lang", pa.string()), *[(w, pa.int64()) for w in _W], ("n", pa.int64()), ("word", pa.string())])

    def project(batches):
        langs: dict[str, int] = {}
        told: set[int] = set()
        held, size = [], 0

        def out():
            lang, w = (np.concatenate(x) for x in zip(*held, strict=True))
            key = lang.astype(np.uint64)
            for k in range(LONGEST):
                key = mix(key * _PAIR + w[:, k])
            order = np.argsort(key, kind="stable")
            lang, w, key = lang[order], w[order], key[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (lang[1:] != lang[:-1]) | (w[1:] != w[:-1]).any(axis=1)))
            at = np.flatnonzero(new)
            names = np.array(list(langs), dtype=object)
            n = np.diff(np.append(at, len(new)))
            columns = [pa.array(w[at, k].view(np.int64), mask=w[at, k] == 0) for k in range(LONGEST)]
            return pa.RecordBatch.from_arrays([pa.array(names[lang[at]], pa.string()), *columns, pa.array(n.astype(np.int64)), pa.nulls(len(at), pa.string())], schema=shape)

        for t in each_text(batches, langs):
            ok = frequent_runs(t, words, pairs)
            begin = np.flatnonzero(ok)
            if not len(begin):
                continue
            w, length = np.zeros((len(t.id), LONGEST), dtype=np.uint64), np.full(len(t.id), 2)
            for m, at, key in longer(t, ok):  # a run's beginning must be let through before it
                at = at[has(runs[0][m - 3], runs[1], key) & (length[at] == m - 1)]
                length[at] = m
                w[at, m - 1] = t.id[at + m - 1]
            whole = np.flatnonzero(length > 2)
            if len(whole):
                w[whole, 0], w[whole, 1] = t.id[whole], t.id[whole + 1]
                held.append((t.lang[whole], w[whole]))
                size += len(whole)
            ids, first = np.unique(np.concatenate((t.id[begin], t.id[begin + 1])), return_index=True)
            where = np.concatenate((begin, begin + 1))[first]
            new = [k for k in range(len(ids)) if int(ids[k]) not in told]
            if new:
                told.update(ids[new].tolist())
                told = told if len(told) < SPELT else set()
                none = pa.nulls(len(new), pa.int64())
                spelt = pa.array([t.spelling(where[k]) for k in new], pa.string())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.string()), pa.array(ids[new].view(np.int64)), none, none, none, none, none, spelt], schema=shape)
            if size > FLUSH // 2:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        held.clear()
        trim()

    return d.mapInArrow(project, f"lang string, {', '.join(w + ' long' for w in _W)}, n long, word string")


def grow(w: np.ndarray, on: np.ndarray, n: np.ndarray, least: int, first: int, end: int, depth: int, lang: np.ndarray):
    """(row, length, count) of the phrases whose occurrences are the rows first to end, by extending them to the right.

    Rows are sorted, so each extension of a prefix is a run of them. One that touches an edge of the batch may go on in
    another: it is passed on and extended with whatever count it has here.
    """
    rows = slice(first, end)
    here = np.flatnonzero(on[rows, depth])
    if not len(here):
        return
    a = first + here[0]  # rows that end before come first
    x, more = w[a:end, depth], lang[a:end]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | ((more[1:] != more[:-1]) if depth == 0 else False)))
    at = np.flatnonzero(new)
    sums = np.add.reduceat(n[a:end], at)
    ends = np.append(at[1:], end - a)
    for k in np.flatnonzero((sums >= least) | (at + a == 0) | (ends + a == len(w))):
        low, high = int(at[k]) + a, int(ends[k]) + a
        if depth > 1:  # pairs are counted already
            yield low, depth + 1, int(sums[k])
        if depth + 1 < LONGEST:
            yield from grow(w, on, n, least, low, high, depth + 1, lang)


def grown(projected: DataFrame, least: int) -> DataFrame:
    """(lang, words, a) of the phrases of three words or more with a count of `least`."""

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = np.column_stack([batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in _W])
            on = np.column_stack([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in _W])
            lang = batch["lang"].dictionary_encode().indices.to_numpy()
            found = list(grow(w, on, batch["n"].to_numpy(), least, 0, len(w), 0, lang))
            if found:
                rows = [f[0] for f in found]
                words = pa.array([w[row, :length].tolist() for row, length, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["lang"].take(pa.array(rows)), words, pa.array([f[2] for f in found], pa.int64())], ["lang", "words", "a"])

    keys = [F.asc_nulls_first(c) for c in ("lang", *_W)]
    parts = projected.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(each, "lang string, words array<long>, a long")
    return parts.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(found: DataFrame, words: DataFrame, total: DataFrame) -> DataFrame:
    """found (lang, words, a) with l, r, n and score of its lowest-scoring cut."""
    f = stored(found.union(words.select("lang", F.array("w").alias("words"), F.col("n").alias("a"))))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = found.select("lang", "words", "a", k)
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("__left"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("__right"))
    for side, name in (("__left", "l"), ("__right", "r")):
        cuts = cuts.join(f.select("lang", F.col("words").alias(side), F.col("a").alias(name)), ["lang", side])
    score = "cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    cuts = cuts.join(total, "lang").withColumn("score", F.expr(score))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    return best.select("lang", "words", *[F.col(f"x.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def uncovered(found: DataFrame, percent: int) -> DataFrame:
    """found without the phrases inside a longer one of at least `percent` of their count."""
    longer = found.where(F.size("words") > 2)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda k: F.slice("words", k, m))))
    most = longer.select("lang", "a", F.explode(inner).alias("words")).groupBy("lang", "words").agg(F.max("a").alias("__most"))
    return found.join(most, ["lang", "words"], "left").where(F.col("__most").isNull() | (100 * F.col("__most") < percent * F.col("a"))).drop("__most")


@tidy
def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    ship(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = stored(counted(d, lambda t: (t.id, t.lang), "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")))
    total = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("n") >= least)
    bits = bits_for(words.count())
    frequent = (id_bitmap(words, bits), bits)

    def frequent_pairs(t):
        on = has(*frequent, t.id)
        at = np.flatnonzero(t.joint[:-1] & on[:-1] & on[1:])
        return mix(t.id[at] * _PAIR + t.id[at + 1]), t.id[at], t.id[at + 1]

    def ids(batches):
        for b in batches:
            w1, w2 = (b[c].to_numpy().view(np.uint64) for c in ("w1", "w2"))
            yield pa.RecordBatch.from_arrays([pa.array(mix(w1 * _PAIR + w2).view(np.int64))], ["w"])

    pairs = stored(counted(d, frequent_pairs, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    occurrences = pairs.agg(F.count("*"), F.sum("n")).first()
    bits = bits_for(occurrences[0])
    frequent_two = (id_bitmap(pairs.mapInArrow(ids, "w long"), bits), bits)
    bits = int(min(SKETCH_BITS, max(12, math.ceil(math.log2((occurrences[1] or 1) / 8)))))
    projected = stored(windows(d, frequent, frequent_two, (sketches(d, frequent, frequent_two, bits, least), bits)))
    two = pairs.join(words.select("lang", F.col("w").alias("w1")), "w1").select("lang", F.array("w1", "w2").alias("words"), F.col("n").alias("a"))
    found = stored(two.union(grown(projected.where("word is null").drop("word"), least)))
    best = stored(uncovered(scored(found, words, total), percent))
    spelt = projected.where("word is not null").groupBy(F.col("w1").alias("w")).agg(F.min("word").alias("word"))
    each = best.select("lang", "words", F.posexplode("words").alias("pos", "w")).join(spelt, "w")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    said = best.join(each.groupBy("lang", "words").agg(phrase.alias("phrase")), ["lang", "words"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = said.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of two to five words that occur 100 times or more in documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with t as (select coalesce(lang, 'und') lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda y: y <> '') ws from p),
n as (select lang, sum(len(ws))::bigint n from w group by 1),
e as (select lang, ws, k, m from w, range(1, 6) a(m), lateral (select unnest(range(1, len(ws) - m + 2)) k)),
f as (select lang, m, array_to_string(ws[k:k + m - 1], ' ') phrase, count(*) f from e group by 1, 2, 3 having count(*) >= 100),
c as (select lang, m, phrase, f a, string_split(phrase, ' ') ws from f where m >= 2),
cut as (select c.*, k, array_to_string(ws[1:k], ' ') lp, array_to_string(ws[k + 1:], ' ') rp from c, range(1, 5) b(k) where k < m),
s as (select cut.lang, cut.phrase, cut.a, cut.k, fl.f l, fr.f r, n.n, ((1000::hugeint * cut.a * n.n) // (fl.f::hugeint * fr.f))::bigint score
  from cut join f fl on fl.lang = cut.lang and fl.phrase = lp join f fr on fr.lang = cut.lang and fr.phrase = rp join n on n.lang = cut.lang),
b as (select lang, phrase, any_value(a) a, any_value(n) n, arg_min({'l': l, 'r': r, 's': score}, (score, k)) x from s group by 1, 2),
inner_ as (select c.lang, array_to_string(ws[k:k + g - 1], ' ') phrase, max(a) most from c, range(2, 5) h(g), lateral (select unnest(range(1, m - g + 2)) k) where g < m group by 1, 2),
u as (select b.* from b left join inner_ i on i.lang = b.lang and i.phrase = b.phrase where most is null or 100 * most < 100 * a)
select * from (select lang, row_number() over (partition by lang order by x.s desc, a desc, encode(phrase)) rank, phrase, a, x.l l, x.r r, n, x.s score from u) where rank <= 2000
"""
