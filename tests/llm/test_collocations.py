"""Collocations against plain counting, with hot prefixes over many batches, odd texts and large numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from reference import lower

from chronolith.llm import collocations as c


def plain(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    held[p[k : k + m]] = max(held[p[k : k + m]], a)
        best = []
        for p, a in some.items():
            if held[p] < a:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), l, r))
        out |= {(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)}
    return out


def got(spark, rows, least, top, batch=10_000, **extra):
    d = spark.createDataFrame(rows, "lang string, text string").withColumns({x: F.lit("x") for x in ("w", "n", "words", "a", "word", "rank", "k")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        return {tuple(r) for r in c.collocations(d.repartition(5), least=least, top=top).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def texts(seed, n=80):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "b", "é", "Ñandú", "x-y", "İ"] + [f"w{k}" for k in range(8)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", ".", "\n", ":!"]) for _ in range(rng.randrange(60))]
        out.append((rng.choice(["en", "en", "en", "fr", None]), rng.choice([" ", "  ", "\t"]).join(w)))
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_equals_plain_counting(spark, batch):
    rows = texts(1) + [("en", "of the of the of the of the the the the")] * 40 + [(None, None), ("de", ""), ("de", " \t\n.,"), ("en", "one"), ("xx", None)]
    assert got(spark, rows, 6, 25, batch) == plain(rows, 6, 25)


def test_one_very_long_text(spark):
    rows = [("en", " ".join(f"a b c{k % 3} d" for k in range(9000)))] + texts(2, 20)
    assert got(spark, rows, 50, 2000, 500) == plain(rows, 50, 2000)


def test_large_numbers(spark):
    found = spark.createDataFrame([("en", [1, 2], 5 * 10**14)], "lang string, words array<long>, a long")
    words = spark.createDataFrame([("en", 1, 6 * 10**14), ("en", 2, 7 * 10**14)], "lang string, w long, n long")
    total = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    r = c.scored(found, words, total).first()
    assert r["score"] == 1000 * 5 * 10**14 * 9 * 10**15 // (6 * 10**14 * 7 * 10**14)


def test_ties_and_nothing(spark):
    rows = [("en", "b c. a b")] * 5 + [("en", "z z z")]
    assert got(spark, rows, 5, 1) == plain(rows, 5, 1) and got(spark, rows, 5, 9) == plain(rows, 5, 9)
    assert got(spark, rows[:0], 5, 9) == set() and got(spark, rows, 500, 9) == set()
