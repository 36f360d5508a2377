"""Conversation repair against a plain search over all edits, on small, odd and split conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronolith.llm import conversation_repair as repair

CONV = "conv_id bigint, turn bigint, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        k, role, text = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20, sp(role), sp(text)
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) by whole audits as strings, inserts of up to three in a row."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    inserted = lambda best: {s: min(v for v in [best.get(s), *[(c + 3, a + "I", out + (name + ":",)) for q, (c, a, out) in best.items() for x, name in (("u", "user"), ("a", "assistant")) if NEXT.get((q, x)) == s]] if v) for s in ("", "s", "u", "a") if s in best or any(NEXT.get((q, x)) == s for q in best for x in "ua")}
    best = {"": (0, "", ())}
    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        ways = []  # inserts before the turn: all, not only the cheapest of a state
        layer = [(q, *v) for q, v in best.items()]
        for _ in range(4):
            ways += layer
            layer = [(NEXT[q, x], c + 3, a + "I", out + (name + ":",)) for q, c, a, out in layer for x, name in (("u", "user"), ("a", "assistant")) if (q, x) in NEXT]
        new = {}
        for q, c, a, out in ways:
            found = [(q, c + 4, a + "D", out)]
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if (q, role[:1]) in NEXT:
                    found.append((NEXT[q, role[:1]], c + more, a + "K", out + (f"{role}:{text}",)))
                found += [(NEXT[q, x], c + 3 + more, a + "R", out + (f"{name}:{text}",)) for x, name in (("u", "user"), ("a", "assistant")) if (q, x) in NEXT]
            for s, *v in found:
                new[s] = min(new.get(s, (10**9,)), tuple(v))
        best = new
    for _ in range(3):
        best = inserted(best)
    cost, audit, out = min(best[q] for q in ("", "a") if q in best)
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (*[kinds.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, out)


def checked(spark, rows, partitions=None):
    t = repair.damaged(repair.turns(spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("digest", "piece", "first", "audit", "cost")})))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        told = repair.report(t)
        got = {r["conv_id"]: tuple(r[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in told.collect()}
        gaps = {r["conv_id"]: r["gaps"] for r in told.collect()}
        fixed = repair.repaired(t, told)
        said = {}
        for r in sorted(fixed.collect(), key=lambda r: r["pos"]):
            said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(fixed).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    after = {}
    for r in plain_damage(rows):
        after.setdefault(r[0], []).append(r)
    assert set(got) == set(after)
    for c, rs in after.items():
        *want, out = plain_repair(rs)
        assert got[c] == tuple(want), (c, rs)
        assert tuple(said.get(c, ())) == out
        assert digests.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(out).encode()).hexdigest()
        turns = [r[1] for r in rs if r[1] is not None]
        assert gaps[c] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    return got


def test_random_conversations(spark):
    rng = random.Random(5)
    words = ["Well.", "no", "why?", "Well.", " \t", None, "end.  ", "a.b"]
    rows = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), rng.choice(words)) for c in range(60) for _ in range(rng.randrange(1, 9))]
    checked(spark, rows)


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(6)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system", "user"]), rng.choice([f"t{k}.", f"t{k}", "same.", ""])) for k in range(400)]
    rows += [(2, 3, "user", "again.")] * 50 + [(0, 1, "system", "x."), (3, None, None, None)]
    got = checked(spark, rows, partitions="13")
    assert len(got[1][5].replace("I", "")) >= 300


def test_pieces_equal_the_whole():
    rng = random.Random(7)
    for _ in range(200):
        steps = [(rng.choice("suat"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randrange(1, 25))]
        cuts = sorted({0, len(steps), *[rng.randrange(len(steps) + 1) for _ in range(3)]})

        def go(run, part):
            for initial, truncated, dead in part:
                run.deleted(1) if dead else run.turn(initial, truncated)
            return run

        whole = go(repair.Run(0), steps)
        cost, q = repair.last_of(whole.vector)
        runs = [[go(repair.Run(s), steps[a:b]) for s in range(4)] for a, b in zip(cuts, cuts[1:], strict=False)]
        total, way = repair.strung([([r.base + v[0] if v else None for r in rs for v in r.vector], [v[1] if v else None for r in rs for v in r.vector]) for rs in runs])
        assert total == whole.base + cost
        assert "".join(rs[a].audit(b) for rs, (a, b) in zip(runs, way, strict=True)) + repair.ENDS[way[-1][1]] == whole.audit(q) + repair.ENDS[q]


def test_state_vectors_are_few():
    rng = random.Random(8)
    run = repair.Run(0)
    for _ in range(20_000):
        run.turn(rng.choice("suat"), rng.random() < 0.5)
    assert len(repair._steps) < 3000


@pytest.mark.parametrize("rows", [[], [(1, 1, "user", "")]])
def test_empty(spark, rows):
    t = repair.damaged(repair.turns(spark.createDataFrame(rows, CONV)))
    told = repair.report(t)
    assert told.count() == len(rows) and repair.repaired(t, told).count() == 0
