"""Conversation structure repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic program.

A conversation's turns, in order, are kept, reroled, deleted or preceded by inserted empty turns so that the initials of
the roles read `(s?(ua)+)?`. Each turn takes one macro edit: a run of inserts and what happens to the turn itself, written
I*(K|R|D). No such code is a prefix of another, so audits of as many turns compare as the sequences of their codes: a state
needs the rank of its best audit among those of the other states instead of the audit, and a pointer to the state before.
The audit is written out afterwards, backwards along the pointers.

States are what the repaired roles read so far: 0 nothing, 1 `s`, 2 up to a `u`, 3 up to an `a`. A run of three inserts does what a
run of one does, so runs of at most two are looked at. A state that costs over SPREAD more than another can't lead to
a cheapest repair, as ten at most make the other's continuations as good; so state vectors, costs less their least, are few, and
each step from one is worked out once (`_step`) and looked up afterwards.

A conversation may hold a third of all rows: rows are dealt by ranges of (conversation, turn), so that one may lie in many
tasks. What lies at a task's edges becomes a piece, a matrix of costs and ranks from each state to each; pieces are strung
together by ranks, one small row each, and the audits of the chosen ones are put in order. Equal rows of one turn are one row
with a count. Only the repaired turns of one conversation, sorted, pass through one task as a stream, since they have an order.

Defined results: null text, role, turn and conversation count as one space where text or keys are made of them; a null turn comes first; rows
of one turn are in the order of role, then of the MD5 of the text; a role with another initial than s, u, a is never kept as it is; a
conversation without turns has the empty repair. Columns besides the four are passed over, whatever their names. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table, tidy

#: Costs of the edits; an undeleted truncated turn costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Macro edits in ASCII order, which is their order as codes.
CODES = sorted(i + e for i in ("", "I", "II") for e in "KRD")
#: What is left to insert after the last turn, from each state.
ENDS = ("", "II", "I", "")
SPREAD = 12
#: The repaired roles' next state by an inserted or reroled turn, and by a kept one.
MADE = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {2: "user", 3: "assistant"}

Vector = tuple[tuple[int, int] | None, ...]
_steps: dict[tuple[Vector, str, bool], tuple[int, Vector, tuple]] = {}


def start(state: int) -> Vector:
    return tuple((0, 0) if q == state else None for q in range(4))


def _step(vector: Vector, initial: str, truncated: bool) -> tuple[int, Vector, tuple]:
    """What a live turn makes of a state vector (cost, rank): (cost taken off, vector, (state before, code) of each state)."""
    if (known := _steps.get((vector, initial, truncated))) is not None:
        return known
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for q, at in enumerate(vector):
        if at is None:
            continue
        for code, macro in enumerate(CODES):
            to, cost = q, at[0]
            for _ in macro[:-1]:
                to, cost = MADE[to], cost + INSERT
            if macro[-1] == "D":
                cost += DELETE
            elif macro[-1] == "R":
                to, cost = MADE[to], cost + REROLE + TRUNCATED * truncated
            elif (to, initial) in KEPT:
                to, cost = KEPT[to, initial], cost + KEEP + TRUNCATED * truncated
            else:
                continue
            found = (cost, at[1], code, q)
            if best[to] is None or found < best[to]:
                best[to] = found
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] <= least + SPREAD else None for b in best]
    order = sorted(b[1:3] for b in best if b)
    out = least, tuple((b[0] - least, order.index(b[1:3])) if b else None for b in best), tuple((b[3], CODES[b[2]]) if b else None for b in best)
    _steps[vector, initial, truncated] = out
    return out


class Run:
    """The program from one state on: cost taken off so far, vector, and a layer of pointers each turn (or a number of deletes)."""

    def __init__(self, state: int):
        self.base, self.vector, self.layers = 0, start(state), []

    def turn(self, initial: str, truncated: bool) -> None:
        cost, self.vector, back = _step(self.vector, initial, truncated)
        self.base += cost
        self.layers.append(back)

    def deleted(self, n: int) -> None:
        """n turns that must go. Inserts never come before one: after it they cost the same and D is before I."""
        self.base += DELETE * n
        self.layers.append(n)

    def audit(self, state: int) -> str:
        out = []
        for layer in reversed(self.layers):
            if isinstance(layer, int):
                out.append("D" * layer)
            else:
                state, code = layer[state]
                out.append(code)
        return "".join(reversed(out))


def last_of(vector: Vector) -> tuple[int, int]:
    """(cost of the ending, state) of the cheapest repair."""
    found = [(at[0] + INSERT * len(ENDS[q]), at[1], ENDS[q], q) for q, at in enumerate(vector) if at]
    cost, _, _, q = min(found)
    return cost, q


def strung(pieces: list[tuple[list, list]]) -> tuple[int, list[tuple[int, int]]]:
    """pieces, (costs, ranks) by 4 * from + to with None for no way: the least cost and each piece's (from, to)."""
    base, vector, back = 0, start(0), []
    for costs, ranks in pieces:
        best: list[tuple | None] = [None] * 4
        for q, at in enumerate(vector):
            for to in range(4):
                if at and costs[4 * q + to] is not None:
                    found = (at[0] + costs[4 * q + to], at[1], ranks[4 * q + to], q)
                    best[to] = found if best[to] is None or found < best[to] else best[to]
        least = min(b[0] for b in best if b)
        order = sorted(b[1:3] for b in best if b)
        base += least
        vector = tuple((b[0] - least, order.index(b[1:3])) if b else None for b in best)
        back.append([b[3] if b else None for b in best])
    cost, q = last_of(vector)
    way = []
    for b in reversed(back):
        way.append((b[q], q))
        q = b[q]
    return base + cost, way[::-1]


# ---------------------------------------------------------------- rows


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns under their usual names, without nulls in role and text, and the MD5 of each text."""
    d = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), spaced(F.col(role_col)).alias("role"), spaced(F.col(text_col)).alias("text"))
    return d.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def damaged(t: DataFrame) -> DataFrame:
    """turns with faults by the CRC of conversation and turn, one in twenty each: dropped, emptied, without its ends of
    sentences, repeated, set to user."""
    k = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    t = t.where(k != 0)
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(k == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(k == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__time")).drop("__time")
    return t.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


SPACE = r"[\x20\x09-\x0D]"


def faults(t: DataFrame) -> DataFrame:
    """One row for the equal rows of a turn: conv_id, turn, role, digest, copies, and what is wrong with the first of them.

    The first rows of texts said again are found by aggregation, and met again by a sort-merge join, which Spark can split.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    d = t.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.bool_or(blank).alias("blank"), F.bool_or(~ended).alias("truncated"))
    d = stored(d)
    told = d.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    told = told.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), "first")
    met = d.join(told.hint("merge"), d["conv_id"].eqNullSafe(F.col("c")) & (d["role"] == F.col("r")) & (d["digest"] == F.col("g")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("conv_id", "turn", "role", "digest", "copies", "blank", (~F.col("blank") & again).alias("duplicate"), (~F.col("blank") & ~again & F.col("truncated")).alias("truncated"))


ORDER = ("conv_id", "turn", "role", "digest")
STATS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}
PIECES = (
    "piece int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_role string, last_role string, costs array<long>, ranks array<int>, audits array<string>"
)


class Piece:
    """The rows that one task has of one conversation, in order."""

    def __init__(self, conv, opens: bool):
        self.conv = conv
        self.runs = {q: Run(q) for q in (range(4) if opens else (0,))}
        self.stats = dict.fromkeys(STATS, 0)
        self.turns, self.first_turn, self.last_turn, self.first_role, self.last_role = 0, None, None, None, None

    def add(self, turn, role: str, copies: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.first_role is None:
            self.first_role, self.first_turn = initial, turn
        else:
            self.stats["illegal"] += self.last_role + initial not in LEGAL
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.last_role = initial
        self.stats["illegal"] += copies - 1
        dead = copies if blank or duplicate else copies - 1
        self.stats["blank" if blank else "duplicate"] += dead
        self.stats["truncated"] += truncated
        for run in self.runs.values():
            if dead < copies:
                run.turn(initial, truncated)
            if dead:
                run.deleted(dead)

    def row(self, number: int, whole: bool) -> dict:
        out = {"conv_id": self.conv, "piece": number, "whole": whole, **self.stats, "turns": self.turns}
        out |= {k: getattr(self, k) for k in ("first_turn", "last_turn", "first_role", "last_role")}
        if whole:
            cost, q = last_of(self.runs[0].vector)
            return out | {"costs": [self.runs[0].base + cost], "ranks": [0], "audits": [self.runs[0].audit(q) + ENDS[q]]}
        ways = [(run, q, at) for run in self.runs.values() for q, at in enumerate(run.vector)]
        ways += [(None, 0, None)] * (16 - len(ways))
        return out | {
            "costs": [run.base + at[0] if at else None for run, _, at in ways],
            "ranks": [at[1] if at else None for _, _, at in ways],
            "audits": [run.audit(q) if at else None for run, q, at in ways],
        }


def pieces_of(d: DataFrame) -> DataFrame:
    """faults' rows, dealt by ranges and sorted, as pieces; a conversation that touches no edge of its task is whole."""
    from pyspark import TaskContext

    schema = f"conv_id {d.schema['conv_id'].dataType.simpleString()}, {PIECES}"
    types = pa.schema([("conv_id", _arrow(d, "conv_id"))] + _PIECE_TYPES)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, opens, out = TaskContext.get().partitionId(), None, True, []
        for batch in batches:
            for conv, turn, role, copies, blank, duplicate, truncated in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "copies", "blank", "duplicate", "truncated")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(number, not opens))
                        opens = False
                    now = Piece(conv, opens)
                now.add(turn, role, copies, blank, duplicate, truncated)
            if len(out) >= 4096:
                yield from pa.Table.from_pylist(out, types).to_batches()
                out = []
        if now is not None:
            out.append(now.row(number, False))
        if out:
            yield from pa.Table.from_pylist(out, types).to_batches()

    keys = [F.asc_nulls_first(c) for c in ORDER]
    return d.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(solve, schema)


_PIECE_TYPES = [
    ("piece", pa.int32()), ("whole", pa.bool_()), *[(k, pa.int64()) for k in (*STATS, "turns", "first_turn", "last_turn")],
    ("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())),
]


def _arrow(df: DataFrame, c: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[c].dataType)


def joined(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations in pieces.

    Pieces meet without their audits, a small row each and no more of them than there were tasks; the audits chosen are met afterwards.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("piece", kind="stable")
        none = lambda x: None if x is None or x != x else int(x)
        cost, way = strung([([none(x) for x in c], [none(x) for x in r]) for c, r in zip(pdf["costs"], pdf["ranks"], strict=True)])
        sums = {k: int(pdf[k].sum()) for k in (*STATS, "turns")}
        firsts, lasts = [none(x) for x in pdf["first_turn"]], [none(x) for x in pdf["last_turn"]]
        seen = [(a, b) for a, b in zip(firsts, lasts, strict=True) if b is not None]
        sums["turns"] -= sum(a[1] == b[0] for a, b in zip(seen, seen[1:], strict=False))
        roles = list(zip(pdf["last_role"], list(pdf["first_role"])[1:], strict=False))
        sums["illegal"] += sum(a + b not in LEGAL for a, b in roles)
        gaps = seen[-1][1] - seen[0][0] + 1 - sums["turns"] if seen else 0
        n = len(pdf)
        return pd.DataFrame({
            "conv_id": pdf["conv_id"], "piece": pdf["piece"], "pick": [4 * a + b for a, b in way], "ending": [""] * (n - 1) + [ENDS[way[-1][1]]],
            "gaps": [gaps] * n, **{k: [sums[k]] * n for k in STATS}, "cost": [cost] * n,
        })

    slim = pieces.drop("audits", "whole")
    told = slim.groupBy("conv_id").applyInPandas(one, f"conv_id {kind}, piece int, pick int, ending string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    told = told.withColumnRenamed("conv_id", "c").withColumnRenamed("piece", "p")
    met = pieces.select("conv_id", "piece", "audits").join(told, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    met = met.withColumn("audit", F.concat(F.get("audits", F.col("pick")), "ending"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    return met.groupBy("conv_id").agg(F.first("gaps").alias("gaps"), *[F.first(k).alias(k) for k in STATS], F.first("cost").alias("cost"), audit.alias("audit"))


def report(t: DataFrame) -> DataFrame:
    """One row a conversation that has turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    pieces = stored(pieces_of(faults(t)))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *STATS, F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.lit(0)).alias("audit"))
    return stored(whole.unionByName(joined(pieces.where("not whole"))))


def repaired(t: DataFrame, told: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, pos (from 0), role, text, edit (K, R or I).

    A conversation's audit and its turns meet in one task, sorted, and pass through as a stream; each partition has its
    conversations one after the other, positions rising.
    """
    schema = f"conv_id {t.schema['conv_id'].dataType.simpleString()}, pos long, role string, text string, edit string"
    types = pa.schema([("conv_id", _arrow(t, "conv_id")), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, pos, conv, out, size = "", 0, 0, 0, None, [], 0

        def put(role, text, how):
            nonlocal pos, size
            out.append((conv, pos, role, text, how))
            pos, size = pos + 1, size + len(text)

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, MADE[state]
                put(ROLE[state], "", "I")

        for batch in batches:
            for c, first, role, text, letters in zip(*(batch[k].to_pylist() for k in ("conv_id", "first", "role", "text", "audit")), strict=True):
                if first == 0:  # a new conversation
                    inserts()  # after the last turn of the one before
                    conv, audit, at, state, pos = c, letters, 0, 0, 0
                else:
                    inserts()
                    how, at = audit[at], at + 1
                    if how != "D":
                        state = MADE[state] if how == "R" else KEPT[state, role[:1]]
                        put(ROLE[state] if how == "R" else role, text, how)
                if size > 1 << 20 or len(out) > 1 << 14:
                    yield _columns(out, types)
                    out, size = [], 0
        inserts()
        if out:
            yield _columns(out, types)

    none = F.lit(None)
    heads = told.select("conv_id", F.lit(0).alias("first"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), none.cast("string").alias("text"), "audit")
    both = heads.unionByName(t.select("conv_id", F.lit(1).alias("first"), "turn", "role", "digest", "text", none.cast("string").alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "first", "turn", "role", "digest")]).mapInArrow(edit, schema)


def _columns(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` lines, from the frame that `repaired` returns, in its order."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    types = pa.schema([("conv_id", _arrow(turns, "conv_id")), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, out = None, None, []
        for batch in batches:
            for c, pos, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "pos", "role", "text")), strict=True):
                if pos == 0:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
            if len(out) > 1 << 14:
                yield _columns(out, types)
                out = []
        if h is not None:
            out.append((conv, h.hexdigest()))
        if out:
            yield _columns(out, types)

    return turns.mapInArrow(hashed, schema)


@tidy
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per original conversation: faults after the damage, the audit of its repair and the digest of what it then says."""
    ship(spark)
    original = turns(table(spark, sf_dir, "conversations"))
    t = damaged(original)
    told = report(t)
    said = digests(repaired(t, told)).withColumnRenamed("conv_id", "c")
    both = told.join(said, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    every = original.groupBy(F.col("conv_id").alias("c")).agg(F.lit(1).alias("one"))
    out = every.join(both, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", *STATS, "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: Every way of a live turn: state before, state after, code, cost, whether the turn stays, and what it is said by (null: its own role).
_WAYS = ", ".join(
    f"({q}, {to}, '{macro}', {cost}, {macro[-1] != 'D'}, {repr(said)}, {repr(need)})"
    for q in range(4)
    for macro in CODES
    for mid in [(q, MADE[q], MADE[MADE[q]])[len(macro) - 1]]
    for before in ["".join(ROLE[s] + ":\n" for s in (MADE[q], MADE[MADE[q]])[: len(macro) - 1])]
    for to, cost, said, need in (
        [(mid, DELETE, before, "")] if macro[-1] == "D" else [(MADE[mid], REROLE, before + ROLE[MADE[mid]], "")] if macro[-1] == "R" else [(KEPT[mid, i], KEEP, before, i) for i in "sua" if (mid, i) in KEPT]
    )
    for cost in [cost + INSERT * (len(macro) - 1)]
).replace("\\n", "' || chr(10) || '")

ORACLE = rf"""
with recursive crcs as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
k as (select o.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 k from o, crcs),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k = 3 then [1, 2] else [1] end) from k where k <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body from d),
f as (select *, left(role, 1) ini, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end fault,
  lag(left(role, 1)) over (partition by conv_id order by i) prev from n),
ways(q, t, code, cost, stays, said, need) as (values {_WAYS}),
dp as (
  select conv_id, 0::bigint i, 0 q, 0 cost, '' audit, '' said from (select distinct conv_id from f)
  union all
  select conv_id, i, q, cost, audit, said from (
    select *, row_number() over (partition by conv_id, q order by cost, audit) best from (
      select f.conv_id, f.i, ways.t q, dp.cost + ways.cost + case when stays and fault = 't' then 3 else 0 end as cost, audit || code audit,
        dp.said || ways.said || case when not stays then '' else case when code like '%K' then role else '' end || ':' || text || chr(10) end said
      from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join ways on ways.q = dp.q and (need = '' or need = ini) and (not stays or fault not in ('b', 'd'))
    )
  ) where best = 1),
ends as (select conv_id, cost + 3 * length(e) as cost, audit || e audit, said || more said, i from dp join (values (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 'assistant:' || chr(10)), (3, '', '')) x(eq, e, more) on eq = q),
fin as (select conv_id, arg_min(audit, (cost, audit)) audit, min(cost) as cost, arg_min(said, (cost, audit)) said from ends join (select conv_id c, max(i) m from f group by 1) on c is not distinct from conv_id and m = i group by 1),
st as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') as "duplicate", count(*) filter (fault = 't') truncated,
  count(*) filter (prev is not null and prev || ini not in ('su', 'ua', 'au')) illegal from f group by 1)
select e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') audit, sha256(coalesce(left(said, greatest(length(said) - 1, 0)), '')) repaired_sha256
from (select distinct conv_id from conversations) e left join st on st.conv_id is not distinct from e.conv_id left join fin on fin.conv_id is not distinct from e.conv_id
"""
