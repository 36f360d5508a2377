"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. With r = target / words of the source, each of its documents is taken
floor(r) whole times (certain copies); the words still missing are an order sample: a document of weight w has
inclusion probability p = min(1, c w) with c = missing / sum(w size), documents are ranked by the random odds
u / (1 - u) divided by the inclusion odds p / (1 - p) (p = 1 ranks first), and the first of the ranking are taken
up to the size that is missing, to the nearer side of the document that crosses it. The sample's size is fixed in
words, not in documents, so a source meets its target whatever its lengths, and where p is capped at 1.
u comes from a hash of the document's id: reruns agree.

Neither the sources nor a source's ranking are sorted in one task: ranks are summed in bins by aggregation, and only the bin in which a
source's target falls is refined, again by aggregation, until it holds a few rows.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in order;
rows that share an id have the same u, and their ranks follow their sizes; ties go by id, then size; rows alike in
all these are taken or left together. An empty table gives an empty result; further columns are
passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table, tidy

#: Each round of the cut tells 4096 bins of the bin before apart.
BITS, ROUNDS = 12, 4


def _ordered(s: DataFrame, *order: Column) -> DataFrame:
    """s stored sorted, with __part, the number of each row's range of the order: a window within a part and the sums of
    the parts before or after stand for one window over all rows."""
    return stored(s.orderBy(*order).withColumn("__part", F.spark_partition_id()))


def _around(s: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """s with sums over all parts before, or after, each row's own; there are as many parts as partitions of a shuffle."""
    up = Window.orderBy("__part")
    parts = s.groupBy("__part").agg(*[F.sum(e).alias(k) for k, e in (before | after).items()])
    sums = [F.sum(k).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias(k) for k in before] + [F.sum(k).over(up.rowsBetween(1, Window.unboundedFollowing)).alias(k) for k in after]
    parts = stored(parts.select("__part", *sums))
    return s.join(F.broadcast(parts), "__part").fillna(0, [*before, *after])


@tidy
def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with target: `share` of all words by weight, none above `most` times its size.

    What is above is shared anew by weight until none is above: the fixed point is min(cap, level * weight), found
    with a sorted running sum over the sources, of which there is one row each; ranges of them are summed apart.
    """
    name = F.col("source").asc_nulls_last()
    s = _around(_ordered(sources.select("source", "source_size"), name), {"__n": F.lit(1)}, {})
    turn = F.pmod(F.col("__n") + F.row_number().over(Window.partitionBy("__part").orderBy(name)) - 1, F.lit(len(weights)))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).select("source", "source_size", "w", "cap")
    by_fill = [F.col("cap") / F.col("w"), name]
    s = _around(_ordered(s, *by_fill), {"filled": F.col("cap")}, {"open_w": F.col("w")})
    own = Window.partitionBy("__part").orderBy(*by_fill)
    back = Window.partitionBy("__part").orderBy((F.col("cap") / F.col("w")).desc(), F.col("source").desc_nulls_first())
    s = s.withColumn("filled", F.col("filled") + F.coalesce(F.sum("cap").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_w", F.col("open_w") + F.sum("w").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    total = s.agg(F.sum("source_size")).first()[0]
    s = stored(s.withColumn("level", (F.lit(float(share)) * F.lit(total) - F.col("filled")) / F.col("open_w")))
    # sorted by cap / weight, the first source that its level does not fill has the common level, and the highest such
    level = s.agg(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))).first()[0]
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.lit(level) * F.col("w")), F.col("cap")).alias("target"))


def uniform(id_col: str) -> Column:
    """A number strictly between 0 and 1 from 48 bits of the id's MD5."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


@tidy
def pareto_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (doc_id, source, size long, weight double) and plan (source, source_size, target), one row a source.

    Returns sized with source_size, target, copies (whole copies, the sampled one included), taken (copies * size); columns
    of sized that have these names are replaced. Weights are positive; a row of weight 0 or null is only taken as a certain copy.
    """
    sized = sized.drop("source_size", "target", "copies", "taken")
    total = sized.where("size > 0 and weight > 0").groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("weight") * F.col("size")).alias("__ww"))
    plan = plan.select("source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    plan = plan.withColumn("__whole", F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("__missing", F.col("__target") - F.col("__whole") * F.col("__source_size"))
    plan = plan.join(total, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("__c", F.col("__missing") / F.col("__ww"))
    plan = stored(plan.drop("__s", "__ww").withColumnRenamed("source", "__s"))
    with_plan = sized.join(plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("__u", uniform("doc_id"))

    p = F.least(F.lit(1.0), F.col("__c") * F.col("weight"))
    odds = F.col("__u") / (1 - F.col("__u")) * (1 - p) / p
    rank = odds / (1 + odds)  # orders as the odds do
    live = with_plan.where("size > 0 and weight > 0 and __missing > 0")
    ranked = stored(live.select("doc_id", "source", "size", F.col("__missing").alias("missing"), rank.alias("r")))

    cut = stored(_cut(ranked)).withColumnsRenamed({"source": "__s", "cut_r": "__cut_r", "cut_id": "__cut_id", "cut_size": "__cut_size"})  # a row a source
    chosen = F.coalesce(F.struct(rank, "doc_id", "size") <= F.struct("__cut_r", "__cut_id", "__cut_size"), F.lit(False))
    out = with_plan.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left")
    picked = F.when((F.col("size") > 0) & (F.col("weight") > 0) & (F.col("__missing") > 0) & chosen, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("__whole") + picked).otherwise(0).cast("long")
    out = out.withColumns({"copies": copies, "source_size": F.col("__source_size"), "target": F.col("__target")})
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*sized.columns, "source_size", "target", "copies", "taken")


def _cut(ranked: DataFrame) -> DataFrame:
    """(source, cut_r, cut_id, cut_size): the last row of each source's ranking that is taken."""
    at = ranked.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0.0)})
    for k in range(1, ROUNDS + 1):
        at = at.withColumn("bin", F.floor(F.col("r") * F.lit(float(1 << BITS * k))).cast("long"))
        bins = at.groupBy("source", "missing", "before", "bin").agg(F.sum("size").cast("double").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        # the first bin that reaches what is missing; the last bin if, by rounding, none does
        edge = bins.groupBy("source").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("missing"), F.struct("bin", (F.col("upto") - F.col("words")).alias("b")))),
                       F.max(F.struct("bin", (F.col("upto") - F.col("words")).alias("b")))).alias("e"))
        edge = stored(edge.select(F.col("source").alias("s4"), F.col("e.bin").alias("edge"), F.col("e.b").alias("b")))
        at = at.drop("before", "prefix").join(edge, F.col("source").eqNullSafe(F.col("s4")) & (F.col("bin") == F.col("edge"))).drop("s4", "edge")
        at = stored(at.withColumnsRenamed({"b": "before", "bin": "prefix"}))
    # rows alike in rank, id and size count as one of their summed size, so any number of them is one row here
    alike = at.groupBy("source", "r", "doc_id", "size", "missing", "before").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("r", "doc_id", "size")
    last = alike.withColumn("start", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size"))
    last = last.where(2 * (F.col("missing") - F.col("start")) >= F.col("size"))
    kept = last.groupBy("source").agg(F.max(F.struct("r", "doc_id", "size")).alias("k"))
    # none of the last bin is taken: the cut lies just below it
    floor = at.groupBy("source").agg(F.min("r").alias("least"))
    kept = kept.withColumnRenamed("source", "s5")
    return floor.join(kept, F.col("source").eqNullSafe(F.col("s5")), "left").select(
        "source", F.coalesce("k.r", F.col("least")).alias("cut_r"), F.when(F.col("k").isNotNull(), F.col("k.doc_id")).alias("cut_id"), F.col("k.size").alias("cut_size"))


@tidy
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = stored(docs.withColumn("weight", F.col("size").cast("double")))
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), [3, 1, 2], 1.5, 2.0)
    return pareto_mix(docs, plan).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) i from d group by 1),
w as (select *, [3e0, 1e0, 2e0][((i - 1) % 3 + 1)::int] w, 2e0 * source_size cap from s),
f as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0e0) filled,
        sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) open_w from w),
l as (select *, (1.5e0 * sum(source_size) over () - filled) / open_w lv from f),
l2 as (select *, max(case when lv * w <= cap then lv end) over () level from l),
t as (select source, source_size, coalesce(least(cap, level * w), cap) target from l2),
t2 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint whole from t),
c as (select t2.*, target - whole * source_size missing from t2),
q as (select source, sum(size::double * size) ww from d where size > 0 group by 1),
r as (
  select d.doc_id, d.source, d.size, c.source_size, c.target, c.whole, c.missing, least(1e0, c.missing / q.ww * size) p,
    (('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 12))::bigint::double + 0.5e0) / 281474976710656e0 u
  from d join c on d.source is not distinct from c.source left join q on d.source is not distinct from q.source),
o as (select *, u / (1 - u) * (1 - p) / p odds from r),
k as (select *, odds / (1 + odds) rk from o),
a as (select *, sum(size) over (partition by source order by rk, doc_id, size rows between unbounded preceding and current row) - size start_
      from k where size > 0 and missing > 0)
select k.doc_id, k.size, k.source_size, k.target,
  (case when k.size > 0 then k.whole + case when 2 * (k.missing - a.start_) >= k.size then 1 else 0 end else 0 end)::bigint copies,
  ((case when k.size > 0 then k.whole + case when 2 * (k.missing - a.start_) >= k.size then 1 else 0 end else 0 end) * k.size)::bigint taken
from k left join a on k.doc_id is not distinct from a.doc_id and k.source is not distinct from a.source
"""
