"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on, merged by aggregation; lines whose estimate is
near the threshold get exact distinct counts; lines on `min_sites` sites or more are cross-site boilerplate and go
everywhere but at their first occurrence (smallest doc_id, then position; so that a passage is never lost from the
corpus). `keep_first=False` removes that one too. What goes is kept as a mask of a byte a line, so that a text of very many lines
takes time in proportion.

Lines are what `\n` separates, compared without the spaces around them; blank lines are never boilerplate.
DataFrame functions only.

Defined results: a null text stays null and a text without boilerplate stays as it is; a document of boilerplate only
becomes an empty text, its row stays; a null site counts for no site; rows without doc_id are cleaned by the same
lines but hold no first occurrence; rows that share a doc_id are taken as one document for the first occurrence, and each
loses its own lines: what goes is kept by id and text together. All columns of docs are returned unchanged but for the text, whatever
their names, except that `__n_lines` and `__n_removed` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy

#: log2 of a sketch's registers; its standard error is about 1.04 / sqrt(4096), 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over five standard errors.
NEAR = 0.1


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines (h, site, doc_id, pos): (h, first) of the lines that occur on min_sites distinct sites or more."""
    spread = stored(
        lines.groupBy("h").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
            F.count("*").alias("n"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"),
        ).where(F.col("n") >= min_sites)
    )
    low, high = min_sites * (1 - NEAR) - 0.5, min_sites * (1 + NEAR) + 0.5
    near = stored(spread.where(F.col("sites").between(low, high)))
    exact = lines.join(near.select("h"), "h", "left_semi").where("site is not null").groupBy("h", "site").agg(F.count("*").alias("n"))
    exact = exact.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return stored(spread.where(F.col("sites") > high).select("h", "first").union(near.join(exact.select("h"), "h").select("h", "first")))


def mask(gone: Column) -> Column:
    """A byte for each line up to the last of `gone`, rising positions: 1 if it goes, 0 if it stays."""
    steps = F.transform(gone, lambda pos, k: F.concat(F.repeat(F.lit("0"), pos - F.when(k > 0, F.get(gone, k - 1)).otherwise(-1) - 1), F.lit("1")))
    return F.array_join(steps, "").cast("binary")


@tidy
def line_dedup(
    docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep_first: bool = True
) -> DataFrame:
    """docs with its text cleaned, and n_lines and n_removed added as `__n_lines`, `__n_removed` (docs may not have these two)."""
    if clash := {"__n_lines", "__n_removed"} & set(docs.columns):
        raise ValueError(f"docs has columns that are to be added: {sorted(clash)}")
    # the caller's columns are one struct, so none of them meets a name used here
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    id_, text, site = (F.col("own").getField(c) for c in (id_col, text_col, site_col))
    # what goes from a row depends on its id and text only, so a hash of both is its key; it is never null
    d = d.withColumn("row", F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))))
    split = F.split(text, "\n", -1)
    each = d.select("row", id_.alias("doc_id"), site.cast("string").alias("site"), F.posexplode(split).alias("pos", "line"))
    h = F.unhex(F.md5(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")).cast("binary")))
    lines = each.where(F.length(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c"))) > 0).select("row", "doc_id", "site", "pos", h.alias("h"))
    lines = stored(lines)
    bad = boilerplate(lines, min_sites)
    hit = lines.join(bad.hint("merge"), "h")  # as a sort-merge join a frequent line can be split
    if keep_first:
        hit = hit.where(~F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")), F.lit(False)))
    gone = stored(hit.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    gone = gone.select("row", F.size("gone").cast("long").alias("n_gone"), mask(F.col("gone")).alias("mask"))
    out = d.join(gone.hint("merge"), "row", "left")
    # a line's byte in the mask is found by its place, so the work is linear in the lines
    kept = F.filter(split, lambda line, i: F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    clean = F.when(F.col("mask").isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [(clean if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("__n_lines"), F.coalesce("n_gone", F.lit(0)).cast("long").alias("__n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, the lines removed and the SHA-256 of the text that is left."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = F.when(F.col("text").isNull() & (F.col("__n_removed") == 0), 0).otherwise(F.col("__n_lines"))
    return out.select("doc_id", n.alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
with e as (select doc_id, source, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents where text is not null),
l as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) t from e),
b as (select t, min({'d': doc_id, 'p': pos}) f from l where t <> '' group by 1 having count(distinct source) >= 5),
k as (select l.doc_id, l.pos, l.line, b.t is not null and not (l.doc_id = b.f.d and l.pos = b.f.p) gone from l left join b using (t)),
c as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') t from k group by 1)
select d.doc_id, coalesce(c.n_lines, 0) n_lines, coalesce(c.n_removed, 0) n_removed, sha256(coalesce(c.t, '')) text_sha256
from documents d left join c on d.doc_id = c.doc_id
"""
