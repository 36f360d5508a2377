"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base spans are found by patterns within each text. Beside them, every bare token of 20 characters or more that mixes
letters and digits is a candidate. The values of all spans and candidates are hashed and aggregated over the corpus by
distinct repositories and owners, where copies of one text count once (for the least owner and repository among them):
a value of `max_owners` owners and `max_repos` repositories at most is owner-specific and live-looking, one of more owners or more
repositories is a widely copied example. Live-looking candidates are added as spans of the kind `owned`; base spans
always stay and are told apart by the counts n_live and n_example.

Positions are code points: running sums, over a row's matches in their order, of what lies between matches (split) and the matches
themselves (regexp_extract_all). Matches are rows there, so a text of very many takes time in proportion.

Defined results: a null text is empty and has no spans; a null owner is an owner of its own, and a null repository
likewise; repeated rows give the same spans each; an empty table gives an empty result; further columns are passed
over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, stored, table, tidy

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the least length has no longer run within it, so the length can be part of these two.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: A whole run of these characters, 20 or more of them.
BARE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")


def matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<k, i, g, hit>>: kind, number and text of each match, and the characters between it and the one before."""
    none = F.expr("cast(array() as array<struct<k:int,i:int,g:int,hit:string>>)")
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    item = lambda x, i: F.struct(F.lit(kind).alias("k"), i.alias("i"), x["g"].alias("g"), x["hit"].alias("hit"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(parts, item)).otherwise(none)


def spans(found: DataFrame) -> DataFrame:
    """found (row, k, i, g, hit, further columns): s, e and v of each match that counts.

    Assigned values need 12 characters; bare tokens a digit, a letter, and no base span that overlaps them.
    """
    order = Window.partitionBy("row", "k").orderBy("i")
    e = F.sum(F.col("g") + F.coalesce(F.char_length("hit"), F.lit(0))).over(order)
    found = found.withColumn("e", e.cast("int")).where("hit is not null")
    found = found.withColumn("s", F.col("e") - F.char_length("hit")).withColumn("v", F.when(F.col("k") == 0, F.regexp_extract("hit", ASSIGN, 1)).otherwise(F.col("hit")))
    found = found.where((F.col("k") != 0) | (F.char_length("v") >= 12)).drop("i", "g", "hit")
    base, before = F.col("k") < 3, (Window.unboundedPreceding, 0)
    ends = F.max(F.when(base, F.col("e"))).over(Window.partitionBy("row").orderBy("s", "k").rowsBetween(*before))
    # the base spans from here on, as those before in falling order: a frame that ends with the row takes one step a row
    starts = F.min(F.when(base, F.col("s"))).over(Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(*before))
    found = found.withColumns({"ends": ends, "starts": starts})
    free = F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]") & F.coalesce(F.col("ends") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("starts") >= F.col("e"), F.lit(True))
    return found.where(base | free).drop("ends", "starts")


def ownership(values: DataFrame) -> DataFrame:
    """values (h, copy, repo, owner): (h, n_repos, n_owners), the distinct repositories and owners of each value.

    Rows of one copy count once. Each step reduces rows before it shuffles them, so a value may be in any share of all rows.
    """
    once = values.groupBy("h", "copy").agg(F.min(F.struct("owner", "repo")).alias("first"))
    repos = once.groupBy("h", F.col("first.owner").alias("owner"), F.col("first.repo").alias("repo")).agg(F.count("*").alias("n"))
    owners = repos.groupBy("h", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("h").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


@tidy
def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = 5
) -> DataFrame:
    """One row per row of docs: doc_id, base (array of s, k, e, v), spans (with live, n_owners and n_repos of the value too), n_live, n_example."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit("\x01")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("copy"),
        F.coalesce(F.col(repo_col).cast("string"), none).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), none).alias("owner"), text.alias("t"),
    )
    found = F.concat(*[matches(F.col("t"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, BARE))])
    rows = stored(rows.select("row", "doc_id", "copy", "repo", "owner", found.alias("found")))
    each = spans(rows.select("row", "copy", "repo", "owner", F.inline("found")))
    each = stored(each.withColumn("h", F.unhex(F.md5(F.col("v").cast("binary")))))
    freq = stored(ownership(each))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    marked = lookup(each.select("row", "s", "k", "e", "v", "h"), freq, "h", "row").withColumn("live", live).where((F.col("k") < 3) | F.col("live"))
    marked = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "v", "live", "n_owners", "n_repos"))).alias("spans"))
    out = rows.select("row", "doc_id").join(marked, "row", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,k:int,e:int,v:string,live:boolean,n_owners:bigint,n_repos:bigint>>)")))
    base = F.transform(F.filter("spans", lambda x: x["k"] < 3), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    count = lambda live: F.size(F.filter("spans", lambda x: x["live"] == F.lit(live))).cast("long")
    return out.select("doc_id", base.alias("base"), "spans", count(True).alias("n_live"), count(False).alias("n_example"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == F.lit(k))).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def _oracle() -> str:
    """The same scan in SQL: positions from what lies between the matches, ownership by distinct counts."""
    patterns = [ASSIGN, ACCESS.replace("}+", "}"), HEX.replace("}+", "}"), BARE.replace("}+", "}")]
    quoted = [p.replace("'", "''") for p in patterns]
    parts = " union all ".join(
        f"select r, {k} k, regexp_extract_all(t, '{p}') hits, regexp_split_to_array(t, '{p}') gaps, "
        f"regexp_extract_all(t, '{p}', {1 if k == 0 else 0}) vals from d where regexp_matches(t, '{p}')"
        for k, p in enumerate(quoted)
    )
    names = "['assign', 'access', 'hex', 'owned'][k + 1]"
    return f"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
m as ({parts}),
u as (select r, k, hits, gaps, vals, unnest(range(1, len(hits) + 1)) i from m),
p as (select r, k, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i-1], lambda x: length(x))), 0) s,
        length(hits[i]) n, vals[i] v from u),
q as (select r, k, s::bigint s, (s + n)::bigint e, v from p where k <> 0 or length(v) >= 12),
f as (select * from q where k < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
        and not exists (select 1 from q b where b.r = q.r and b.k < 3 and b.s < q.e and q.s < b.e))),
c as (select f.v, md5(d.t) copy, min({{'o': coalesce(source, chr(1)), 'r': coalesce(doc_id::varchar, chr(1))}}) m from f join d using (r) group by 1, 2),
o as (select v, count(distinct m.o) owners, count(distinct m) repos from c group by 1),
a as (select f.*, owners <= 1 and repos <= 5 live from f join o using (v)),
g as (select r, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
        string_agg({names} || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) base,
        string_agg({names} || ':' || s || ':' || e, ',' order by s, k) filter (k < 3 or live) spans,
        count(*) filter (live) n_live, count(*) filter (k < 3 and not live) n_example from a group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from d left join g using (r)
"""


ORACLE = _oracle()
