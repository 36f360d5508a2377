"""The pipeline's stages on a small table with planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronolith.llm import ngram_join
from chronolith.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == cp.COLUMNS
        kept[name] = docs.select("doc_id").distinct().count()
    assert kept["toxicity"] >= 0.8 * n and kept["line dedup"] == kept["toxicity"] and kept["n-gram Jaccard join"] <= kept["line dedup"]
    out = cp.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("n_tokens <> size(ids)").count() == 0


def test_near_duplicates_stage(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "s", 1), (2, text + " x", "en", "s", 1), (3, "another text altogether here now", "en", "s", 1), (4, None, None, None, None), (None, text, "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("component_id", F.lit(0))
    got = cp.drop_near_duplicates(spark, d, SF)
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "3", "4", "None"]


def test_near_duplicates_stage_of_a_large_table(spark, monkeypatch):
    """Sets of documents that are like no other aren't stored, however many n-grams the table has."""
    monkeypatch.setattr(ngram_join, "sketch_bits", lambda *a, **b: 10, raising=False)  # as small for these as 2**27 cells are for 6 GB
    sizes, plain = [], ngram_join.stored

    def spied(df):
        out = plain(df)
        if "set" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", spied)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(60)), "en", "s", 1) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " x", "en", "s", 1) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, d, SF).collect()) == list(range(200))
    assert len(sizes) == 1 and 10 <= sizes[0] <= 30, sizes


def test_near_duplicates_stage_of_copies(spark, monkeypatch):
    """Texts that only have exact copies aren't indexed, others by one copy each, and in fewer bytes than their text."""
    found, plain = [], ngram_join.stored

    def spied(df):
        out = plain(df)
        if "set" in df.columns:
            found.append(out.agg(F.count("*"), F.sum(F.octet_length("set"))).first())
        return out

    monkeypatch.setattr(ngram_join, "stored", spied)
    texts = [" ".join(f"d{i}w{k}" for k in range(60)) for i in range(100)]
    texts += [f"{texts[i]} x" for i in range(10)]
    d = spark.createDataFrame([(100 * c + i + 10_000 * (i >= 100), t, "en", "s", 1) for c in range(4) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, d.repartition(5), SF).collect()) == list(range(100))
    (sets, size), own = found[0], sum(len(t) for t in texts[:10] + texts[100:])
    assert len(found) == 1 and 20 <= sets <= 40 and size < own * sets / 20, found


def test_repeated_rows_of_a_document(spark):
    """Of rows with one doc_id and one text one stays; other texts of that doc_id stay too."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, None, "t", 1), (7, text + " x", "en", "s", 1), (9, "one", "en", "s", 1), (9, "two", "en", "s", 1), (9, "two", "en", "s", 1), (4, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = cp.drop_near_duplicates(spark, d, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] != 4) == [(5, text), (9, "one"), (9, "two")] and len(got) == 4


def test_empty_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        d = stored(stage(spark, d, SF))
        assert d.count() == 0


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage but the first on its own input: SQL or plain Python says the same."""
    import hashlib
    from collections import Counter

    import duckdb
    import public_tokenizers
    import tiktoken
    from reference import near_duplicates

    from chronolith.llm import line_dedup, source_mix
    from chronolith.llm.bpe import load_ranks

    def view(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{tmp_path}/{name}/*.parquet'")
        return con

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = view(docs, "a")
    cleaned = stored(cp.drop_lines(spark, docs, SF))
    want = {r[0]: r[3] for r in con.sql(line_dedup.ORACLE).project("doc_id, n_lines, n_removed, text_sha256").fetchall()}
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())

    single = stored(cp.drop_near_duplicates(spark, cleaned, SF))
    classes = near_duplicates([(i, r["text"]) for i, r in got.items()])
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in classes.items() if c == i}

    mixed = stored(cp.mix_sources(spark, single, SF))
    copies = {r[0]: r[1] for r in view(single, "b").sql(source_mix.ORACLE).project("doc_id, copies").fetchall() if r[1]}
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == copies

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in cp.encode(spark, mixed, SF).collect():
        assert r["ids"] == lib.encode_ordinary(texts[r["doc_id"]] or "")


def test_toxic_stage_drops_what_its_score_says(spark):
    from chronolith.llm import toxicity

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in cp.drop_toxic(spark, docs, sf).collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.op9_toxicity(spark, sf).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
