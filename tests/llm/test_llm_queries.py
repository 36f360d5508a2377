"""The registered queries against their SQL, or against brute force, on the small tables."""

import hashlib

import pytest
from oracle import duck, same
from reference import near_duplicates

from chronolith.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_ngram_join(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_ngram_join"](spark, SF).collect()}
    assert got == near_duplicates([(i, r["text"]) for i, r in documents.items()])


def test_tokens_are_those_of_the_public_library(spark, documents):
    import public_tokenizers
    import tiktoken

    from chronolith.llm.bpe import load_ranks

    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op4_bpe"](spark, SF).collect():
        text = documents[r["doc_id"]]["text"] or ""
        ids = t.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_vectors(spark):
    import numpy as np
    from reference import components

    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect())
    ids, e = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)]
    c = components(ids, links)
    n = {i: sum(i in x for x in links) for i in ids}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op2_vector_dedup"](spark, SF).collect()}
    assert got == {i: (n[i], c[i], c[i] == i) for i in ids}


def test_language_held_out(spark, documents):
    got = [r for r in QUERIES["op8_language_id"](spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in got) >= 0.95 * len(got)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op9_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, t in got if t == 1], [p for p, t in got if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)
