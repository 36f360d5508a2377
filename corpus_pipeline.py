"""Cleaning pipeline over documents: toxicity, line dedup, near-duplicate join, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and all but the last return the
columns of documents. Between stages rows are written to the shared folder and read again.

Null texts pass every filter, have no words to mix and no tokens. Rows without doc_id pass the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, line_dedup, ngram_join, source_mix, toxicity
from chronolith.llm.common import n_words, stored, table
from chronolith.llm.language_id import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learned as op9 does, from the same rows of labels."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    net = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.toxicity(docs, net, COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur on many sites (sources), but for each line's first occurrence."""
    return line_dedup.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates; of rows with one doc_id and one text, one row."""
    groups = stored(ngram_join.ngram_join(docs.select("doc_id", "text"))[0])
    gone = stored(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)
    repeated = stored(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("of"))
    again = again.agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return kept.join(repeated.hint("merge"), "doc_id", "left_anti").select(*COLUMNS).union(again.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2 in the order of sources, 150 % of all words, twice each at most."""
    sized = docs.select(*COLUMNS, n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("weight", F.col("size").cast("double"))
    plan = source_mix.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [3, 1, 2], 1.5, 2.0)
    taken = source_mix.pareto_mix(sized, plan).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    vocabulary = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_docs(docs, vocabulary, public_tokenizers.PATTERN, ["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained network's decisions and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
