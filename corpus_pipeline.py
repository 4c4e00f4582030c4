"""Cleaning and packing of a corpus, stage by stage; each stage is one of the operators in sourcetally.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcetally.llm import catalog, chunking, language, minhash, toxicity
from sourcetally.llm.arrow import small_batches
from sourcetally.llm.rows import few
from sourcetally.session import stored

#: Documents whose best language has less than this share of the text go.
LEAST_LANGUAGE = 0.35
#: Values in a band: at a similarity of 0.8, six miss as few pairs with 54 bands as eight with 88.
NEAR_ROWS = 6


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters and one language that leads clearly; all learnt languages stay."""
    small_batches(spark)
    labels, net = language.learn(docs.where(~language.held_out("doc_id")))
    found = language.predict(docs, labels, net)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold."""
    small_batches(spark)
    return toxicity.score(docs, catalog.toxicity_model(spark, sf_dir)).where(F.col("predicted") == 0).select(*docs.columns)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 alike, directly or through others, keep that
    with the smallest id."""
    small_batches(spark)
    copies = minhash.near_duplicates(docs, rows=NEAR_ROWS).where("not kept").select("doc_id")
    return docs.join(few(copies, "pipeline-copies"), "doc_id", "left_anti").select(*docs.columns)


def by_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out of texts that a document with a smaller id has; every document stays."""
    small_batches(spark)
    done = chunking.without_repeats(docs)
    changed = F.col("n_spans") > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a sequence of at most 2048 tokens."""
    small_batches(spark)
    return catalog.packed(docs)


STAGES = [("language", by_language), ("toxicity", by_toxicity), ("near copies", by_near_copies), ("passages", by_passages), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
