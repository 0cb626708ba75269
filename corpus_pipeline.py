"""From documents to packed training sequences: quality rules, quality classifier, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return
the columns of documents, whatever other columns there are and whatever their names.

Null ids and repeated rows are rows like others, in every stage. Null and empty texts fail the base rules and go in the
first stage; alone, the classifier drops null texts and judges empty ones, near duplicates keep both, and packing gives
them the end token alone. Of texts that tie as near duplicates the lowest id stays (null ids last; of rows that repeat
both id and text, one). Texts of any length are processed whole. An empty table gives an empty table in every stage;
without labels the classifier keeps all texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import op2_packing, op7_quality_classifier, op8_quality_rules, op9_jaccard_join
from sievework.llm.queries import vocabulary
from sievework.plans.scratch import discard, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines (n_chars follows the text)."""
    kept = op8_quality_rules.passing(docs, text="text")
    return kept.select(*[F.length("text").cast(kept.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else c for c in kept.columns])


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is more likely than not; fitted on the labelled ones among all documents."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = op7_quality_classifier.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op7_quality_classifier.selected(docs, op7_quality_classifier.train(every, ratings))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the lowest id; documents without words all stay."""
    return op9_jaccard_join.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens."""
    return op2_packing.packed(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end=2)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: A classifier's fit, connected components of similar texts and packing are beyond SQL; the tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard(before)
    return docs
