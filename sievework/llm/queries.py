"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op1_sharding import sharded

    out = sharded(documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op2_packing import packed

    return packed(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=4096, end=2)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op3_langid import held_out, predicted, train

    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(docs)))
    out = predicted(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op4_bpe import digests

    return digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op5_ppm import held_out, scored

    docs = documents(spark, sf_dir)
    out = scored(docs, docs.where(~held_out(docs)))
    return out.select("doc_id", held_out(out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op6_simhash import with_edits

    return with_edits(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op7_quality_classifier import graded, scored, train

    docs = documents(spark, sf_dir)
    out = scored(docs, train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return out.select("doc_id", "expected_grade", F.col("p_at_least")[0].alias("p_at_least_1"), F.col("p_at_least")[1].alias("p_at_least_2"), "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op8_quality_rules import judged

    return judged(documents(spark, sf_dir)).drop("cleaned")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op9_jaccard_join import components

    return components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.op10_token_counts import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_langid, op4_bpe, op5_ppm, op6_simhash, op7_quality_classifier, op8_quality_rules, op9_jaccard_join, op10_token_counts, pipeline)}


def oracle_sql() -> dict[str, str]:
    from sievework.llm import op8_quality_rules, op9_jaccard_join

    return {"op8_quality_rules": op8_quality_rules.SQL, "op9_jaccard_join": op9_jaccard_join.SQL}
