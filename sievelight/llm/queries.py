"""Contract queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import anchors, bktree, cotraining, disclosure, licenses, line_quality, mixing, multi_index, runs, tiling, token_counts, toxicity, url_model
from sievelight.llm.store import materialize
from sievelight.sources.tables import deal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return deal(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.repeated_windows(table(spark, sf_dir, "documents"))


def op6_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(table(spark, sf_dir, "documents"))


def op8_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", bktree.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge_urls(table(spark, sf_dir, "pages"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.detect(runs.plant(table(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.mine(multi_index.noisy(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_toxicity, op3_line_quality, op4_cotraining, op5_anchors, op6_tiling, op7_disclosure, op8_bktree, op9_url_model, op10_mix_sources, op11_runs, op12_token_counts, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_quality": line_quality.ORACLE, "op5_anchors": anchors.ORACLE, "op13_hard_negatives": multi_index.ORACLE}
