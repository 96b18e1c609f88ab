"""The corpus pipeline: five stages of documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one.  A stage works on all that its predecessor
kept; all but the last return the columns of ``documents``.

Defined cases, for every stage: a null, empty or blank text is a text like any
other (not toxic, alike, no leak, no span, no words); very long texts are read
whole; repeated rows are judged alike; a null doc_id is kept and stands for no
other row; rows that share a doc_id but not their text are told apart; an empty
table gives an empty one; columns besides those of ``documents`` are left out.

Texts travel to Python a few hundred at a time: Spark counts the rows of a batch,
not its bytes, and thousands of texts in one buffer fill an executor beside its heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import disclosure, mixing, shingles, tiling, toxicity
from sievelight.llm.store import materialize
from sievelight.sources.tables import deal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of one Arrow batch at most; a smaller number set by the session stays.
BATCH_ROWS = 512


def documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that a stage works on, in a session whose Arrow batches are short."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:  # 0 or less: no limit
        spark.conf.set(setting, BATCH_ROWS)
    return docs.select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; without labels of both classes all stay."""
    return toxicity.reject_toxic(documents(spark, docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of 5-word shingles or more): the one with the smallest doc_id, null ones last."""
    return shingles.deduplicate(documents(spark, docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than half of every benchmark item; items of fewer than five words match nothing."""
    return tiling.decontaminate(documents(spark, docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it generalised in the text."""
    return disclosure.sanitize(documents(spark, docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the words taken of each, repeats counted; documents that the mix leaves out, or without words, go."""
    return mixing.mix_sources(mixing.sized(documents(spark, docs))).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("mixing", mix),
]

#: The trained classifier and the fingerprints are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
