"""Reading corpora and sample sets; writing, replacing, deleting and listing chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READABLE = ("txt", "md", "markdown", "html", "htm", "json", "jsonl", "csv")
SAMPLE = "id string, question string, answerable boolean, question_type string, reference_answer string, metadata struct<split:string,difficulty:string>, _corrupt_record string"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents(path, format, text), rejects(path, reason)) of all files under a path, by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"))
    known = F.col("format").isin(*READABLE)
    return named.filter(known).select("path", "format", F.decode("content", "UTF-8").alias("text")), named.filter(~known).select("path", F.concat(F.lit("unsupported extension: "), "format").alias("reason"))


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, problems(id, problem)) of a JSONL file: broken lines, missing fields and repeated ids are problems."""
    rows = spark.read.schema(SAMPLE).option("mode", "PERMISSIVE").json(path)
    copies = F.count("*").over(Window.partitionBy("id"))
    checked = rows.withColumn("problem", F.when(F.col("_corrupt_record").isNotNull(), "broken line").when(F.col("id").isNull() | F.col("question").isNull() | F.col("answerable").isNull(), "missing field").when(copies > 1, "repeated id"))
    return checked.filter("problem is null").drop("_corrupt_record", "problem"), checked.filter("problem is not null").select("id", "problem")


def select_samples(samples: DataFrame, splits: list[str] | None = None, ids: list | None = None, limit: int | None = None) -> DataFrame:
    """Samples of the splits and ids, the first ``limit`` by id; a split or id that does not exist is an error."""
    for column, wanted in (("split", splits), ("id", ids)):
        if wanted:
            found = {r[0] for r in samples.filter(F.col(column).isin(wanted)).select(column).distinct().collect()}  # as many as were asked for
            if missing := sorted(set(wanted) - found, key=str):
                raise ValueError(f"no such {column}: {missing}")
            samples = samples.filter(F.col(column).isin(wanted))
    return samples.orderBy("id").limit(limit) if limit is not None else samples


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    chunks.write.mode(mode).partitionBy("kb_id").parquet(path)


def replace_document(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks after the replacement, counts(doc_id, indexed, removed)): incoming documents' old chunks go."""
    docs = incoming.select("doc_id").distinct()
    kept = existing.join(docs, "doc_id", "left_anti")
    old = existing.join(docs, "doc_id", "left_semi").join(incoming.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("removed"))
    counts = incoming.groupBy("doc_id").agg(F.count("*").alias("indexed")).join(old, "doc_id", "left").na.fill(0, ["removed"])
    return kept.unionByName(incoming, allowMissingColumns=True), counts


def delete_where(df: DataFrame, **conditions) -> tuple[DataFrame, Column]:
    """(rows that stay, the condition): lists are IN, ``*x*`` is LIKE, other values equality; nulls never match."""
    hit = F.lit(True)
    for name, value in conditions.items():
        if isinstance(value, (list, tuple)):
            hit = hit & F.col(name).isin(list(value))
        elif isinstance(value, str) and "*" in value:
            hit = hit & F.col(name).like(value.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
        else:
            hit = hit & (F.col(name) == value)
    hit = F.coalesce(hit, F.lit(False))
    return df.filter(~hit), hit


def list_chunks(chunks: DataFrame, offset: int = 0, limit: int = 50, array_keys: tuple = ("page", "top"), created: str = "created", key: str = "chunk_id") -> DataFrame:
    """A page of the listing: arrays sort by their mean (nulls last), then newest first."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: F.when(F.size(c) > 0, a / F.size(c)))
    order = [mean(F.col(c)).asc_nulls_last() for c in array_keys] + [F.desc_nulls_last(created), key]
    return chunks.orderBy(*order).offset(offset).limit(limit)


def sql_retrieval(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def write_eval_run(cases: DataFrame, summary: DataFrame, path: str) -> None:
    """Cases and summary as JSON lines; an existing run is never overwritten."""
    cases.write.mode("errorifexists").json(f"{path}/cases")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def put_tables(tables: DataFrame) -> DataFrame:
    """One row per content-addressed table_id."""
    return tables.dropDuplicates(["table_id"])


def get_tables(stored: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(stored, "table_id", "left")


def reindex_plan(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, n_files, n_chunks, problem) per requested document: absent or ambiguous names are flagged."""
    counts = chunks.groupBy("name").agg(F.count("*").alias("n_chunks"))
    asked = files.groupBy("name").agg(F.count("*").alias("n_files"))
    return asked.join(counts, "name", "left").na.fill(0, ["n_chunks"]).withColumn("problem", F.when(F.col("n_files") > 1, "duplicate").when(F.col("n_chunks") == 0, "absent"))


def duplicate_uploads(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, reason): names repeated in the batch, or stored already."""
    repeated = batch.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit("repeated").alias("reason"))
    stored = batch.select("name").distinct().join(existing.select("name"), "name", "left_semi").select("name", F.lit("stored").alias("reason"))
    return repeated.unionByName(stored)


def upload_outcome(files: DataFrame) -> DataFrame:
    """(request_id, n_ok, n_failed, outcome): success, partial_success or failed per request."""
    counted = files.groupBy("request_id").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    return counted.withColumn("outcome", F.when(F.col("n_failed") == 0, "success").when(F.col("n_ok") > 0, "partial_success").otherwise("failed"))
