"""Benchmark decontamination by greedy string tiling.

Rolling Karp-Rabin hashes of ``K``-word seeds join documents to benchmark items.
Per document and item, the seeds' diagonals give the maximal common matches; the
longest unmarked match is marked again and again, so tiles never overlap and a
reordered passage is covered by several tiles.  A document is contaminated when
its tiles cover ``coverage`` of an item's words.

Seeds are 64-bit hashes of word runs and are not compared as words again: a
corpus of 5e13 words meets a benchmark of 1e5 seeds by chance about 0.3 times,
and one seed of ``K`` words is far from ``coverage`` of an item.

Defined cases: null and empty texts are clean; items shorter than ``K`` words
are no evidence and match nothing; of equally long matches the one earlier in
the item, then in the document, is marked first; repeated rows are judged each
on its own; repeated items count as separate items; very long and very
repetitive texts travel as runs of seeds along a diagonal, not as pairs of
places; empty tables give no contamination; extra columns, whatever their names,
are ignored by ``contamination`` and kept by ``decontaminate``; a null doc_id is
kept, and rows that share a doc_id but not their text are told apart.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.seeds import HEADER, gram_rows
from sievelight.llm.store import fresh, text_key

K = 5
COVERAGE = 0.5
#: Seeds of the benchmark up to which they are broadcast; larger benchmarks join by shuffle.
BROADCAST_SEEDS = 500_000


def tiles(matches: list[tuple[int, int, int]], k: int = K) -> list[tuple[int, int, int]]:
    """(item position, document position, words) of the greedy tiling of maximal matches, given as the same triples."""
    runs = [(-n, i, d) for i, d, n in matches]
    heapq.heapify(runs)
    item_marks: set[int] = set()
    doc_marks: set[int] = set()
    out = []
    while runs:
        n, i, d = heapq.heappop(runs)
        n = -n
        free = [x for x in range(n) if i + x not in item_marks and d + x not in doc_marks]
        if len(free) == n:
            out.append((i, d, n))
            item_marks.update(range(i, i + n))
            doc_marks.update(range(d, d + n))
            continue
        at = 0
        while at < len(free):  # unmarked parts of the match queue up again
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - at + 1 >= k:
                heapq.heappush(runs, (-(end - at + 1), i + free[at], d + free[at]))
            at = end + 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, n_items, max_coverage, item_ids, contaminated) per row of ``docs(doc_id, text)``.

    ``item_ids`` are the items of ``benchmark(item_id, text)`` that the document
    covers enough; ``max_coverage`` is the highest coverage of any item.
    """
    grams = gram_rows(benchmark.select(F.col("item_id").alias("doc_id"), "text"), k)
    lengths = grams.filter(F.col("h") == HEADER).select("row", F.col("pos").alias("item_words"), F.col("doc_id").alias("item_id"))
    seeds = grams.filter(F.col("h") != HEADER).select("row", F.col("pos").alias("item_pos"), "h")
    seeds = seeds.join(lengths, "row").withColumnRenamed("row", "item_row").select("h", "item_row", "item_id", "item_words", "item_pos")
    header = docs.sparkSession.createDataFrame([(HEADER, None, None, None, None)], seeds.schema)
    seeds = seeds.unionByName(header)
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    hits = gram_rows(docs, k).join(seeds, "h")
    # Matching seeds that follow each other on a diagonal are one match; the header rows are runs of their own.
    line = Window.partitionBy("row", "item_row", "diagonal").orderBy("item_pos")
    hits = hits.withColumn("diagonal", F.coalesce(F.col("pos") - F.col("item_pos"), F.lit(0))).withColumn("run", F.coalesce(F.col("item_pos") - F.row_number().over(line), F.lit(0)))
    runs = hits.groupBy("row", "item_row", "diagonal", "run").agg(
        F.max("doc_id").alias("doc_id"), F.max("pos").alias("n"), F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"),
        F.min("item_pos").alias("i"), F.min("pos").alias("d"), (F.count("*") + (k - 1)).cast("int").alias("words"),
    )
    pairs = runs.groupBy("row", "item_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"),
        F.collect_list(F.when(F.col("item_row").isNotNull(), F.struct("i", "d", "words"))).alias("matches"),
    )

    def cover(batches):
        for batch in batches:
            shares = []
            for words, matches in zip(batch.column("item_words").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                shares.append(sum(n for _, _, n in tiles([(m["i"], m["d"], m["words"]) for m in matches], k)) / words if matches else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n", "item_id")), pa.array(shares, pa.float64())], ["row", "doc_id", "n", "item_id", "share"])

    tiled = pairs.mapInArrow(cover, "row long, doc_id long, n int, item_id long, share double")
    found = F.col("share") >= coverage
    return (
        tiled.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(F.col("item_id").isNull() & (F.col("share") == 0), F.col("n"))).cast("long").alias("n_words"),
            F.count_if(found).alias("n_items"),
            F.round(F.max("share"), 6).alias("max_coverage"),
            F.array_sort(F.collect_list(F.when(found, F.col("item_id")))).alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_items") > 0)
        .drop("row")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without contaminated rows; equal texts share their verdict."""
    key, bad = fresh(docs, "text_key", "bad")
    found = contamination(docs.select(text_key().alias("doc_id"), "text"), benchmark, k, coverage).filter("contaminated")
    keyed = docs.withColumn(key, text_key())
    return keyed.join(found.select(F.col("doc_id").alias(bad)).distinct(), F.col(key) == F.col(bad), "left_anti").drop(key)
