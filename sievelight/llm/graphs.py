"""Connected components on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.store import drop, fresh, materialize, text_key


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates large-star and small-star steps: every node hands its smallest
    neighbour to the larger ones, then to the smaller ones, until each component
    is a star around its smallest node.  Steps are a grouped minimum and an equi
    join, so a hub's neighbours are never gathered in one place; each round is
    written out, so lost executors cost no more than a round.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    size = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, edges = edges, materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        drop(before)
        # A forest of stars has as many edges as larger nodes, none of which is a root: then nothing changes any more.
        row = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("c"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        state = (row["n"], row["c"], row["h"])
        if state == size or not row["n"]:
            break
        size = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


#: Kept rows (two numbers each) up to which they are broadcast to the texts; more meet them by a shuffle.
BROADCAST_KEPT = 500_000


def keep_one(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of ``docs`` per component of its texts' keys ``roots(node, root)``; a key without a root is its own.

    Kept is the row with the smallest doc_id, null ones last, then the smallest
    key; of rows that agree in both, an arbitrary one.  Rows are told apart by
    doc_id and text together, so a null or repeated doc_id loses no other text.
    """
    key, root, none, one, copy = fresh(docs, "text_key", "root", "no_id", "kept_id", "copy")
    keyed = docs.withColumn(key, text_key())
    named = keyed.select("doc_id", key).join(roots.select(F.col("node").alias(key), F.col("root").alias(root)), key, "left")
    named = named.withColumn(root, F.coalesce(root, key)).withColumn(none, F.col("doc_id").isNull())
    first = named.groupBy(root).agg(F.min(F.struct(none, "doc_id", key)).alias(one))
    first = first.select(F.col(f"{one}.doc_id").alias(one), F.col(f"{one}.{key}").alias(copy))
    first = materialize(first)
    if first.limit(BROADCAST_KEPT + 1).count() <= BROADCAST_KEPT:
        first = F.broadcast(first)
    chosen = (F.col(key) == F.col(copy)) & F.col("doc_id").eqNullSafe(F.col(one))
    kept = keyed.join(first, chosen, "left_semi")
    # Texts are shuffled once more only where a row is there twice.
    once = keyed.select("doc_id", key).join(first, chosen, "left_semi").groupBy("doc_id", key).count().filter("count > 1").isEmpty()
    return (kept if once else kept.dropDuplicates(["doc_id", key])).drop(key)
