"""Batch retrieval: filters, BM25, exact vector search, fusion, ranking and multi-hop merging."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.operators.joins import BROADCAST_ROWS, listed, small
from sievelight.operators.products import block_best, block_bm25
from sievelight.operators.terms import Index

K1, B = 1.2, 0.75


def apply_filters(chunks: DataFrame, available: int | None = None, **equal) -> DataFrame:
    """Rows whose columns are among the given values; None or an empty list filters nothing; available=1 keeps nulls."""
    for name, value in equal.items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [] if value is None or value == "" else [value]
        if values:
            chunks = chunks.filter(F.col(name).isin(values))
    if available is not None:
        low = F.coalesce(F.col("available_int") < 1, F.lit(False))
        chunks = chunks.filter(~low if available else low)
    return chunks


def multi_index(parts: list[DataFrame]) -> DataFrame:
    """Several collections as one; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Groups of a question whose matches can be told apart, 63 in each of the masks.
MASK_BITS, MASKS = 63, 5


def _matched(terms: DataFrame) -> DataFrame:
    """Terms added up per query, with the number of their groups as bits; each term is its own group where there are none."""
    if "grp" not in terms.columns:
        return terms.select("query_id", "term", "boost", F.lit(1).cast("long").alias("_many"))
    bit = [F.bit_or(F.when(F.floor(F.col("grp") / MASK_BITS) == i, F.expr(f"shiftleft(1L, cast(grp % {MASK_BITS} AS int))")).otherwise(F.lit(0).cast("long"))).alias(f"_m{i}") for i in range(MASKS)]
    return terms.groupBy("query_id", "term").agg(F.sum("boost").alias("boost"), *bit)


def bm25(terms: DataFrame, fields: dict[str, tuple[Index, float]] | Index) -> DataFrame:
    """(query_id, chunk_id, score, n_terms) of ``terms(query_id, term, boost[, grp])``; over several token fields (index, boost) the best field counts.

    ``n_terms`` counts the different terms held, or the groups ``grp`` (below
    MASK_BITS * MASKS) of which a term is held.  Terms are broadcast after a
    count; the postings then stay where they are until the scores are made.
    """
    asked = _matched(terms)
    masks = [c for c in asked.columns if c.startswith("_m") and c != "_many"]
    found = []
    for index, weight in [(fields, 1.0)] if isinstance(fields, Index) else fields.values():
        df = index.stats().select("term", "df")
        corpus = F.broadcast(index.size)  # one row of corpus figures
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rated = small(asked.join(df, "term").join(corpus).select("query_id", "term", "avgdl", (F.col("boost") * idf * (K1 + 1)).alias("part"), *(masks or ["_many"])))
        part = F.col("part") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
        held = [F.bit_or(m).alias(m) for m in masks] or [F.count("*").alias("_many")]
        found.append(index.posts.join(rated, "term").groupBy("query_id", "chunk_id").agg((weight * F.sum(part)).alias("score"), *held))
    if len(found) > 1:
        held = [F.bit_or(m).alias(m) for m in masks] or [F.max("_many").alias("_many")]
        found = [reduce(DataFrame.unionByName, found).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), *held)]
    n = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0])).cast("long") if masks else F.col("_many")
    return found[0].select("query_id", "chunk_id", "score", n.alias("n_terms"))


def binary_idf_score(terms: DataFrame, index: Index, boost: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, score): normalised idf of the terms held, whatever their frequency."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (F.col("n") - 0.5) / 1.5)
    corpus = F.broadcast(index.size)  # one row of corpus figures
    rated = small(terms.join(index.stats(), "term").join(corpus).select("query_id", "term", (boost * idf).alias("part")))
    return index.posts.join(rated, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def min_should_match(hits: DataFrame, terms: DataFrame, ratio: float = 0.3, relaxed: float = 0.1) -> DataFrame:
    """``hits(…, n_terms)`` that hold floor(ratio n) of their query's n terms (groups where ``terms`` has ``grp``).

    Queries left without hits get the relaxed ratio; queries that ``terms`` lacks
    keep all hits.
    """
    asked = terms.groupBy("query_id").agg(F.countDistinct("grp" if "grp" in terms.columns else "term").alias("asked"))
    sized = hits.join(small(asked), "query_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    strict = sized.filter(F.col("n_terms") >= F.floor(ratio * F.col("asked")))
    loose = sized.join(small(strict.select("query_id").distinct()), "query_id", "left_anti").filter(F.col("n_terms") >= F.floor(relaxed * F.col("asked")))
    return strict.unionByName(loose).drop("asked")


def top_matching(hits: DataFrame, terms: DataFrame, n: int, ratio: float = 0.3, relaxed: float = 0.1) -> DataFrame:
    """The ``n`` best of ``min_should_match`` per query, in one pass over the hits: both shares keep their best, queries with strict hits drop the others."""
    asked = terms.groupBy("query_id").agg(F.countDistinct("grp" if "grp" in terms.columns else "term").alias("asked"))
    sized = hits.join(small(asked), "query_id", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    sized = sized.filter(F.col("n_terms") >= F.floor(relaxed * F.col("asked"))).withColumn("strict", F.col("n_terms") >= F.floor(ratio * F.col("asked")))
    best = top_per_query(sized, n, ("query_id", "strict"))
    return best.withColumn("any", F.max("strict").over(Window.partitionBy("query_id"))).filter("strict = any").drop("any", "strict", "asked")


#: Chunks of one block of postings.
BLOCK_CHUNKS = 1 << 14


def best_bm25(terms: DataFrame, fields: dict[str, tuple[Index, float]], n: int, ratio: float = 0.3, relaxed: float = 0.1, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, chunk_id, score, rank): ``top_matching`` of ``bm25`` for ``terms(query_id, latin, grp, term, boost)``; Latin queries need no share of groups.

    The terms are sent (after a count) to blocks of postings, which are added up
    inside tasks; these send on the best of every block, so no pair of query and
    chunk is a row before.  More than ``rows`` terms meet the postings in a join.
    """
    spark = terms.sparkSession
    asked = listed(terms.select("query_id", "latin", "grp", "term", "boost"), rows)
    if asked is None:
        return top_matching(bm25(terms, fields), terms.filter("not latin"), n, ratio, relaxed)
    ids, codes = asked.column("query_id").combine_chunks(), {}
    number = np.array([codes.setdefault(str(x), len(codes)) for x in ids.to_pylist()], np.int64)
    firsts = np.unique(number, return_index=True)[1]
    words = asked.column("term").combine_chunks().dictionary_encode()
    term, boost = words.indices.to_numpy().astype(np.int64), asked.column("boost").to_numpy()
    other = ~asked.column("latin").to_numpy().astype(bool)
    boosts = (term, number, boost)
    groups = tuple(np.unique(np.stack([term[other], number[other], asked.column("grp").to_numpy().astype(np.int64)[other]]), axis=1))
    sizes = np.bincount(np.unique(np.stack(groups[1:]), axis=1)[0], minlength=len(codes)) if other.any() else np.zeros(len(codes), np.int64)
    strict, loose = np.floor(ratio * sizes), np.floor(relaxed * sizes)
    numbered = F.broadcast(spark.createDataFrame(pa.table([words.dictionary, np.arange(len(words.dictionary))], ["term", "t"]), "term string, t long"))
    queries = F.broadcast(spark.createDataFrame(pa.table([ids.take(pa.array(firsts)), np.arange(len(firsts))], ["query_id", "q"]), f"query_id {terms.schema['query_id'].dataType.simpleString()}, q long"))
    parts = []
    for f, (index, weight) in enumerate(fields.values()):
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rated = small(index.stats().join(numbered, "term").join(F.broadcast(index.size)).select("term", "t", "avgdl", (weight * idf * (K1 + 1)).alias("part")))
        part = F.col("part") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
        parts.append(index.posts.join(rated, "term").select("chunk_id", "t", F.lit(f).alias("f"), part.alias("part")))
    chunks = next(iter(fields.values()))[0].size.first()["n"]
    width = max(spark.sparkContext.defaultParallelism, -(-chunks // BLOCK_CHUNKS))
    dealt = reduce(DataFrame.unionByName, parts).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(width)).cast("int"))

    def best(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        column = lambda name: block.column(name).to_numpy()
        q, chunk, score, kind = block_bm25(block.column("chunk_id").combine_chunks(), column("t"), column("f"), column("part"), boosts, groups, strict, loose, n)
        return pa.table([pa.array(q), chunk, pa.array(score), pa.array(kind)], ["q", "chunk_id", "score", "strict"])

    found = dealt.repartition(width, "block").groupBy("block").applyInArrow(best, f"q long, chunk_id {dealt.schema['chunk_id'].dataType.simpleString()}, score double, strict boolean")
    top = top_per_query(found, n, ("q", "strict"))
    top = top.withColumn("any", F.max("strict").over(Window.partitionBy("q"))).filter("strict = any")
    return top.join(queries, "q").select("query_id", "chunk_id", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Vectors of one block, and queries that are sent to all of these at once; a task holds one block of each.
BLOCK_VECTORS, BROADCAST_QUERIES = 1 << 16, 1 << 12


def knn(queries: DataFrame, vectors: DataFrame, k: int = 1024, min_similarity: float = 0.1, block: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine of ``queries(query_id, qvec)`` and ``vectors(chunk_id, embedding)``.

    A stated query set meets all rows: blocks of at most about ``block`` vectors
    and BROADCAST_QUERIES queries are multiplied as matrices.  Every block keeps its
    best ``k`` per query, and the best of these are the answer, so that no query's
    hits gather in one task.  Of equal vectors in a block only the first ``k`` ids
    can be among the best.
    """
    width = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // block))
    deep = -(-queries.count() // BROADCAST_QUERIES) or 1
    everywhere = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    double = lambda c: F.col(c).cast("array<double>").alias(c)
    v = vectors.select("chunk_id", double("embedding"), F.pmod(F.xxhash64("chunk_id"), F.lit(width)).cast("int").alias("vb"), everywhere(deep, "qb"))
    q = queries.select("query_id", double("qvec"), F.pmod(F.xxhash64("query_id"), F.lit(deep)).cast("int").alias("qb"), everywhere(width, "vb"))
    ids = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": vectors.schema["chunk_id"].dataType.simpleString()}

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        query, chunk, score = block_best(q.column("qvec"), v.column("embedding"), v.column("chunk_id"), k, min_similarity)
        return pa.table([q.column("query_id").take(pa.array(query)), v.column("chunk_id").take(pa.array(chunk)), pa.array(score)], ["query_id", "chunk_id", "score"])

    scored = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(best, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, score double")
    return top_per_query(scored, k)


def top_per_query(hits: DataFrame, n: int = 100, keys: tuple = ("query_id",)) -> DataFrame:
    """The ``n`` best hits per key with their rank; scores equal to nine digits tie, ties go by chunk_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def branch_weights(queries: DataFrame, vector_weight: float = 0.6) -> DataFrame:
    """(query_id, branch, family, weight): vector, original and expanded keywords; the expansion takes half of the keywords' weight where it differs."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    same = F.col("expanded").isNull() | (squeezed("text") == squeezed("expanded"))
    rows = F.array(
        F.struct(F.lit("vector_original").alias("branch"), F.lit("vector").alias("family"), F.lit(vector_weight).alias("weight")),
        F.struct(F.lit("keyword_original").alias("branch"), F.lit("keyword").alias("family"), F.when(same, 1 - vector_weight).otherwise((1 - vector_weight) / 2).alias("weight")),
        F.struct(F.lit("keyword_expanded").alias("branch"), F.lit("keyword").alias("family"), F.when(same, 0.0).otherwise((1 - vector_weight) / 2).alias("weight")),
    )
    return queries.select("query_id", F.explode(rows).alias("w")).select("query_id", "w.*").filter("weight > 0")


def redistribute_weights(weights: DataFrame, hits: DataFrame) -> DataFrame:
    """Weights of the branches that have hits: empty branches leave theirs to their family, empty families to the other.

    A family's weight is shared equally by its branches with hits; a query
    without any hit keeps the weights it asked for.
    """
    seen = hits.select("query_id", "branch").distinct().withColumn("hit", F.lit(1))
    joined = weights.join(seen, ["query_id", "branch"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    query, family = Window.partitionBy("query_id"), Window.partitionBy("query_id", "family")
    joined = joined.withColumn("any_hit", F.max("hit").over(query)).withColumn("family_hits", F.sum("hit").over(family)).withColumn("family_weight", F.sum("weight").over(family)).withColumn("asked", F.sum("weight").over(query))
    joined = joined.withColumn("live", F.sum(F.when(F.col("family_hits") > 0, F.col("weight")).otherwise(0.0)).over(query))
    # Weight of families without hits goes to the family that has some.
    share = F.when(F.col("live") > 0, F.col("family_weight") * F.col("asked") / F.col("live")).otherwise(0.0)
    final = F.when(F.col("any_hit") == 0, F.col("weight")).when(F.col("hit") == 1, share / F.col("family_hits")).otherwise(0.0)
    return joined.select("query_id", "branch", final.alias("weight"))


def rrf(rankings: DataFrame, weights: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, best_rank, contributions, rank) of ``rankings(query_id, branch, chunk_id, rank)``.

    The sum of weight / (k + rank); of repeated ids in a branch the first rank
    counts, later ids keep theirs; weights of 0 or less are skipped.
    """
    first = rankings.groupBy("query_id", "branch", "chunk_id").agg(F.min("rank").alias("rank"))
    joined = first.join(weights.filter("weight > 0"), ["query_id", "branch"]).withColumn("part", F.col("weight") / (k + F.col("rank")))
    fused = joined.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("rank").alias("best_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "part")))).alias("contributions"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order))


def merge_branch_fields(hits: DataFrame, fields: list[str], branch_order: list[str]) -> DataFrame:
    """Per query and chunk the first non-null value of every field by branch order, and the score per branch."""
    place = F.array_position(F.array(*[F.lit(b) for b in branch_order]), F.col("branch"))
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return hits.groupBy("query_id", "chunk_id").agg(*first, F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "score")))).alias("branch_scores"))


def limit_identities(ranked: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows of a page of ``limit`` identities: up to the row where the last one first appears (all rows where there are fewer), without those of earlier pages."""
    per = Window.partitionBy("query_id", "identity")
    seen = ranked.withColumn("first_rank", F.min("rank").over(per))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_rank"))
    seen = seen.withColumn("number", number)
    cut = F.max(F.when(F.col("number") == offset + limit, F.col("first_rank"))).over(Window.partitionBy("query_id"))
    return seen.withColumn("cut", cut).filter((F.col("cut").isNull() | (F.col("rank") <= F.col("cut"))) & (F.col("number") > offset)).drop("cut", "first_rank", "number")


def rerank_join(candidates: DataFrame, scores: DataFrame, mode: str = "probability") -> DataFrame:
    """Candidates with a scorer's ``raw`` score as probability and logit; missing and non-finite scores are flagged."""
    raw = F.col("raw").cast("double")
    ok = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    if mode == "logit":
        probability, logit = 1 / (1 + F.exp(-raw)), raw
    else:
        safe = F.least(F.greatest(raw, F.lit(1e-12)), F.lit(1 - 1e-12))
        probability, logit = raw, F.log(safe / (1 - safe))
    joined = candidates.join(scores.select("query_id", "chunk_id", "raw"), ["query_id", "chunk_id"], "left")
    return joined.withColumn("valid", ok).withColumn("semantic", F.when(ok, probability)).withColumn("logit", F.when(ok, logit)).drop("raw")


def rerank_text(chunks: DataFrame) -> DataFrame:
    """``rerank_text``: table text before plain text, behind the document's name and the caption."""
    body = F.coalesce(F.when(F.trim("table_text") != "", F.col("table_text")), F.col("content"))
    return chunks.withColumn("rerank_text", F.concat_ws("\n", F.when(F.col("document_name") != "", F.col("document_name")), F.when(F.col("caption") != "", F.col("caption")), body))


def final_rank(candidates: DataFrame, weight: float = 0.7, k: int = 10, page_size: int = 5, offset: int = 0) -> DataFrame:
    """Second fusion of the semantic and the recall order; conflicts first, then fused, semantic, recall score and id; one page.

    ``candidates(query_id, chunk_id, rank, score, semantic, conflicts[,
    identity])``, with ``rank`` in the order of the first fusion.  Pages count
    identities where given, so the rows of one table take one place.
    """
    w = Window.partitionBy("query_id")
    recall = F.desc(F.round("score", 12))
    ranked = candidates.withColumn("semantic_rank", F.row_number().over(w.orderBy(F.desc_nulls_last("semantic"), recall, "chunk_id"))).withColumn("recall_rank", F.row_number().over(w.orderBy("rank")))
    ranked = ranked.withColumn("fused", F.lit(weight) / (k + F.col("semantic_rank")) + F.lit(1 - weight) / (k + F.col("recall_rank")))
    order = w.orderBy("conflicts", F.desc(F.round("fused", 12)), F.desc_nulls_last("semantic"), recall, "chunk_id")
    ranked = ranked.withColumn("final_rank", F.row_number().over(order))
    if "identity" in ranked.columns:
        return limit_identities(ranked.withColumn("rank", F.col("final_rank")), page_size, offset)
    return ranked.filter((F.col("final_rank") > offset) & (F.col("final_rank") <= offset + page_size))


def doc_aggs(result: DataFrame) -> DataFrame:
    """(query_id, doc_id, n, rank): hits per document, most first, ties by name."""
    counted = result.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id")))


def shape_results(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, record): output rows as JSON."""
    fields = [c for c in ranked.columns if c not in ("query_id", "rank")]
    return ranked.select("query_id", "rank", F.to_json(F.struct(*fields)).alias("record"))


def dedupe_requests(requests: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct requests by ``request_key``, mapping of all requests to it): equal requests run once and share the result."""
    keyed = requests.withColumn("request_key", F.sha2(F.to_json(F.struct(*identity)), 256))
    return keyed.select("request_key", *identity).dropDuplicates(["request_key"]), keyed


def validate_bindings(bindings: DataFrame, chunks: DataFrame, longest: int = 80) -> DataFrame:
    """``bindings(binding_id, chunk_id, value, quote)`` with ``valid``: a short value inside its quote, both inside the chunk."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    joined = bindings.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    value, quote, content = flat(F.col("value")), flat(F.col("quote")), flat(F.col("content"))
    ok = (F.length(F.trim("value")).between(1, longest)) & F.contains(content, value) & F.contains(content, quote) & F.contains(quote, value)
    return joined.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("content")


def fill_templates(tasks: DataFrame, bindings: DataFrame) -> DataFrame:
    """``tasks(task_id, template)`` with {slot}s filled from ``bindings(task_id, slot, value, doc_id)``.

    A task is blocked when a slot stays unfilled or a binding is unused; the
    document scope is inherited only if all bindings share one document.
    """
    slots = bindings.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct("slot", "value"))).alias("slots"), F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("one_doc"))
    joined = tasks.join(slots, "task_id", "left")
    filled = F.aggregate(F.coalesce("slots", F.array().cast("array<struct<slot:string,value:string>>")), F.col("template"), lambda t, s: F.replace(t, F.concat(F.lit("{"), s["slot"], F.lit("}")), s["value"]))
    unused = F.coalesce(F.exists("slots", lambda s: ~F.contains(F.col("template"), F.concat(F.lit("{"), s["slot"], F.lit("}")))), F.lit(False))
    out = joined.withColumn("query", filled).withColumn("blocked", F.col("query").rlike(r"\{[^}]*\}") | unused)
    return out.select("task_id", F.when(~F.col("blocked"), F.col("query")).alias("query"), "blocked", F.when(F.col("n_docs") == 1, F.col("one_doc")).alias("doc_scope"))


def merge_hops(hops: DataFrame, page_size: int = 5) -> DataFrame:
    """Chunks of several hops as one ranking: ``hops(question_id, hop, hop_rank, chunk_id, score, conflicts, is_bridge)``.

    Each hop reserves its representative (a bridge chunk first) on the first
    page; otherwise conflicts, score and id decide.
    """
    rep = Window.partitionBy("question_id", "hop").orderBy(F.desc("is_bridge"), "hop_rank", "chunk_id")
    marked = hops.withColumn("reserved", F.row_number().over(rep) == 1)
    merged = marked.groupBy("question_id", "chunk_id").agg(
        F.array_sort(F.collect_set(F.struct("hop", "hop_rank"))).alias("traces"), F.max("score").alias("score"), F.min("conflicts").alias("conflicts"), F.max("reserved").alias("reserved")
    )
    w = Window.partitionBy("question_id")
    key = ("conflicts", F.desc_nulls_last("score"), "chunk_id")
    ranked = merged.withColumn("claim", F.row_number().over(w.orderBy(F.desc("reserved"), *key))).withColumn("reserved", F.col("reserved") & (F.col("claim") <= page_size))
    # The first page: the reserved chunks and the best of the rest, shown by the common order; then all others.
    ranked = ranked.withColumn("group", F.when(F.col("claim") <= page_size, 0).otherwise(1))
    return ranked.withColumn("rank", F.row_number().over(w.orderBy("group", *key))).drop("claim", "group")


def hop_fallback_rank(hops: DataFrame) -> DataFrame:
    """Equal-weight fusion of the hops' own ranks, where there is no common score."""
    rankings = hops.select(F.col("question_id").alias("query_id"), F.col("hop").cast("string").alias("branch"), "chunk_id", F.col("hop_rank").alias("rank"))
    weights = rankings.select("query_id", "branch").distinct().withColumn("weight", F.lit(1.0))
    return rrf(rankings, weights)
