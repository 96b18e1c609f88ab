"""Hybrid search of a whole query set as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators import search as R
from sievelight.operators import terms as W
from sievelight.operators.constraints import compare_facts, constraint_facts
from sievelight.operators.joins import settled, small
from sievelight.sources.tables import spread

BRANCHES = ["keyword_original", "keyword_expanded", "vector_original"]


@dataclass(frozen=True)
class Options:
    """Filters, sizes and weights of a search; ranges are checked before anything runs."""

    page: int = 1
    page_size: int = 5
    branch_top: int = 100
    rerank_top: int = 20
    vector_weight: float = 0.6
    min_similarity: float = 0.1
    rrf_k: int = 60
    rerank_weight: float = 0.7
    final_k: int = 10
    min_match: float = 0.3
    relaxed_match: float = 0.1
    max_aliases: int = 8
    kb_ids: tuple = ()
    doc_ids: tuple = ()
    available: int | None = None
    #: Token columns of the chunks and their boosts; the best field of a chunk counts.
    fields: dict[str, float] = field(default_factory=lambda: {"tokens": 2.0})

    def __post_init__(self):
        if min(self.page, self.page_size, self.branch_top, self.rerank_top, self.rrf_k, self.final_k) < 1 or not self.fields:
            raise ValueError("sizes must be positive")
        if not (0 <= self.vector_weight <= 1 and 0 <= self.rerank_weight <= 1 and -1 <= self.min_similarity <= 1):
            raise ValueError("weights must be between 0 and 1, the similarity between -1 and 1")
        if not 0 <= self.relaxed_match <= self.min_match <= 1:
            raise ValueError("the relaxed share of matches must not exceed the first one")
        if self.rerank_top > self.branch_top * 3:
            raise ValueError("more candidates to rerank than branches can give")


def expand(queries: DataFrame, aliases: DataFrame | None, maximum: int) -> DataFrame:
    """``queries(query_id, text)`` with ``expanded``: the text and its other names; null where there are none."""
    if aliases is None:
        return queries.withColumn("expanded", F.lit(None).cast("string"))
    found = W.alias_expansions(queries, aliases, maximum).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "alias"))), lambda x: x["alias"]).alias("_names"))
    return queries.join(found, "query_id", "left").withColumn("expanded", F.when(F.col("_names").isNotNull(), F.concat_ws(" ", "text", F.array_join("_names", " ")))).drop("_names")


def keyword_hits(texts: DataFrame, chunks: DataFrame, synonyms: DataFrame, options: Options, cached: list) -> tuple[DataFrame, DataFrame, W.Index]:
    """(hits, weights, main index) of ``texts(query_id, text)``: the best chunks of every text, relaxed for texts without hits."""
    tokens = settled(W.question_tokens(texts), cached)
    # The index holds the terms that some question may need, whatever their weights.
    needed = W.query_terms(tokens.withColumn("weight", F.lit(1.0)), synonyms, None).select("term").unionByName(tokens.select("term"))
    indexes = {name: W.build_index(chunks, needed, name, pairs=True) for name in options.fields}
    cached += indexes.values()
    main = next(iter(indexes.values()))
    weights = settled(W.question_weights(tokens, main.stats()), cached)
    terms = settled(W.query_terms(weights, synonyms), cached)
    fields = {name: (index, options.fields[name]) for name, index in indexes.items()}
    return R.best_bm25(terms, fields, options.branch_top, options.min_match, options.relaxed_match), weights, main


def search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame | None,
    options: Options = Options(),
    semantic: DataFrame | None = None,
    aliases: DataFrame | None = None,
    synonyms: DataFrame | None = None,
) -> DataFrame:
    """One page of every query: ``queries(query_id, text, qvec)``, ``chunks(chunk_id, doc_id, content, tokens[, kb_id, available_int, identity, …])``.

    Filters come first, so neither index nor ``vectors(chunk_id, embedding)``
    hold what they exclude.  The question, the question with its ``aliases``
    (where it has some) and its vector are searched apart; keyword branches
    without hits are relaxed, and a branch without hits leaves its weight to the
    others.  Branches are fused by reciprocal rank to ``rerank_top`` identities,
    scored by ``semantic(query_id, chunk_id, raw)`` or, without a scorer, by token
    similarity; the orders are fused again, candidates that contradict the
    question's constraints last.  Returned are (query_id, chunk_id, final_rank,
    semantic, conflicts, score, branch_scores, doc_id, doc_hits).  What several
    steps read is kept in memory or on disk: the index and what grows with the
    queries; ``unpersist`` the items of the result's ``cached`` after its use.
    """
    cached: list = []
    spark = queries.sparkSession
    live = R.apply_filters(chunks, options.available, kb_id=options.kb_ids, doc_id=options.doc_ids)
    synonyms = spark.createDataFrame([], "term string, synonym string") if synonyms is None else synonyms
    asked = settled(expand(queries.select("query_id", "text"), aliases, options.max_aliases), cached)
    plan = R.branch_weights(asked.select("query_id", "text", "expanded"), options.vector_weight)

    # Both keyword branches share one index and one pass: a text is named by its query and branch.
    name = lambda branch: F.struct("query_id", F.lit(branch).alias("branch")).alias("query_id")
    texts = asked.select(name(BRANCHES[0]), "text").unionByName(asked.join(plan.filter(F.col("branch") == BRANCHES[1]).select("query_id"), "query_id", "left_semi").select(name(BRANCHES[1]), F.col("expanded").alias("text")))
    found, weights, index = keyword_hits(texts, live, synonyms, options, cached)
    lists = found.select("query_id.query_id", "query_id.branch", "chunk_id", "rank", "score")
    if vectors is not None and options.vector_weight > 0:
        seen = vectors.join(live.select("chunk_id"), "chunk_id", "left_semi")
        near = R.knn(queries.filter("qvec is not null").select("query_id", "qvec"), seen, options.branch_top, options.min_similarity)
        lists = lists.unionByName(near.select("query_id", F.lit(BRANCHES[2]).alias("branch"), "chunk_id", "rank", "score"))

    lists = settled(lists, cached)
    fused = R.rrf(lists, R.redistribute_weights(plan, lists), options.rrf_k)
    # Everything below works on the few hundred candidates of each query.
    known = live.select("chunk_id", "doc_id", (F.coalesce(F.col("identity").cast("string"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))) if "identity" in chunks.columns else F.col("chunk_id").cast("string")).alias("identity"))
    kept = settled(R.limit_identities(fused.join(known, "chunk_id"), options.rerank_top), cached)
    per_branch = R.merge_branch_fields(lists.join(kept.select("query_id", "chunk_id", "doc_id", "identity"), ["query_id", "chunk_id"]), ["doc_id", "identity"], BRANCHES)
    candidates = kept.select("query_id", "chunk_id", "score", "rank").join(per_branch, ["query_id", "chunk_id"])
    if semantic is None:
        own = weights.filter(F.col("query_id.branch") == BRANCHES[0]).select("query_id.query_id", "term", "weight")
        scores = W.token_similarity(own, index.posts, small(kept.select("query_id", "chunk_id")))
        semantic = scores.select("query_id", "chunk_id", F.round("similarity", 9).alias("raw"))
    scored = R.rerank_join(candidates, semantic)

    # A question and a chunk state their constraints once, however many pairs they are in.
    shown = R.rerank_text(_with_texts(live)).join(small(kept.select("chunk_id").distinct()), "chunk_id", "left_semi")
    facts = spread(shown.select("chunk_id", "rerank_text")).select("chunk_id", constraint_facts(F.col("rerank_text")).alias("held"))
    wanted = queries.select("query_id", constraint_facts(F.col("text"), asking=True).alias("asked"))
    conflicts = compare_facts(kept.select("query_id", "chunk_id").join(wanted, "query_id").join(facts, "chunk_id")).select("query_id", "chunk_id", F.col("n_conflicts").alias("conflicts"))
    page = R.final_rank(scored.join(conflicts, ["query_id", "chunk_id"]), options.rerank_weight, options.final_k, options.page_size, (options.page - 1) * options.page_size)
    hits = R.doc_aggs(page).select("query_id", "doc_id", F.col("n").alias("doc_hits"))
    shown = page.join(hits, ["query_id", "doc_id"]).select("query_id", "chunk_id", "final_rank", "semantic", "conflicts", "score", "branch_scores", "doc_id", "doc_hits")
    shown.cached = cached
    return shown


def _with_texts(chunks: DataFrame) -> DataFrame:
    """``chunks`` with all columns that make a ranking text; those that they lack are null."""
    lacking = [c for c in ("document_name", "caption", "table_text") if c not in chunks.columns]
    return chunks.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else chunks
