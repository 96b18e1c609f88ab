"""Queries of the evaluation analytics.

Cases are orders, calls are events, and gold evidence are benchmark passages
looked for in the documents that BM25 finds for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.catalog import retrieval
from sievelight.catalog.registry import Tables, query
from sievelight.catalog.texts import _grams, norm
from sievelight.operators import evaluation as V
from sievelight.operators import search as R

#: Columns of the cases, as expressions that Spark and DuckDB share.
CASES = {
    "id": "o_orderkey",
    "question_type": "o_orderpriority",
    "modality": "CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END",
    "answerable": "o_orderkey % 5 <> 0",
    "error": "CASE WHEN o_orderkey % 17 = 0 THEN 'failed' END",
    "n_chunks": "o_orderkey % 4",
    "hit": "CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_custkey % 3 > 0 THEN 1 ELSE 0 END END",
    "recall": "CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 5) / 4e0 END",
    "latency_ms": "CAST(o_totalprice AS DOUBLE) - 2000",
    "enabled": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 13 <> 0 END",
    "source": "CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'rule' WHEN 2 THEN 'fallback' ELSE NULL END",
    "sufficient": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 2 = 0 END",
    "outcome": "CASE WHEN o_orderkey % 19 = 0 THEN 'system_failure' ELSE 'answered' END",
    "pre_sufficient": "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey % 3 = 0 END",
    "expected_sufficient": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END",
    "expected_behavior": "CASE o_orderkey % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' WHEN 2 THEN 'answer' END",
    "behavior": "CASE o_custkey % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'clarify' WHEN 2 THEN 'answer' END",
    "correctness": "CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE (o_custkey % 12) / 10e0 END",
    "completeness": "(o_orderkey % 11) / 10e0",
    "repair_attempted": "o_orderkey % 3 = 0",
    "satisfied": "o_custkey % 2 = 0",
    "refused": "o_custkey % 4 = 1",
    "scoring_status": "CASE o_orderstatus WHEN 'F' THEN 'scored' WHEN 'O' THEN 'pending' ELSE 'judge_failed' END",
    "calls": "o_orderkey % 6",
    "plan_fallback": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 5 = 0 END",
    "route": "CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE 'multi' END",
    "expected_route": "CASE WHEN o_custkey % 3 = 0 THEN 'single' WHEN o_custkey % 3 = 1 THEN 'multi' END",
}
C = "cases AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CASES.items()) + " FROM orders)"


def cases(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*[f"{e} AS {n}" for n, e in CASES.items()])


def rate(part: str, whole: str) -> str:
    return f"round(CASE WHEN ({whole}) > 0 THEN ({part}) / ({whole}) END, 6)"


def cnt(c: str) -> str:
    return f"count(*) FILTER ({c})"


#: Hits that every sample's question gets.
DEPTH = 20


def samples(t: Tables) -> DataFrame:
    """Samples of two requirements: one with two alternatives, one with two atoms."""
    atom = lambda i, text, name=F.lit("doc"): F.struct(F.lit(i).alias("id"), F.lit("text").alias("type"), name.alias("document_name"), text.alias("text"), F.lit(None).cast("array<string>").alias("row_cells"))
    left, right, whole = F.left("text", F.lit(60)), F.right("text", F.lit(60)), F.col("text")
    req = F.array(
        F.struct(F.lit("r1").alias("id"), F.array(F.array(atom("a1", whole)), F.array(atom("a2", left))).alias("alternatives")),
        F.struct(F.lit("r2").alias("id"), F.array(F.array(atom("a3", left), atom("a4", right))).alias("alternatives")),
    )
    claims = F.array(F.struct(F.lit("c1").alias("id"), left.alias("text"), F.array(F.lit("r1"), F.when(F.col("item_id") % 7 == 0, "r9").otherwise("r2")).alias("required_evidence_ids")))
    return t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 5 != 0).alias("answerable"), req.alias("requirements"), claims.alias("claims"), F.when(F.col("item_id") % 4 == 0, "mixed").alias("modality"))


def retrieved(t: Tables) -> DataFrame:
    """The best documents of every sample by BM25."""
    top = R.top_per_query(retrieval.hits(t), DEPTH)
    content = t.documents.select(F.col("doc_id").alias("chunk_id"), F.lit("dir/DOC").alias("document_name"), F.col("text").alias("content"))
    return top.join(content, "chunk_id").select(F.col("query_id").alias("case_id"), "rank", "chunk_id", "document_name", "content")


ATOMS = retrieval.top_sql(DEPTH) + """, atoms AS (SELECT item_id AS id, unnest([0, 0, 1, 1]) AS req, unnest([0, 1, 0, 0]) AS alt, unnest([0, 0, 0, 1]) AS atom, unnest([text, left(text, 60), left(text, 60), right(text, 60)]) AS text FROM benchmark),
ret AS (SELECT query_id AS id, rank, chunk_id, text AS content FROM top JOIN documents ON doc_id = chunk_id)"""
#: Grams are cut once per atom and once per content and width, then compared.
COVER = rf"""na AS MATERIALIZED (SELECT *, {_grams('a', 'w')} AS ga FROM (SELECT *, least(3, length(a)) AS w FROM (SELECT id, req, alt, atom, {norm('text')} AS a FROM atoms))),
texts_b AS MATERIALIZED (SELECT chunk_id, any_value({norm('content')}) AS b FROM ret GROUP BY chunk_id),
nb AS MATERIALIZED (SELECT chunk_id, w, b, {_grams('b', 'w')} AS gb FROM texts_b, (SELECT DISTINCT w FROM na WHERE w > 0)),
m AS MATERIALIZED (SELECT id, req, alt, atom, rank, ret.chunk_id, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN contains(b, a) THEN 1.0::DOUBLE WHEN contains(a, b) THEN length(b) / length(a) ELSE len(list_intersect(ga, gb)) / len(ga) END AS score
  FROM na JOIN ret USING (id) LEFT JOIN nb ON nb.chunk_id = ret.chunk_id AND nb.w = greatest(na.w, 1))"""
REQS = f"""{ATOMS}, {COVER}, f AS (SELECT id, req, alt, atom, min(rank) AS fr FROM m WHERE score >= 0.8 GROUP BY ALL),
alts AS (SELECT id, req, alt, count(*) AS n, count(fr) AS k, max(fr) AS last FROM atoms LEFT JOIN f USING (id, req, alt, atom) GROUP BY ALL),
reqs AS (SELECT id, req, bool_or(n = k) AS matched, min(last) FILTER (n = k) AS matched_rank, round(max(k / n), 6) AS coverage FROM alts GROUP BY ALL)"""


def matches(t: Tables) -> DataFrame:
    return V.match_text(V.explode_atoms(samples(t)), retrieved(t))


@query("v01_validate_samples", "SELECT item_id AS id, 'unanswerable_with_requirement' AS rule FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT item_id, 'dangling_evidence' FROM benchmark WHERE item_id % 7 = 0")
def v01(t):
    return V.validate_samples(samples(t))


BROKEN = {4: "missing_question", 5: "answerable_without_requirement", 6: "unanswerable_with_requirement", 7: "empty_alternative", 8: "empty_alternative", 9: "unknown_type", 10: "duplicate_requirement", 11: "dangling_evidence"}


@query("v01_sample_rule_cases", f"""WITH s AS (SELECT c_custkey % 20 AS k, CASE WHEN c_custkey % 20 = 1 THEN '' ELSE 's' || (c_custkey - CASE WHEN c_custkey % 20 = 3 THEN 1 ELSE 0 END) END AS id FROM customer), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s)
SELECT id, 'missing_id' AS rule FROM c WHERE id = '' UNION ALL SELECT id, 'duplicate_id' FROM c WHERE n > 1 UNION ALL SELECT id, CASE k {" ".join(f"WHEN {k} THEN '{r}'" for k, r in BROKEN.items())} END FROM c WHERE k BETWEEN 4 AND 11""")
def v01_cases(t):
    """Customers as samples that break every rule in turn."""
    k = F.col("c_custkey") % 20
    name = F.when(k == 1, "").otherwise(F.concat(F.lit("s"), (F.col("c_custkey") - F.when(k == 3, 1).otherwise(0)).cast("string")))
    atom = F.struct(F.lit("a").alias("id"), F.when(k == 9, "sound").otherwise("text").alias("type"))
    none = F.array().cast("array<struct<id:string,type:string>>")
    ways = F.when(k == 7, F.array().cast("array<array<struct<id:string,type:string>>>")).when(k == 8, F.array(F.array(atom), none)).otherwise(F.array(F.array(atom)))
    one = F.struct(F.lit("r1").alias("id"), ways.alias("alternatives"))
    requirements = F.when(k == 5, F.array().cast("array<struct<id:string,alternatives:array<array<struct<id:string,type:string>>>>>")).when(k == 10, F.array(one, one)).otherwise(F.array(one))
    claims = F.array(F.struct(F.when(k == 11, F.array(F.lit("r9"))).otherwise(F.array().cast("array<string>")).alias("required_evidence_ids")))
    return V.validate_samples(t.customer.select(name.alias("id"), F.when(k == 4, " ").otherwise("what?").alias("question"), (k != 6).alias("answerable"), requirements.alias("requirements"), claims.alias("claims")))


@query("v02_explode_atoms", f"WITH {ATOMS} SELECT id, req, alt, atom, text FROM atoms")
def v02(t):
    return V.explode_atoms(samples(t)).select("id", "req", "alt", "atom", "text")


@query("v03_match_text", f"WITH {ATOMS}, {COVER} SELECT id, req, alt, atom, chunk_id, round(score, 6) AS score FROM m")
def v03(t):
    return matches(t).select("id", "req", "alt", "atom", "chunk_id", F.round("score", 6).alias("score"))


@query("v04_match_table_row", """SELECT a.p_partkey // 40 AS id, 0 AS req, 0 AS alt, a.p_partkey AS atom, b.p_partkey AS rank, b.p_partkey AS chunk_id, 1.0::DOUBLE AS score
FROM part a JOIN part b ON a.p_partkey // 40 = b.p_partkey // 40 AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice""")
def v04(t):
    """Parts as rows of tables of forty: three cells of every part, looked for in the rows of its table."""
    cells = F.array("p_name", "p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    p = t.part.withColumn("g", F.expr("p_partkey div 40"))
    atoms = p.select(F.col("g").alias("id"), F.lit(0).alias("req"), F.lit(0).alias("alt"), F.col("p_partkey").alias("atom"), F.lit("Parts").alias("document_name"), F.col("p_name").alias("text"), F.slice(cells, 2, 3).alias("row_cells"))
    rows = p.select(F.col("g").alias("case_id"), F.lit("parts").alias("document_name"), F.col("p_partkey").alias("rank"), F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), cells.alias("cells"))
    return V.match_table_row(atoms, rows).filter("score > 0")


@query("v05_match_figure", "SELECT p_partkey AS id, p_partkey AS chunk_id, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def v05(t):
    atoms = t.part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("req"), F.lit(0).alias("alt"), F.lit(0).alias("atom"), F.col("p_name").alias("text"), F.concat(F.lit("图 "), F.col("p_partkey").cast("string")).alias("locator"))
    chunks = t.part.select(F.col("p_partkey").alias("case_id"), F.lit(1).alias("rank"), F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content"), F.concat(F.lit("图"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(-1 - F.col("p_partkey") * 10).cast("string")).alias("locator"))
    return V.match_figure(atoms, chunks).select("id", "chunk_id", "score")


@query("v06_evaluate_requirements", f"WITH {REQS} SELECT id, req, matched, matched_rank::INT AS matched_rank, coverage FROM reqs")
def v06(t):
    return V.evaluate_requirements(V.explode_atoms(samples(t)), matches(t)).select("id", "req", "matched", "matched_rank", "coverage")


@query("v07_retrieval_metrics", f"""WITH {REQS}, cut AS (SELECT item_id AS id, item_id % 5 <> 0 AS ok, unnest([5, 20, 50]) AS k FROM benchmark),
within_k AS (SELECT id, ok, k, count(req) AS gold, count(*) FILTER (matched_rank <= k) AS found, max(matched_rank) FILTER (matched_rank <= k) AS last FROM cut LEFT JOIN reqs USING (id) GROUP BY ALL),
r AS (SELECT id, k, count(DISTINCT rank) AS relevant FROM cut JOIN m USING (id) WHERE rank <= k AND score >= 0.8 GROUP BY ALL)
SELECT id, k, CASE WHEN ok THEN found = gold END AS hit, CASE WHEN ok THEN round(found / gold, 6) END AS recall, CASE WHEN ok THEN round(coalesce(relevant, 0) / k, 6) END AS precision,
 CASE WHEN ok THEN round(CASE WHEN found = gold THEN 1 / last ELSE 0 END, 6) END AS mrr FROM within_k LEFT JOIN r USING (id, k)""")
def v07(t):
    s = samples(t)
    return V.retrieval_metrics(s, V.explode_atoms(s), matches(t), [5, 20, 50])


@query("v08_duplicate_rate", f"""WITH {ATOMS}, x AS (SELECT id AS case_id, rank, {norm('content')} AS c, chunk_id, unnest([5, 50]) AS k FROM ret)
SELECT case_id, k, round(1 - count(DISTINCT CASE WHEN c <> '' THEN c ELSE chunk_id::VARCHAR END) / count(*), 6) AS duplicate_rate FROM x WHERE rank <= k GROUP BY ALL""")
def v08(t):
    return V.duplicate_rate(retrieved(t), [5, 50])


@query("v09_evidence_set_metrics", f"""WITH {REQS}, g AS (SELECT id, count(*) AS gold, count(*) FILTER (matched) AS found FROM reqs GROUP BY 1), s AS (SELECT id, count(*) AS n FROM ret GROUP BY 1), r AS (SELECT id, count(DISTINCT rank) AS relevant FROM m WHERE score >= 0.8 GROUP BY 1)
SELECT item_id AS id, CASE WHEN item_id % 5 <> 0 THEN found = gold END AS hit, CASE WHEN item_id % 5 <> 0 THEN round(found / gold, 6) END AS recall, CASE WHEN item_id % 5 <> 0 THEN round(coalesce(relevant, 0) / n, 6) END AS precision, coalesce(n, 0) AS n
FROM benchmark JOIN g ON g.id = item_id LEFT JOIN s ON s.id = item_id LEFT JOIN r ON r.id = item_id""")
def v09(t):
    s = samples(t)
    return V.evidence_set_metrics(s, V.explode_atoms(s), matches(t), retrieved(t))


STATUS = "CASE o_orderkey % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'failed' WHEN 2 THEN 'other' END"
BINDING = "CASE o_custkey % 3 WHEN 0 THEN 'bound' WHEN 1 THEN 'unbound' END"
USABLE = f"CASE modality WHEN 'figure' THEN CASE WHEN {STATUS} = 'extracted' THEN true WHEN {STATUS} = 'failed' THEN false END WHEN 'table' THEN CASE WHEN {BINDING} = 'bound' THEN true WHEN {BINDING} = 'unbound' THEN false END ELSE true END"


def usable(t: Tables) -> DataFrame:
    extra = [f"{STATUS} AS visual", f"{BINDING} AS binding", "o_custkey AS cust"]
    named = t.orders.selectExpr(*[f"{e} AS {n}" for n, e in CASES.items()], *extra)
    return named.withColumn("usable", V.modality_usability(F.col("modality"), F.col("visual"), F.col("binding")))


U = f"u AS (SELECT id, cust, modality, answerable, expected_sufficient, {USABLE} AS usable FROM (SELECT o_orderkey, o_custkey, o_custkey AS cust, " + ", ".join(f"{e} AS {n}" for n, e in CASES.items()) + " FROM orders))"


@query("v10_modality_usability", f"WITH {U} SELECT id, modality, usable FROM u")
def v10(t):
    return usable(t).select("id", "modality", "usable")


FOLD = """CASE WHEN count(*) FILTER (NOT usable) > 0 THEN false WHEN count(*) FILTER (usable) = count(*) THEN true END AS all3, CASE WHEN count(*) FILTER (usable) > 0 THEN true WHEN count(*) FILTER (NOT usable) = count(*) THEN false END AS any3"""


@query("v11_three_valued_folds", f"WITH {U} SELECT cust, {FOLD} FROM u GROUP BY cust")
def v11(t):
    return usable(t).groupBy("cust").agg(V.all3(F.col("usable")).alias("all3"), V.any3(F.col("usable")).alias("any3"))


@query("v12_expected_sufficiency", f"WITH {U} SELECT id, CASE WHEN expected_sufficient IS NOT NULL THEN expected_sufficient WHEN id % 8 = 0 THEN NULL WHEN NOT answerable THEN false ELSE usable END AS expected FROM u")
def v12(t):
    return usable(t).select("id", V.expected_sufficiency(F.col("expected_sufficient"), F.col("id") % 8 != 0, F.col("answerable"), F.col("usable")).alias("expected"))


GATE = """gated AS (SELECT *, CASE WHEN NOT available OR dead THEN NULL ELSE NOT sufficient END AS rejected, CASE WHEN available THEN source = 'fallback' END AS fallback FROM (
 SELECT *, NOT coalesce(NOT enabled, false) AND source IS NOT NULL AND sufficient IS NOT NULL AS available, outcome = 'system_failure' AS dead FROM cases)),
att AS (SELECT *, CASE WHEN dead THEN outcome WHEN rejected THEN CASE WHEN pre_sufficient THEN 'false_rejection_with_sufficient_evidence' WHEN NOT pre_sufficient THEN CASE WHEN NOT answerable THEN 'correct_unanswerable_rejection' ELSE 'correct_rejection_after_insufficient_evidence' END END END AS attribution FROM gated)"""


@query("v13_gate_outcomes", f"WITH {C}, {GATE} SELECT id, rejected, fallback, attribution FROM att")
def v13(t):
    return V.gate_outcomes(cases(t)).select("id", "rejected", "fallback", "attribution")


@query("v14_aggregate_stage", f"""WITH {C} SELECT question_type, count(*) AS queries, count(*) FILTER (error IS NULL) AS evaluated, count(error) AS errors, {rate(cnt('error IS NULL AND n_chunks = 0'), cnt('error IS NULL'))} AS empty_rate,
 round(avg(hit) FILTER (error IS NULL), 6) AS mean_hit, count(hit) FILTER (error IS NULL) AS n_hit, round(avg(recall) FILTER (error IS NULL), 6) AS mean_recall, count(recall) FILTER (error IS NULL) AS n_recall FROM cases GROUP BY question_type""")
def v14(t):
    return V.aggregate_stage(cases(t), ["hit", "recall"], ["question_type"])


@query("v15_latency_summary", f"""WITH {C}, l AS (SELECT question_type, latency_ms AS v FROM cases WHERE error IS NULL AND latency_ms >= 0)
SELECT question_type, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY 1""")
def v15(t):
    return V.latency_summary(cases(t), by=["question_type"])


@query("v16_aggregate_gate", f"""WITH {C}, {GATE} SELECT question_type, count(*) AS cases, count(rejected) AS decided, {rate(cnt('rejected'), 'count(rejected)')} AS rejection_rate, {rate(cnt('fallback'), 'count(fallback)')} AS fallback_rate,
 {rate(cnt("attribution = 'false_rejection_with_sufficient_evidence'"), cnt('pre_sufficient AND rejected IS NOT NULL'))} AS false_rejection_rate, count(*) FILTER (starts_with(attribution, 'correct')) AS correct_rejections FROM att GROUP BY 1""")
def v16(t):
    return V.aggregate_gate(V.gate_outcomes(cases(t)), ["question_type"])


@query("v17_aggregate_calls", "SELECT l_linenumber AS k, count(*) AS calls, round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS mean_hit, round(avg(l_discount::DOUBLE), 6) AS mean_recall, round(avg(l_tax::DOUBLE), 6) AS mean_mrr FROM lineitem GROUP BY 1")
def v17(t):
    calls = t.lineitem.select(F.col("l_linenumber").alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("hit"), F.col("l_discount").alias("recall"), F.col("l_tax").alias("mrr"))
    return V.aggregate_calls(calls)


@query("v18_query_run_metrics", f"""WITH {C}, o AS (SELECT l_orderkey AS id, l_linenumber % 4 AS goal, count(*) AS n, bool_and(l_linestatus = 'F') AS ok FROM lineitem GROUP BY ALL), s AS (SELECT id, max(n) = 1 AS valid, bool_and(ok) AS supported FROM o GROUP BY 1)
SELECT count(*) AS runs, round(avg(calls), 6) AS mean_calls, {rate(cnt('plan_fallback'), 'count(plan_fallback)')} AS plan_fallback_rate, {rate(cnt('route = expected_route'), cnt('route IS NOT NULL AND expected_route IS NOT NULL'))} AS route_agreement, {rate(cnt('valid AND supported'), cnt('valid'))} AS goal_support_rate FROM cases LEFT JOIN s USING (id)""")
def v18(t):
    goals = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).alias("goal_id"), F.when(F.col("l_linestatus") == "F", "supported").otherwise("missing").alias("status"))
    return V.query_run_metrics(cases(t), goals)


@query("v19_repair_metrics", f"""WITH {C} SELECT answerable, count(*) AS cases, count(*) FILTER (repair_attempted) AS attempted, {rate(cnt('repair_attempted AND satisfied'), cnt('repair_attempted'))} AS satisfied_rate,
 {rate(cnt('repair_attempted AND NOT answerable AND refused'), cnt('repair_attempted AND NOT answerable'))} AS correct_refusal_rate FROM cases GROUP BY 1""")
def v19(t):
    return V.repair_metrics(cases(t))


IDEALS = {"hit": 1, "recall": 1, "completeness": 1}


@query("v20_failing_samples", f"WITH {C}, m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, id FROM cases WHERE {m} <> 1" for m in IDEALS) + ") SELECT metric, count(*) AS n_failed, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY 1")
def v20(t):
    return V.failing_samples(cases(t), IDEALS).groupBy("metric").agg(F.count("*").alias("n_failed"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("v21_build_summary", f"""WITH {C} SELECT CASE WHEN grouping(question_type) = 0 THEN 'question_type' WHEN grouping(modality) = 0 THEN 'modality' ELSE 'overall' END AS slice, coalesce(question_type, modality) AS value, count(*) AS queries, count(error) AS errors,
 round(avg(hit) FILTER (error IS NULL), 6) AS mean_hit, round(avg(recall) FILTER (error IS NULL), 6) AS mean_recall FROM cases GROUP BY GROUPING SETS ((), (question_type), (modality))""")
def v21(t):
    return V.build_summary(cases(t), ["hit", "recall"], ["question_type", "modality"])


@query("v22_source_modality", "SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN 'mixed' ELSE 'text' END AS modality FROM benchmark")
def v22(t):
    s = samples(t)
    return V.source_modality(s, V.explode_atoms(s))


def answers(t: Tables) -> DataFrame:
    """Documents as answers that cite 1, their id's last digit and 9, with five documents each."""
    marks = F.concat(F.lit("Yes ##1$$. No ##"), (F.col("doc_id") % 10).cast("string"), F.lit("$$; so ##9$$"))
    return t.documents.select(F.col("doc_id").alias("case_id"), marks.alias("answer"), F.lit(5).alias("n_documents"))


@query("v23_citation_validity", "SELECT doc_id AS case_id, 3::BIGINT AS n_citations, CASE WHEN doc_id % 10 BETWEEN 1 AND 5 THEN 2 ELSE 1 END::BIGINT AS n_valid, round(CASE WHEN doc_id % 10 BETWEEN 1 AND 5 THEN 2 ELSE 1 END / 3, 6) AS validity FROM documents")
def v23(t):
    return V.citation_validity(answers(t)).select("case_id", "n_citations", "n_valid", "validity")


#: Line items as claims of their order's answer, judged from their flags.
CLAIMS = {"case_id": "l_orderkey", "claim_index": "l_linenumber", "cited": "l_quantity > 10", "requires": "l_returnflag <> 'A'", "supported": "l_linestatus = 'F'", "judged": "l_partkey % 29 <> 0"}
ITEMS = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber"
J = "cl AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CLAIMS.items()) + f" FROM ({ITEMS}))"


def claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = ("l_quantity", "l_returnflag", "l_linestatus", "l_partkey")
    items = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in names])
    c = items.selectExpr(*[f"{e} AS {n}" for n, e in CLAIMS.items()])
    ids = F.when(F.col("cited"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return c.select("case_id", "claim_index", ids.alias("citation_ids")), c.filter("judged").select("case_id", "claim_index", "requires", "supported", F.array(F.lit(1)).alias("citation_ids"))


@query("v24_citation_scores", f"""WITH {J}, a AS (SELECT case_id, bool_and(judged) AS complete, count(*) FILTER (judged AND requires) AS need, count(*) FILTER (judged AND requires AND supported) AS good, count(*) FILTER (judged AND requires AND cited) AS cited, count(*) FILTER (judged AND requires AND cited AND supported) AS cg FROM cl GROUP BY 1)
SELECT case_id, complete, CASE WHEN complete THEN {rate('cited', 'need')} END AS completeness, CASE WHEN complete THEN {rate('cg', 'cited')} END AS precision, CASE WHEN complete THEN {rate('good', 'need')} END AS recall FROM a""")
def v24(t):
    return V.citation_scores(*claims(t))


FAITH = f"{J}, fa AS (SELECT case_id, count(*) AS n_claims, count(*) FILTER (judged AND supported) AS n_supported, {rate(cnt('judged AND supported'), cnt('judged'))} AS faithfulness, {rate(cnt('judged'), 'count(*)')} AS coverage FROM cl GROUP BY 1)"


@query("v25_faithfulness", f"WITH {FAITH} SELECT case_id, n_claims, n_supported, faithfulness, coverage FROM fa")
def v25(t):
    return V.faithfulness(*claims(t)).select("case_id", "n_claims", "n_supported", "faithfulness", "coverage")


@query("v25_faithfulness_rollup", f"WITH {FAITH} SELECT count(faithfulness) AS answers, round(avg(faithfulness), 6) AS macro, {rate('sum(n_supported)', 'sum(round(n_claims * coverage))')} AS micro FROM fa")
def v25b(t):
    return V.faithfulness_rollup(V.faithfulness(*claims(t)))


QUALITY = ", ".join(f"round(avg({c}) FILTER ({c} BETWEEN 0 AND 1), 6) AS mean_{c}, count(*) FILTER ({c} NOT BETWEEN 0 AND 1) AS failed_{c}" for c in ("correctness", "completeness"))


@query("v26_answer_quality", f"WITH {C} SELECT question_type, {QUALITY} FROM cases GROUP BY 1")
def v26(t):
    return V.answer_quality(cases(t), by=["question_type"])


W, D, B = "expected_behavior", "behavior", "expected_behavior IS NOT NULL AND behavior IS NOT NULL"
REFUSAL = f"""count(*) FILTER ({B}) AS {{cases}}, {rate(cnt(f"{W} = 'refuse' AND {D} = 'refuse'"), cnt(f"{B} AND {D} = 'refuse'"))} AS refusal_precision, {rate(cnt(f"{W} = 'refuse' AND {D} = 'refuse'"), cnt(f"{B} AND {W} = 'refuse'"))} AS refusal_recall,
 {rate(cnt(f"{W} = 'refuse' AND {D} = 'answer'"), cnt(f"{B} AND {W} = 'refuse'"))} AS unsafe_answer_rate, {rate(cnt(f"{W} = 'answer' AND {D} = 'refuse'"), cnt(f"{B} AND {W} = 'answer'"))} AS over_refusal_rate, {rate(cnt(f"{W} = 'clarify' AND {D} = 'clarify'"), cnt(f"{B} AND {W} = 'clarify'"))} AS clarification_accuracy"""
ES, S, K = "expected_sufficient", "sufficient", "expected_sufficient IS NOT NULL AND sufficient IS NOT NULL"
SUFFICIENT = f"""count(*) FILTER ({K}) AS {{cases}}, {rate(cnt(f"{ES} = {S}"), cnt(K))} AS accuracy, {rate(cnt(f"NOT {ES} AND {S}"), cnt(f"{K} AND NOT {ES}"))} AS unsafe_accept_rate, {rate(cnt(f"{ES} AND NOT {S}"), cnt(f"{K} AND {ES}"))} AS false_rejection_rate,
 count(*) FILTER ({ES} IS NULL) AS unknown_expected, count(*) FILTER ({S} IS NULL) AS unknown_actual"""


@query("v27_refusal_metrics", f"WITH {C} SELECT question_type, {REFUSAL.format(cases='cases')} FROM cases GROUP BY 1")
def v27(t):
    return V.refusal_metrics(cases(t), ["question_type"])


@query("v28_sufficiency_metrics", f"WITH {C} SELECT question_type, {SUFFICIENT.format(cases='cases')} FROM cases GROUP BY 1")
def v28(t):
    return V.sufficiency_metrics(cases(t), ["question_type"])


@query("v29_score_coverage", f"WITH {C}, s AS (SELECT error IS NULL AS ok, 'correctness' AS score, correctness AS v FROM cases UNION ALL SELECT error IS NULL, 'completeness', completeness FROM cases) SELECT score, count(*) FILTER (ok) AS applicable, count(*) FILTER (ok AND v BETWEEN 0 AND 1) AS evaluated, count(*) FILTER (ok AND NOT coalesce(v BETWEEN 0 AND 1, false)) AS judge_failed, count(*) FILTER (NOT ok) AS not_applicable FROM s GROUP BY 1")
def v29(t):
    return V.score_coverage(cases(t), ["correctness", "completeness"])


@query("v30_sample_issues", f"""WITH {C} SELECT id, issues FROM (SELECT id, CASE WHEN error IS NOT NULL THEN 'execution_failed' ELSE concat_ws(',', CASE WHEN completeness <> 1 THEN 'completeness' END, CASE WHEN hit <> 1 THEN 'hit' END, CASE WHEN recall <> 1 THEN 'recall' END) END AS issues FROM cases) WHERE issues <> ''""")
def v30(t):
    return V.sample_issues(cases(t), IDEALS)


@query("v31_e2e_summary", f"WITH {C} SELECT coalesce(question_type, 'overall') AS question_type, {QUALITY}, {REFUSAL.format(cases='behavior_cases')}, {SUFFICIENT.format(cases='sufficiency_cases')} FROM cases GROUP BY GROUPING SETS ((), (question_type))")
def v31(t):
    return V.e2e_summary(cases(t))


@query("v32_migrate_samples", "SELECT item_id AS id, CASE WHEN item_id % 5 <> 0 THEN 2 ELSE 0 END AS n_requirements, CASE WHEN item_id % 5 <> 0 THEN 'r2-a1' END AS last_atom, CASE WHEN item_id % 5 <> 0 THEN 'answer' ELSE 'refuse' END AS expected_behavior FROM benchmark")
def v32(t):
    e = F.array(*[F.struct(F.lit("doc").alias("document_name"), f("text", F.lit(40)).alias("text")) for f in (F.left, F.right)])
    v1 = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.left("text", F.lit(20)).alias("answer"), (F.col("item_id") % 5 != 0).alias("answerable"), e.alias("evidence"))
    out = V.migrate_samples(v1)
    last = F.try_element_at(F.col("requirements"), F.lit(-1))["alternatives"][0][0]["id"]
    return out.select("id", F.size("requirements").alias("n_requirements"), last.alias("last_atom"), "expected_behavior")


@query("v33_busy_time", """WITH i AS (SELECT user_id AS trace_id, epoch(ts) AS s, epoch(ts) + value * 60 AS e FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i)
SELECT trace_id, round(sum(greatest(0, e - greatest(s, coalesce(reached, s)))), 3) AS busy FROM o GROUP BY 1""")
def v33(t):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    calls = t.events.select(F.col("user_id").alias("trace_id"), start.alias("start"), (start + F.col("value") * 60).alias("end"))
    return V.busy_time(calls, "trace_id").select("trace_id", F.round("busy", 3).alias("busy"))


@query("v34_run_status", f"WITH {C} SELECT scoring_status, count(*) AS n FROM cases GROUP BY 1")
def v34(t):
    return V.run_status(cases(t))


@query("v35_dataset_profile", f"WITH {C} SELECT modality AS split, count(*) AS n, string_agg(DISTINCT question_type, ',' ORDER BY question_type) AS types, string_agg(DISTINCT source, ',' ORDER BY source) AS versions FROM cases GROUP BY 1")
def v35(t):
    return V.dataset_profile(cases(t).withColumnRenamed("modality", "split").withColumnRenamed("source", "dataset_version"))
