"""Queries of the table model and the evidence algebra.

Tables are forty parts each; evidence are documents, with benchmark passages,
line items and orders as goals, calls and assessments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.catalog import retrieval
from sievelight.catalog.registry import query
from sievelight.operators import evidence as E
from sievelight.operators import search as R
from sievelight.operators import tables as B

#: The table of a part in DuckDB.
TABLE_SQL = "p_partkey // 40"


def table_of_part():
    return F.expr("p_partkey div 40")



def html_tables(t):
    """HTML tables of forty parts: two header rows with spans, a unit row, and the parts."""
    row = F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>"), F.col("p_retailprice").cast("string"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "")
    head = '<table><caption>Parts</caption><tr><th rowspan="2">item</th><th colspan="2">values</th></tr><tr><th>size</th><th>price</th></tr><tr><td colspan="3">in stock</td></tr>'
    return t.part.groupBy(table_of_part().alias("table_id")).agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


def bound(t):
    return B.bind_table_rows(B.html_table_grid(html_tables(t)))


PARTS = f"parts AS (SELECT {TABLE_SQL} AS table_id, p_partkey AS k, p_size AS s, p_retailprice AS p, 3 + row_number() OVER (PARTITION BY {TABLE_SQL} ORDER BY p_partkey) AS row_index FROM part)"


@query("d09_html_table_grid", f"WITH {PARTS}, g AS (SELECT table_id, unnest(['item', 'values', 'values', 'item', 'size', 'price', 'in stock', 'in stock', 'in stock']) AS text, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS row_index, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS col_index FROM (SELECT DISTINCT table_id FROM parts)) SELECT table_id, row_index, col_index, text FROM g UNION ALL SELECT table_id, row_index - 1, 0, k::VARCHAR FROM parts UNION ALL SELECT table_id, row_index - 1, 1, s::VARCHAR FROM parts UNION ALL SELECT table_id, row_index - 1, 2, p::VARCHAR FROM parts")
def d09(t):
    return B.html_table_grid(html_tables(t)).select("table_id", F.col("row_index").cast("long").alias("row_index"), "col_index", "text")


@query("d10_bind_table_rows", f"WITH {PARTS} SELECT table_id, row_index, 'in stock' AS context, 'item,values / size,values / price' AS headers, k || ',' || s || ',' || p AS cells FROM parts")
def d10(t):
    return bound(t).select("table_id", F.col("row_index").cast("long").alias("row_index"), "context", F.array_join("headers", ",").alias("headers"), F.array_join("cells", ",").alias("cells"))


@query("d11_table_row_chunks", f"WITH {PARTS} SELECT table_id, row_index, 'Parts；in stock' || chr(10) || 'item：' || k || '；values / size：' || s || '；values / price：' || p AS semantic_text FROM parts")
def d11(t):
    return B.table_row_chunks(bound(t)).select("table_id", F.col("row_index").cast("long").alias("row_index"), "semantic_text")


@query("d12_table_markdown", f"WITH {PARTS} SELECT table_id, '### Parts' || chr(10) || '#### in stock' || chr(10) || '| item | values / size | values / price |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || s || ' | ' || p || ' |', chr(10) ORDER BY k) AS markdown, '表格：Parts；共' || count(*) || '个数据行；字段：item、values / size、values / price' AS summary FROM parts GROUP BY 1")
def d12(t):
    rows = bound(t)
    return B.table_markdown(rows).join(B.table_summary(rows), "table_id")


def rows(t):
    """Parts as plain table rows: tables by size, sections in half of them."""
    context = F.when(table_of_part() % 2 == 0, F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).otherwise("")
    return t.part.select(table_of_part().alias("table_id"), F.col("p_partkey").alias("row_index"), context.alias("context"), F.array("p_name", F.col("p_size").cast("string"), "p_brand").alias("cells"), F.array(F.lit("name"), F.lit("size"), F.lit("brand")).alias("headers"))


def hits(t):
    """Every part as a row of a table of query table_id / 5; every seventh is scored, two of three of these are selected."""
    return t.part.select((F.floor(table_of_part() / 5)).alias("query_id"), table_of_part().alias("table_id"), F.col("p_partkey").alias("row_index"), F.col("p_partkey").alias("rank"), (F.col("p_partkey") % 7 == 0).alias("scored"), ((F.col("p_partkey") % 7 == 0) & (F.col("p_partkey") % 3 != 0)).alias("selected"))


HITS = f"""r AS (SELECT {TABLE_SQL} AS table_id, p_partkey AS row_index, CASE WHEN {TABLE_SQL} % 2 = 0 THEN 's' || (p_size % 3) ELSE '' END AS ctx, row_number() OVER (PARTITION BY {TABLE_SQL} ORDER BY p_partkey) AS pos, count(*) OVER (PARTITION BY {TABLE_SQL}) AS n FROM part),
h AS (SELECT {TABLE_SQL} // 5 AS query_id, {TABLE_SQL} AS table_id, p_partkey AS row_index, p_partkey % 7 = 0 AND p_partkey % 3 <> 0 AS selected, p_partkey % 7 = 0 AS scored FROM part)"""
WINDOW = f"""{HITS}, hp AS (SELECT query_id, h.table_id, pos AS hp, ctx AS hc FROM h JOIN r ON h.table_id = r.table_id AND h.row_index = r.row_index WHERE selected),
win AS (SELECT query_id, r.table_id, row_index, min(abs(pos - hp)) AS distance FROM hp JOIN r USING (table_id) WHERE n <= 5 OR CASE WHEN hc <> '' THEN ctx = hc ELSE abs(pos - hp) <= 2 END GROUP BY ALL),
near AS (SELECT * FROM win WHERE (query_id, table_id, row_index) NOT IN (SELECT query_id, table_id, row_index FROM h WHERE scored AND NOT selected))"""


@query("r25_group_table_rows", f"WITH {HITS} SELECT query_id, table_id, min(row_index) FILTER (selected) AS rank, count(*) FILTER (selected) AS n_members, count(*) FILTER (scored AND NOT selected) AS n_omitted FROM h GROUP BY ALL HAVING count(*) FILTER (selected) > 0")
def r25(t):
    return B.group_table_rows(hits(t)).select("query_id", "table_id", "rank", F.size("members").cast("long").alias("n_members"), F.size("omitted").cast("long").alias("n_omitted"))


@query("r26_table_row_window", f"WITH {WINDOW} SELECT query_id, table_id, row_index, distance FROM near")
def r26(t):
    return B.table_row_window(hits(t), rows(t)).select("query_id", "table_id", "row_index", F.col("distance").cast("long").alias("distance"))


@query("r27_table_column_window", "SELECT l_orderkey, l_linenumber, l_partkey, 'c0,c' || lo || ',c' || (lo + 1) || ',c' || (lo + 2) AS headers FROM (SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, least(1 + l_partkey % 9 - 1, 10 - 3)) AS lo FROM lineitem)")
def r27(t):
    heads = F.array(*[F.lit(f"c{i}") for i in range(10)])
    wide = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 9).alias("query_id"), heads.alias("headers"), heads.alias("cells"))
    questions = t.spark.range(9).select(F.col("id").alias("query_id"), F.concat(F.lit("what is C"), (F.col("id") + 1).cast("string")).alias("text"))
    return B.table_column_window(wide, questions, 4).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("headers", ",").alias("headers"))


@query("r28_fit_rows_to_budget", f"""WITH {WINDOW}, z AS (SELECT near.*, s.rank, ((row_index % 7) + 1) AS size FROM near LEFT JOIN (SELECT query_id, table_id, row_index, row_index AS rank FROM h WHERE selected) s USING (query_id, table_id, row_index)),
o AS (SELECT *, row_number() OVER w AS priority, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM z WINDOW w AS (PARTITION BY query_id, table_id ORDER BY CASE WHEN distance = 0 THEN 0 ELSE 1 END, rank NULLS LAST, distance, row_index))
SELECT query_id, table_id, row_index, size AS n_tokens FROM o WHERE used <= 20 OR priority = 1""")
def r28(t):
    near = B.table_row_window(hits(t), rows(t)).join(hits(t).filter("selected").select("query_id", "table_id", "row_index", "rank"), ["query_id", "table_id", "row_index"], "left")
    sized = near.withColumn("text", F.repeat(F.lit("w "), (F.col("row_index") % 7 + 1).cast("int")))
    return B.fit_rows_to_budget(sized, 20).select("query_id", "table_id", "row_index", F.col("n_tokens").cast("long").alias("n_tokens"))


@query("r29_expand_tables", f"""WITH {WINDOW}, z AS (SELECT near.*, s.rank, 'name：' || p_name || '；size：' || p_size || '；brand：' || p_brand AS text FROM near JOIN part ON p_partkey = row_index LEFT JOIN (SELECT query_id, table_id, row_index, row_index AS rank FROM h WHERE selected) s USING (query_id, table_id, row_index)),
o AS (SELECT *, row_number() OVER w AS priority, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM z WINDOW w AS (PARTITION BY query_id, table_id ORDER BY CASE WHEN distance = 0 THEN 0 ELSE 1 END, rank NULLS LAST, distance, row_index))
SELECT query_id, table_id, row_index, text FROM o WHERE used <= 60 OR priority = 1""")
def r29(t):
    questions = hits(t).select("query_id").distinct().withColumn("text", F.lit("which brand"))
    return B.expand_tables(hits(t), rows(t), questions, 60)[0].select("query_id", "table_id", "row_index", "text")


@query("r30_recover_rows", "SELECT n_nationkey AS ref, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS text FROM nation")
def r30(t):
    versions = t.nation.select(F.col("n_nationkey").alias("ref"), F.lit("v1").alias("version"), F.col("n_name").alias("text")).unionByName(t.nation.filter("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("ref"), F.lit("v2").alias("version"), F.lower("n_name").alias("text")))
    return B.recover_rows(t.nation.select(F.col("n_nationkey").alias("ref")), versions)


def parts(t):
    """Documents as evidence of their source, in id order: ids repeat, and so do fingerprints of copies."""
    return t.documents.select((F.col("doc_id") % 300).alias("evidence_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("text"), F.col("source").alias("query"), F.lit("text").alias("source_kind"), F.col("lang").alias("document_id"))


@query("e01_merge_evidence", "WITH p AS (SELECT doc_id % 300 AS evidence_id, doc_id AS ord, lang, source FROM documents) SELECT evidence_id, min(ord) AS ord, count(DISTINCT lang) > 1 AS conflict, count(DISTINCT source) AS n_traces FROM p GROUP BY 1")
def e01(t):
    items, conflicts, traces = E.merge_evidence(E.content_fingerprint(parts(t)))
    n = traces.groupBy("evidence_id").agg(F.count("*").alias("n_traces"))
    return items.join(conflicts, "evidence_id", "left").join(n, "evidence_id").select("evidence_id", "ord", F.col("versions").isNotNull().alias("conflict"), "n_traces")


@query("e02_content_fingerprint", """SELECT doc_id AS ord, sha256('{"text":"' || lang || '","source_kind":"text","document_id":"' || lang || '"}') AS fp FROM documents""")
def e02(t):
    return E.content_fingerprint(parts(t)).select("ord", "fp")


@query("e03_select_by_ids", "SELECT n_nationkey AS request_id, pos, doc_id AS evidence_id FROM nation, (VALUES (0), (1), (2)) v(pos) JOIN documents ON doc_id = n_nationkey * 3 + 2 - pos")
def e03(t):
    k = F.col("n_nationkey") * 3
    req = t.nation.select(F.col("n_nationkey").alias("request_id"), F.array(k + 2, k + 1, k + 2, k).alias("ids"))
    return E.select_by_ids(t.documents.select(F.col("doc_id").alias("evidence_id"), "lang"), req).select("request_id", "pos", "evidence_id")


@query("e04_record_to_evidence", """SELECT CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE 'ev-' || left(sha256('{"d":' || doc_id || ',"t":"' || lang || '"}'), 16) END AS chunk_id, lang AS content_with_weight, 'text' AS evidence_type_kwd, doc_id FROM documents""")
def e04(t):
    records = t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), "doc_id")).alias("chunk_id"), F.col("lang").alias("content_with_weight"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("evidence_type_kwd"), "doc_id")
    return E.evidence_to_record(E.record_to_evidence(records))


@query("e05_grounded_rows", "SELECT p_partkey, p_partkey % 4 = 0 AS grounded FROM part")
def e05(t):
    original = F.array("p_name", "p_brand", "p_type")
    case = F.col("p_partkey") % 4
    cells = F.when(case == 1, F.array("p_name", F.lit("other"))).otherwise(F.array("p_name", "p_type"))
    indices = F.when(case == 2, F.array(F.lit(0), F.lit(0))).when(case == 3, F.array(F.lit(0), F.lit(9))).otherwise(F.array(F.lit(0), F.lit(2)))
    return E.grounded_rows(t.part.select("p_partkey", cells.alias("cells"), cells.alias("headers"), indices.alias("column_indices"), original.alias("original"))).select("p_partkey", "grounded")


@query("e06_source_notes", "SELECT p_partkey AS table_id, 'note ' || p_partkey AS notes FROM part")
def e06(t):
    text = F.concat("p_name", F.lit("\n note "), F.col("p_partkey").cast("string"), F.lit("\n\n"), "p_brand")
    return E.source_notes(t.part.select(F.col("p_partkey").alias("table_id"), text.alias("semantic_text"), F.array("p_name", "p_brand").alias("rendered"))).select("table_id", F.array_join("notes", "|").alias("notes"))


def terms_sql(text: str) -> str:
    """Different words and CJK bigrams of ``text``."""
    runs = rf"regexp_extract_all({text}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}')"
    return rf"list_distinct(list_concat(regexp_extract_all(lower({text}), '[a-z0-9_]+'), flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"


#: One turn after the other: turn n belongs to goal n modulo the number of goals and takes its best item outside ``taken``.
GOALS = retrieval.top_sql(20) + rf""", goal AS (SELECT item_id // 4 AS q, row_number() OVER (PARTITION BY item_id // 4 ORDER BY item_id) - 1 AS g, {terms_sql("concat_ws(' ', text, 'source ' || item_id % 3)")} AS gt FROM benchmark WHERE item_id // 4 % 5 <> 4),
found AS (SELECT query_id // 4 AS q, chunk_id, min(query_id) AS first FROM top GROUP BY ALL),
e AS (SELECT q, chunk_id AS ev, {terms_sql("concat_ws(' ', text, source, b.trace)")} AS et FROM found JOIN documents ON doc_id = chunk_id JOIN (SELECT item_id, left(text, 30) AS trace FROM benchmark) b ON item_id = first),
ro AS (SELECT q, g, ev, row_number() OVER (PARTITION BY q, g ORDER BY len(list_intersect(gt, et)) DESC, ev) AS round FROM goal JOIN e USING (q)),
sizes AS (SELECT q, count(DISTINCT g) AS goals, count(DISTINCT ev) AS items FROM ro GROUP BY q),
walk AS (SELECT q, 0::BIGINT AS turn, []::BIGINT[] AS taken FROM sizes
 UNION ALL SELECT walk.q, turn + 1, list_append(taken, min_by(ev, round)) FROM walk JOIN sizes USING (q) JOIN ro ON ro.q = walk.q AND g = turn % goals AND NOT list_contains(taken, ev) WHERE turn < items GROUP BY walk.q, turn, taken),
done AS (SELECT walk.q, taken FROM walk JOIN sizes ON sizes.q = walk.q AND turn = items)
SELECT q AS question_id, unnest(range(0, len(taken)))::INT AS pos, unnest(taken) AS evidence_id FROM done
UNION ALL SELECT q, (row_number() OVER (PARTITION BY q ORDER BY ev) - 1)::INT, ev FROM e WHERE q NOT IN (SELECT q FROM goal)"""


@query("e07_goal_round_robin", f"WITH RECURSIVE {GOALS}")
def e07(t):
    """Four passages are the goals of a question, none of every fifth one; the evidence are the best hits of any of them."""
    goals = t.benchmark.select(F.expr("item_id div 4").alias("question_id"), F.col("item_id").alias("goal_no"), "text", F.array(F.concat(F.lit("source "), (F.col("item_id") % 3).cast("string"))).alias("constraints"))
    found = R.top_per_query(retrieval.hits(t), 20).groupBy(F.expr("query_id div 4").alias("question_id"), F.col("chunk_id").alias("doc_id")).agg(F.min("query_id").alias("item_id"))
    trace = t.benchmark.select("item_id", F.array(F.left("text", F.lit(30))).alias("queries"))
    evidence = found.join(t.documents, "doc_id").join(trace, "item_id").select("question_id", F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("ord"), "text", F.col("source").alias("source_name"), "queries")
    return E.goal_round_robin(goals.filter("question_id % 5 <> 4"), evidence)


@query("e08_budget_select", """WITH RECURSIVE r AS (SELECT o_custkey AS q, o_orderkey AS id, (o_orderkey % 97 + 1) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT q, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS n FROM (SELECT DISTINCT q FROM r)
 UNION ALL SELECT w.q, r.i, CASE WHEN used + size <= 150 THEN used + size ELSE used END, CASE WHEN used + size <= 150 THEN n + 1 ELSE n END FROM w JOIN r ON r.q = w.q AND r.i = w.i + 1)
SELECT q AS question_id, max(n) AS n_chosen, max(i) - max(n) AS n_omitted FROM w GROUP BY 1""")
def e08(t):
    ordered = t.orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("evidence_id"), (F.col("o_orderkey") % 97 + 1).alias("size"))
    return E.budget_select(ordered, 150).select("question_id", F.size("chosen").cast("long").alias("n_chosen"), F.size("omitted").cast("long").alias("n_omitted"))


@query("e09_char_budget_prefix", "WITH b AS (SELECT source, doc_id, text, 8000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents) SELECT source AS question_id, doc_id AS pos, length(left(text, room::BIGINT)) AS chars FROM b WHERE room > 0")
def e09(t):
    return E.char_budget_prefix(t.documents.select(F.col("source").alias("question_id"), F.col("doc_id").alias("pos"), "text")).select("question_id", "pos", F.length("text").cast("long").alias("chars"))


@query("e10_dictionary_encode_rows", "WITH x AS (SELECT p_partkey % 50 AS table_id, p_partkey AS pos, p_size FROM part), f AS (SELECT *, min(pos) OVER (PARTITION BY table_id, p_size) AS first FROM x) SELECT table_id, pos, 'r' || dense_rank() OVER (PARTITION BY table_id ORDER BY first) AS row_ref, 'h1' AS header_ref FROM f")
def e10(t):
    return E.dictionary_encode_rows(t.part.select((F.col("p_partkey") % 50).alias("table_id"), F.col("p_partkey").alias("pos"), F.array("p_size").alias("cells"), F.array(F.lit("size")).alias("headers"))).select("table_id", "pos", "row_ref", "header_ref")


#: Line items as assessments of their order's goals.
ASSESS = {"question_id": "l_orderkey", "goal_id": "l_linenumber", "status": "CASE l_returnflag WHEN 'R' THEN 'missing' ELSE 'supported' END", "sufficient": "l_orderkey % 3 = 0", "n": "l_partkey % 5"}
A = "a AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ASSESS.items()) + " FROM lineitem)"


def assessments(t):
    a = t.lineitem.selectExpr(*[f"{e} AS {n}" for n, e in ASSESS.items()])
    return a.withColumn("supporting_ids", F.when(F.col("n") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))


@query("e11_validate_assessments", f"""WITH {A}, g AS (SELECT o_orderkey AS question_id, 1 AS goal_id FROM orders), c AS (SELECT question_id, goal_id, count(*) AS k FROM a GROUP BY ALL), v AS (SELECT question_id, bool_or(sufficient) AS s, count(*) FILTER (status = 'missing') AS m FROM a GROUP BY 1)
SELECT DISTINCT question_id, rule FROM (SELECT g.question_id, 'goal_not_once' AS rule FROM g LEFT JOIN c USING (question_id, goal_id) WHERE coalesce(k, 0) <> 1 UNION ALL SELECT question_id, 'support_without_source' FROM a WHERE status = 'supported' AND n = 0
 UNION ALL SELECT question_id, 'verdict_contradicts_missing' FROM v WHERE s <> (m = 0) UNION ALL SELECT question_id, 'too_many_missing' FROM v WHERE m > 8)""")
def e11(t):
    return E.validate_assessments(assessments(t), t.orders.select(F.col("o_orderkey").alias("question_id"), F.lit(1).cast(t.lineitem.schema["l_linenumber"].dataType).alias("goal_id")))


def versions(t):
    """(previous, partial) assessments by customer: orders of the first and second half of the year."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("goal_id"))
    a = rows.agg(F.min("o_orderstatus").alias("x"), F.max("o_orderstatus").alias("y"))
    name = lambda c: F.when(F.col(c) == "F", "supported").otherwise("missing")
    return a.select("question_id", "goal_id", name("x").alias("status")), a.filter("question_id % 2 = 0").select("question_id", "goal_id", name("y").alias("status"))


@query("e12_merge_gap", "WITH a AS (SELECT o_custkey AS question_id, o_orderpriority AS goal_id, min(o_orderstatus) = 'F' AS x, max(o_orderstatus) = 'F' AS y FROM orders GROUP BY ALL), m AS (SELECT question_id, goal_id, CASE WHEN x OR (question_id % 2 = 0 AND y) THEN 'supported' ELSE 'missing' END AS status FROM a) SELECT *, bool_and(status = 'supported') OVER (PARTITION BY question_id) AS sufficient FROM m")
def e12(t):
    return E.merge_gap(*versions(t))


@query("e13_incremental_scope", "SELECT doc_id % 10 AS question_id, doc_id AS evidence_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def e13(t):
    reviewed = t.labels.select((F.col("doc_id") % 10).alias("question_id"), F.col("doc_id").alias("evidence_id"), (F.col("quality") == 1).alias("used"))
    return E.incremental_scope(t.documents.select((F.col("doc_id") % 10).alias("question_id"), F.col("doc_id").alias("evidence_id")), reviewed)


@query("e14_report_reusable", "SELECT c_custkey AS question_id, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS reusable FROM customer")
def e14(t):
    name = F.col("c_name")
    v = t.customer.select(F.col("c_custkey").alias("question_id"), name.alias("query_version"), name.alias("evidence_version"), name.alias("policy_version"))
    other = v.filter("question_id % 5 <> 0").withColumn("query_version", F.when(F.col("question_id") % 3 == 0, "other").otherwise(F.col("query_version")))
    return E.report_reusable(v, other)


@query("e15_rule_verdicts", "SELECT c_custkey AS question_id, CASE WHEN c_custkey % 11 = 0 THEN 'empty_question' WHEN o.n IS NULL THEN 'no_evidence' WHEN conflict THEN 'identity_conflict' WHEN c_custkey % 2 = 0 AND unread THEN 'figures_unread' ELSE 'undecided' END AS verdict FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderkey % 23 = 0) AS conflict, bool_and(o_orderstatus <> 'F') AS unread FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def e15(t):
    q = t.customer.select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_name")).alias("text"), (F.col("c_custkey") % 2 == 0).alias("visual"))
    e = t.orders.select(F.col("o_custkey").alias("question_id"), (F.col("o_orderkey") % 23 == 0).alias("conflict"), F.when(F.col("o_orderstatus") == "F", "text").otherwise("figure").alias("source_kind"), F.lit(False).alias("extracted"))
    return E.rule_verdicts(q, e)


def supported(t):
    ev = t.orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("source_kind"), F.col("o_orderpriority").alias("text"))
    sup = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("goal_id"), F.col("o_orderkey").alias("evidence_id"))
    return E.answer_context(ev, sup), sup


NUMBERED = "num AS (SELECT o_custkey AS question_id, o_orderkey AS evidence_id, o_orderpriority AS goal_id, o_orderstatus AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS citation FROM orders WHERE o_orderkey % 3 = 0)"


@query("e16_answer_context", f"WITH {NUMBERED} SELECT question_id, goal_id, string_agg(citation::VARCHAR, ',' ORDER BY citation) AS citations FROM num GROUP BY ALL")
def e16(t):
    return E.goal_citations(*supported(t)).select("question_id", "goal_id", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query("e17_row_roles", "SELECT p_partkey AS row_index, CASE WHEN p_partkey % 4 = 0 THEN 'matched' WHEN p_partkey % 2 = 0 THEN 'context' ELSE 'unknown' END AS role FROM part")
def e17(t):
    k = F.col("p_partkey")
    return E.row_roles(t.part.select(k.alias("row_index"), F.when(k % 4 == 0, F.array(k)).otherwise(F.array(k + 1)).alias("matched"), F.when(k % 2 == 0, F.array(k)).otherwise(F.array(k + 1)).alias("shown"))).select("row_index", "role")


@query("e18_reference_text", f"""WITH {NUMBERED} SELECT question_id, string_agg('[' || citation || '] {{"kind":"' || kind || '","text":"' || goal_id || '"}}', chr(10) ORDER BY kind, citation) AS reference FROM num GROUP BY 1""")
def e18(t):
    return E.reference_text(supported(t)[0])


@query("e19_kb_refusals", "SELECT o_custkey AS turn_id, bool_or(o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 5 < 4) AND NOT bool_or(o_orderkey % 5 = 4) AS refuse FROM orders GROUP BY 1")
def e19(t):
    return E.kb_refusals(t.orders.select(F.col("o_custkey").alias("turn_id"), F.when(F.col("o_orderstatus") == "F", "knowledge_base").otherwise("web").alias("tool"), (F.col("o_orderkey") % 2 == 0).alias("ok"), (F.col("o_orderkey") % 5 == 4).cast("int").alias("n_evidence")))
