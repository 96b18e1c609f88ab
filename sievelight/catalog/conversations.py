"""Queries of sources, conversations, relational data, entities and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.catalog.registry import query
from sievelight.operators import conversations as C
from sievelight.operators import entities as N
from sievelight.sources import chunks as S


def chunk_rows(t):
    return t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "lang", "n_chars")


@query("s03_select_samples", "SELECT doc_id AS id, lang AS split FROM documents WHERE lang IN ('fr', 'de') ORDER BY doc_id LIMIT 100")
def s03(t):
    """The limit is the operator's own."""
    return S.select_samples(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("split")), splits=["fr", "de"], limit=100)


@query("s05_replace_document", "SELECT source AS doc_id, count(*) FILTER (doc_id % 3 = 0) AS indexed, count(*) FILTER (doc_id % 3 <> 0) AS removed FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 3 = 0) > 0")
def s05(t):
    rows = chunk_rows(t)
    return S.replace_document(rows, rows.filter("chunk_id % 3 = 0"))[1]


@query("s06_delete_where", "SELECT count(*) AS n, count(*) FILTER (lang IN ('fr', 'de') AND source LIKE '%1%') AS deleted FROM documents")
def s06(t):
    stay, hit = S.delete_where(t.documents, lang=["fr", "de"], source="*1*")
    return t.documents.agg(F.count("*").alias("n"), F.count_if(hit).alias("deleted"))


@query("s07_list_chunks", "SELECT doc_id AS chunk_id, page FROM (SELECT doc_id, (n_chars % 5 + n_chars % 3) / 2.0::DOUBLE AS page, n_chars FROM documents) ORDER BY page, n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def s07(t):
    """A page of the listing; the limit is the operator's own."""
    rows = t.documents.select(F.col("doc_id").alias("chunk_id"), F.array(F.col("n_chars") % 5, F.col("n_chars") % 3).alias("pages"), F.col("n_chars").alias("created"))
    listed = S.list_chunks(rows, 20, 50, ("pages",))
    return listed.select("chunk_id", ((F.col("pages")[0] + F.col("pages")[1]) / 2).alias("page"))


@query("s08_sql_retrieval", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def s08(t):
    return S.sql_retrieval(t.spark, {"chunk_view": t.documents}, "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM chunk_view GROUP BY lang")


@query("s10_put_tables", "SELECT item_id, p.table_id IS NOT NULL AS found FROM benchmark LEFT JOIN (SELECT DISTINCT sha256(text) AS table_id FROM documents) p ON p.table_id = sha256(benchmark.text)")
def s10(t):
    stored = S.put_tables(t.documents.select(F.sha2("text", 256).alias("table_id"), "source"))
    return S.get_tables(stored, t.benchmark.select("item_id", F.sha2("text", 256).alias("table_id"))).select("item_id", F.col("source").isNotNull().alias("found"))


@query("s11_reindex_plan", "WITH f AS (SELECT 'src' || (n_nationkey % 23) AS name, count(*) AS n_files FROM nation GROUP BY 1), c AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1) SELECT name, n_files, coalesce(n, 0) AS n_chunks, CASE WHEN n_files > 1 THEN 'duplicate' WHEN n IS NULL THEN 'absent' END AS problem FROM f LEFT JOIN c USING (name)")
def s11(t):
    return S.reindex_plan(t.nation.select(F.concat(F.lit("src"), (F.col("n_nationkey") % 23).cast("string")).alias("name")), t.documents.select(F.col("source").alias("name")))


@query("s12_duplicate_uploads", "WITH b AS (SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name FROM customer WHERE c_custkey % 6 = 0) SELECT name, 'repeated' AS reason FROM b GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT name, 'stored' FROM b WHERE name IN (SELECT c_name FROM customer WHERE c_custkey % 5 = 0)")
def s12(t):
    name = t.customer.select(F.col("c_name").alias("name"), "c_custkey")
    return S.duplicate_uploads(name.filter("c_custkey % 2 = 0").select("name").unionByName(name.filter("c_custkey % 6 = 0").select("name")), name.filter("c_custkey % 5 = 0"))


@query("s13_upload_outcome", "SELECT o_custkey AS request_id, count(*) FILTER (o_orderstatus = 'F') AS n_ok, count(*) FILTER (o_orderstatus <> 'F') AS n_failed, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'success' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial_success' ELSE 'failed' END AS outcome FROM orders GROUP BY 1")
def s13(t):
    return S.upload_outcome(t.orders.select(F.col("o_custkey").alias("request_id"), (F.col("o_orderstatus") == "F").alias("ok")))


def turns(t):
    """Orders as the turns of their customer's session."""
    return t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 9).cast("int")).alias("answer"))


def sessions(t):
    return t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"))


MARKER = C.HISTORY_MARKER


def cut_sql(text: str, limit: str) -> str:
    """``text`` in at most ``limit`` characters, two thirds of its head and one of its tail around the marker."""
    room = f"({limit} - {len(MARKER)})"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} WHEN {room} <= 0 THEN left({text}, {limit}) ELSE left({text}, {room} * 2 // 3) || e{MARKER!r} || right({text}, {room} - {room} * 2 // 3) END"


#: Budgets of both sides, step by step: halves first, the rest to the question, what is left to the answer.
FIT = """(SELECT *, CASE WHEN length(a) = 0 THEN b ELSE q1 + least(length(q) - q1, b - q1 - a1) END AS qb, CASE WHEN length(q) = 0 THEN b ELSE a1 + least(length(a) - a1, b - q1 - a1 - least(length(q) - q1, b - q1 - a1)) END AS ab
 FROM (SELECT *, least(length(a), b - q1) AS a1 FROM (SELECT *, least(length(q), b // 2) AS q1 FROM {source})))"""


@query("c01_recent_history", f"""WITH t AS (SELECT o_custkey AS session_id, c_nationkey AS user_id, o_orderkey AS turn, trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'q' || o_orderkey END) AS q, trim(repeat(o_orderpriority, (o_orderkey % 9)::INT)) AS a,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = o_custkey % 25 OR c_nationkey < 20),
n AS (SELECT *, 90 AS b, length(q) + length(a) AS size FROM t WHERE age <= 8 AND length(q) + length(a) > 0),
u AS (SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY age) AS used, row_number() OVER (PARTITION BY session_id ORDER BY age) AS nth FROM n),
f AS (SELECT * FROM {FIT.format(source='u')} WHERE used <= 90 OR nth = 1),
m AS (SELECT session_id, user_id, nth, unnest([0, 1]) AS side, unnest(['user', 'assistant']) AS role, unnest([CASE WHEN size > 90 THEN {cut_sql('q', 'qb')} ELSE q END, CASE WHEN size > 90 THEN {cut_sql('a', 'ab')} ELSE a END]) AS content FROM f)
SELECT session_id, user_id, row_number() OVER (PARTITION BY session_id, user_id ORDER BY nth DESC, side)::INT AS pos, role, content FROM m WHERE content <> ''""")
def c01(t):
    """Every fifth question is blank; the requests name a wrong user for some sessions, which then have no history."""
    said = turns(t).withColumn("question", F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("question")))
    asked = sessions(t).select("session_id", F.when(F.col("user_id") < 20, F.col("user_id")).otherwise((F.col("session_id") % 25).cast("int")).alias("user_id"))
    return C.recent_history(said, sessions(t), asked, 8, 90)


@query("c02_fit_turn", f"""WITH x AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN '' WHEN item_id % 3 = 0 THEN left(text, 40) ELSE text END AS q, CASE WHEN item_id % 5 = 0 THEN '' WHEN item_id % 4 = 0 THEN left(text, 30) ELSE text || text END AS a, 200 AS b FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, {cut_sql('q', 'qb')} AS question, {cut_sql('a', 'ab')} AS answer FROM {FIT.format(source='x')}""")
def c02(t):
    n = F.col("item_id")
    question = F.when(n % 7 == 0, "").when(n % 3 == 0, F.left("text", F.lit(40))).otherwise(F.col("text"))
    answer = F.when(n % 5 == 0, "").when(n % 4 == 0, F.left("text", F.lit(30))).otherwise(F.concat("text", "text"))
    q, a = C.fit_turn(question, answer, 200)
    return t.benchmark.filter("text is not null").select("item_id", q.alias("question"), a.alias("answer"))


@query("c03_bounded_context", """WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS age FROM conversations WHERE role IN ('user', 'assistant')),
b AS (SELECT *, 300 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s WHERE age <= 4) SELECT conv_id AS session_id, turn, left(text, room::BIGINT) AS text FROM b WHERE room > 0""")
def c03(t):
    return C.bounded_context(t.conversations.withColumnRenamed("conv_id", "session_id"), 4, 300).select("session_id", "turn", "text")


@query("c04_user_messages", "SELECT o_custkey AS session_id, o_orderkey AS turn FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def c04(t):
    return C.owned_rows(turns(t), sessions(t), 7).select("session_id", "turn")


@query("c05_latest_upload", "SELECT o_custkey AS session_id, count(*) AS n_uploads, max_by(o_orderkey::VARCHAR, (o_orderdate, o_orderkey::VARCHAR)) AS latest FROM orders GROUP BY 1")
def c05(t):
    return C.latest_upload(t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderdate").alias("created_at")))


@query("c06_has_knowledge_base", "SELECT c_custkey AS user_id, c_custkey IN (SELECT o_custkey FROM orders) AS has_kb FROM customer")
def c06(t):
    return C.has_knowledge_base(t.customer.select(F.col("c_custkey").alias("user_id")), t.orders.select(F.col("o_custkey").alias("user_id")))


@query("c07_fk_violations", """SELECT 'orders' AS child, 'o_custkey' AS "column", o_custkey::VARCHAR AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY 3
 UNION ALL SELECT 'lineitem', 'l_orderkey', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 3""")
def c07(t):
    tables = {"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer.filter("c_custkey % 10 <> 0")}
    return C.fk_violations(tables, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])


@query("c08_cascade_delete", "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)) AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0))) AS items")
def c08(t):
    ids = t.customer.filter("c_custkey % 10 = 0").select("c_custkey")
    out = C.cascade_delete({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, "customer", "c_custkey", ids, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    n = lambda k, name: out[k].agg(F.count("*").alias(name))
    return n("customer", "customers").join(n("orders", "orders")).join(n("lineitem", "items"))  # three one-row counts


@query("c09_live_session_docs", "WITH n AS (SELECT user_id AS session_id, max_by(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS name, max(ts) AS ts FROM events GROUP BY 1) SELECT session_id, name, (7200 - (floor(epoch(TIMESTAMP '2024-01-30 23:00:00')) - floor(epoch(ts))))::BIGINT AS seconds_left FROM n WHERE 7200 - (floor(epoch(TIMESTAMP '2024-01-30 23:00:00')) - floor(epoch(ts))) > 0")
def c09(t):
    docs = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("name"), "ts")
    return C.live_session_docs(docs, F.lit("2024-01-30 23:00:00").cast("timestamp")).select("session_id", "name", "seconds_left")


@query("c10_call_budget", """WITH n AS (SELECT event_id AS call_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS s, event_type FROM events)
SELECT call_id, (CASE event_type WHEN 'click' THEN i <= 16 WHEN 'view' THEN i <= 12 ELSE true END) AND s <= 1000000 AS admitted FROM n""")
def c10(t):
    calls = t.events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("call_id"), F.col("event_type").alias("kind"), "ts")
    return C.call_budget(calls, {"click": 16, "view": 12}, 1e6).select("call_id", "admitted")


def registry(t):
    """Nations as a registry: name and key as aliases, regions by name."""
    return t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("company").alias("kind"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("aliases"))


def aliases(t):
    named = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("alias"))
    return named.unionByName(t.spark.createDataFrame([("w1", "the"), ("w2", "and the"), ("w3", "the")], "entity_id string, alias string"))


#: Mentions in DuckDB: aliases of one word, or of two words and a blank, among the pieces of each text.
MENTIONS = r"""names AS (SELECT n_name AS alias, 'n' || n_nationkey AS entity FROM nation UNION ALL SELECT * FROM (VALUES ('the', 'w1'), ('and the', 'w2'), ('the', 'w3'))),
pieces AS (SELECT alias, count(DISTINCT entity) AS n_entities, regexp_extract_all(lower(alias), '[a-z0-9]+|[^a-z0-9]') AS p FROM names GROUP BY alias),
cut AS (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9]') AS p FROM documents)),
led AS (SELECT *, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
held AS (SELECT doc_id, alias, n_entities, i AS s, i + len(p) AS e FROM led JOIN pieces ON x = p[1] WHERE len(p) = 1 OR (len(p) = 3 AND y = p[2] AND z = p[3])),
mentions AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, alias ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM held) WHERE reached IS NULL OR e > reached)"""


@query("n01_entity_mentions", f"WITH {MENTIONS} SELECT doc_id AS text_id, alias, count(*) AS n FROM mentions GROUP BY ALL")
def n01(t):
    return N.entity_mentions(t.documents.select(F.col("doc_id").alias("text_id"), "text"), aliases(t)).groupBy("text_id", "alias").agg(F.count("*").alias("n"))


@query("n02_resolve_exact", "SELECT c_custkey AS name_id, 'n' || c_nationkey AS ids, 1 AS n FROM customer")
def n02(t):
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("name_id"), F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    return N.resolve_exact(names, t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("alias"))).select("name_id", F.array_join("entity_ids", ",").alias("ids"), "n")


@query("n03_company_hints", f"""WITH {MENTIONS}, w AS (SELECT doc_id, max(n_entities) AS widest FROM mentions GROUP BY 1)
SELECT d.doc_id AS question_id, CASE WHEN coalesce(w.widest, p.widest) > 1 THEN 'ambiguous' WHEN coalesce(w.widest, p.widest) = 1 THEN 'resolved' WHEN d.doc_id % 2 = 0 THEN 'unregistered' ELSE 'none' END AS status
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN w p ON p.doc_id = d.doc_id - d.doc_id % 10""")
def n03(t):
    """Documents as questions; those of ten inherit from the first, and even ones give names."""
    given = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("somebody"))).otherwise(F.array().cast("array<string>"))
    q = t.documents.select(F.col("doc_id").alias("question_id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"), given.alias("given_names"))
    return N.company_hints(q, N.entity_mentions(t.documents.select(F.col("doc_id").alias("text_id"), "text"), aliases(t))).select("question_id", "status")


def faulty_registry(t):
    """Suppliers as registry records that break every rule: doubled ids, strange kinds, no, blank and bare-number aliases."""
    k = F.col("s_suppkey")
    names = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("s_name"), F.when(k % 3 == 0, " ").otherwise("x"), F.when(k % 2 == 0, k.cast("string")).otherwise("y")))
    rows = t.supplier.select(F.concat(F.lit("s"), (k - F.when(k % 10 == 1, 1).otherwise(0)).cast("string")).alias("entity_id"), F.when(k % 7 == 0, "planet").otherwise("company").alias("kind"), names.alias("aliases"))
    return rows.unionByName(registry(t))


@query("n04_registry_check", """WITH r AS (SELECT 's' || (s_suppkey - CASE WHEN s_suppkey % 10 = 1 THEN 1 ELSE 0 END) AS entity_id, s_suppkey AS k FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n FROM r)
SELECT entity_id, 'repeated_id' AS problem FROM c WHERE n > 1 UNION ALL SELECT entity_id, 'unknown_kind' FROM c WHERE k % 7 = 0 UNION ALL SELECT entity_id, 'no_alias' FROM c WHERE k % 5 = 0
UNION ALL SELECT entity_id, 'empty_alias' FROM c WHERE k % 5 <> 0 AND k % 3 = 0 UNION ALL SELECT entity_id, 'bare_number' FROM c WHERE k % 5 <> 0 AND k % 2 = 0 UNION ALL SELECT 'n' || n_nationkey, 'bare_number' FROM nation""")
def n04(t):
    return N.registry_check(faulty_registry(t))


@query("n05_hierarchy_path", "SELECT 'n' || n_nationkey AS id, n_name || ' < ' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def n05(t):
    tree = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")))
    return N.hierarchy_path(tree).select("id", F.array_join("path", " < ").alias("path"))


@query("n06_code_lookup", "SELECT s_suppkey, s_nationkey AS code, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def n06(t):
    codes = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("code"), F.lit(None).cast("string").alias("name")).filter("code is not null")
    other = t.supplier.filter("s_suppkey % 2 = 1").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit(None).cast(codes.schema["code"].dataType).alias("code"), F.col("n_name").alias("name"))
    return N.code_lookup(codes.unionByName(other), t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))).select("s_suppkey", "code", "name")


@query("n07_match_school", "SELECT s_suppkey AS name_id, s_nationkey AS school_id FROM supplier")
def n07(t):
    schools = t.nation.select(F.col("n_nationkey").alias("school_id"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name_cn"), F.concat(F.lit("U "), "n_name").alias("name_en"), F.concat(F.lit("x"), "n_nationkey", F.lit("+y"), "n_nationkey").alias("alias"))
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("name_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("u. "), F.lower("n_name"))).otherwise(F.concat(F.lit("Y "), "n_nationkey")).alias("name"))
    return N.match_school(names, schools).select("name_id", "school_id")


@query("n08_company_tags", "SELECT s_suppkey AS name_id, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE '' END AS tags FROM supplier")
def n08(t):
    names = t.supplier.select(F.col("s_suppkey").alias("name_id"), F.concat("s_name", F.lit(" (Europe) Ltd.")).alias("name"))
    lists = t.supplier.filter("s_suppkey % 2 = 0").select(F.lit("even").alias("tag"), F.col("s_name").alias("entry"))
    return N.company_tags(names, lists).select("name_id", F.array_join("tags", ",").alias("tags"))


@query("n09_flatten_profiles", "SELECT c_custkey, c_name AS name, c_custkey::VARCHAR AS phone, 'yes' AS married, NULL::VARCHAR AS email, '1980-05-01' AS birth, c_mktsegment AS company, 'dev' AS position, '2001-02-01' AS first_start, 1 AS n_jobs, 1 AS n_schools FROM customer")
def n09(t):
    json = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.lit("").alias("phone"), F.col("c_custkey").cast("string").alias("tel"), F.lit("1980年5月").alias("birth"), F.lit("Y").alias("married")).alias("basic"), F.create_map(F.lit("e"), F.struct(F.lit("U").alias("school"), F.lit("master").alias("degree"), F.lit("2000").alias("end"))).alias("education"), F.create_map(F.lit("a"), F.struct(F.col("c_mktsegment").alias("company"), F.lit("dev").alias("position"), F.lit("2001-02").alias("start"), F.lit("至今").alias("end"))).alias("work")))
    flat = N.flatten_profiles(t.customer.select("c_custkey", json.alias("json")))
    return flat.withColumn("birth", F.col("birth").cast("string")).withColumn("first_start", F.col("first_start").cast("string"))


@query("n10_partial_date", "SELECT o_orderkey, make_date(year(o_orderdate), CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE month(o_orderdate) END, 1)::VARCHAR AS d FROM orders")
def n10(t):
    loose = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.year("o_orderdate").cast("string"), F.lit("年13月"))).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("/"), F.month("o_orderdate").cast("string")))
    return t.orders.select("o_orderkey", N.partial_date(loose).cast("string").alias("d"))


@query("n11_education_features", """WITH s AS (SELECT o_custkey AS person, o_orderkey % 5 AS level, o_orderkey % 150 AS r, o_orderdate::DATE AS s, o_orderdate::DATE + 900 AS e FROM orders),
a AS (SELECT person, max_by(level, (level, e)) AS hi, min_by(level, (level, s)) AS lo, min(r) AS best_rank, max(year(e)) AS end_year FROM s GROUP BY 1)
SELECT person, ['other', 'associate', 'bachelor', 'master', 'doctor'][hi + 1] AS highest, ['other', 'associate', 'bachelor', 'master', 'doctor'][lo + 1] AS first, best_rank, end_year,
 CASE WHEN best_rank <= 20 THEN 'top20' WHEN best_rank <= 50 THEN 'top50' WHEN best_rank <= 100 THEN 'top100' ELSE 'ranked' END AS band FROM a""")
def n11(t):
    """Orders as a customer's studies."""
    degree = F.element_at(F.array(*[F.lit(d) for d in N.DEGREES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return N.education_features(t.orders.select(F.col("o_custkey").alias("person"), degree.alias("degree"), (F.col("o_orderkey") % 150).alias("school_rank"), F.col("o_orderdate").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), 900).alias("end")))


@query("n12_work_features", "WITH s AS (SELECT o_custkey AS person, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 1000)::INT AS e, o_totalprice FROM orders) SELECT person, count(*) AS n_jobs, round(avg(e - s), 6) AS mean_days, max_by(e - s, (s, e)) AS latest_days, min(s)::VARCHAR AS first_start FROM s GROUP BY 1")
def n12(t):
    start = F.col("o_orderdate").cast("date")
    spans = t.orders.select(F.col("o_custkey").alias("person"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 1000).cast("int")).alias("end"), F.col("o_totalprice").alias("scale"))
    return N.work_features(spans).select("person", "n_jobs", "mean_days", "latest_days", F.col("first_start").cast("string").alias("first_start"))


@query("n13_completeness_score", "SELECT c_custkey, round((3 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) / 4 * CASE WHEN c_custkey % 3 = 0 THEN 0.8 ELSE 1 END::DOUBLE * CASE WHEN c_custkey % 5 = 0 THEN 0.7 ELSE 1 END, 6) AS completeness FROM customer")
def n13(t):
    df = t.customer.withColumn("extra", F.when(F.col("c_custkey") % 2 == 0, "x"))
    yes = F.lit(True)
    return N.completeness_score(df, ["c_name", "c_mktsegment", "c_nationkey", "extra"], F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 5 != 0, yes, yes).select("c_custkey", "completeness")


@query("n14_clean_contact_fields", "SELECT s_suppkey, '+49' || s_suppkey AS phone, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS keywords FROM supplier")
def n14(t):
    df = t.supplier.select("s_suppkey", F.concat(F.lit("+(49) "), "s_suppkey", F.lit("-")).alias("phone"), F.when(F.col("s_suppkey") % 2 == 0, " a; b ,a").otherwise("a").alias("keywords"))
    return N.clean_contact_fields(df).select("s_suppkey", "phone", F.array_join("keywords", ",").alias("keywords"))
