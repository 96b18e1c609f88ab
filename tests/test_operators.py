"""Operators on literal fixtures whose results are worked out by hand."""

from __future__ import annotations

import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sievelight.functions import hooks, preserve
from sievelight.functions import text as T
from sievelight.operators import corpus as D
from sievelight.operators import entities as N
from sievelight.operators import evaluation as V
from sievelight.operators import evidence as E
from sievelight.operators import search as R
from sievelight.operators import tables as B
from sievelight.operators import terms as W
from sievelight.operators.constraints import constraint_compatibility
from sievelight.plans import hybrid
from sievelight.sources.versions import ChunkTable
from sievelight.sources import chunks as S
from sievelight.streaming import jobs as X


def one(spark, column, *values):
    """The column's value for a row whose columns a, b… are ``values``."""
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns exist only in a session."""
    globals().update(A=F.col("a"), B_=F.col("b"))


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (lambda: T.normalize_text(A), "Ａb-１ 中!", "ab1中"),
        (lambda: T.normalize_document_name(A), "C:\\Dir/Report.PDF", "report.pdf"),
        (lambda: T.clean_question(A), "What is the Price of oil?", " the price oil"),
        (lambda: T.tokenize(A), "Ab_1, c!", ["ab_1", "c"]),
        (lambda: T.mixed_terms(A), "ab 国电电力 ab", ["ab", "国电", "电电", "电力"]),
        (lambda: T.merge_short_tokens(F.split(A, " ")), "x y z long", ["x y z", "long"]),
        (lambda: T.squeeze_spaces(A), "中 国 ab cd", "中国 ab cd"),
        (lambda: T.citation_ids(A), "a ##2$$ b ##10$$", [2, 10]),
        (lambda: T.truncate_middle(A, 10, "..") , "abcdefghijklmnop", "abcde..nop"),
        (lambda: T.token_count(A), "中国 ab, c", 5),
        (lambda: T.session_title(A), "  a \n b ", "a b"),
        (lambda: T.session_title(A), "  ", "新会话"),
        (lambda: T.highlight(A, F.array(F.lit("oil"))), "No. Oil is up. End.", "<em>Oil</em> is up."),
        (lambda: T.strip_provider_refs(A), "x[ref_12]y", "xy"),
        (lambda: T.time_scopes(A), "2025年第二季度", ["2025-Q2"]),
        (lambda: T.time_scopes(A), "25Q2", ["2025-Q2"]),
        (lambda: T.time_scopes(A), "2025年上半年", ["2025-H1"]),
        (lambda: T.time_scopes(A), "2025E", ["2025-FY"]),
        (lambda: T.time_scopes(A), "第二季度收入", ["ANY-Q2"]),
        (lambda: T.time_scopes(A), "2024年收入", ["2024-YEAR"]),
        (lambda: T.time_scopes(A), "2024年6月", ["2024-M06"]),
        (lambda: T.reporting_periods(A), "2025年上半年和第三季度", ["2025上半年", "2025第三季度"]),
        (lambda: T.fact_statuses(A), "预计2025年", ["forecast"]),
        (lambda: T.measurement_dimensions(A), "净利率 5%", ["rate"]),
        (lambda: T.normalize_cell(A), "P/E", "field:pe"),
        (lambda: T.normalize_cell(A), "市盈率（PE）25E", "field:pe:25e"),
        (lambda: T.normalize_cell(A), "(23,181)", "number:-23181"),
        (lambda: T.canonical_text(A), "2025 年 Q2，本公司", "2025第二季度该公司"),
    ],
)
def test_text(spark, column, value, want):
    assert one(spark, column(), value) == want


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [("P/E", "市盈率", True), ("0.40", "0.40元", True), ("(23181)", "-23181", True), ("1亿元", "100百万元", True), ("5%", "5倍", False), ("PE", "PB", False), ("1,000", "1000", True), ("abc", "ABC", True)],
)
def test_cells_equal(spark, a, b, equal):
    assert one(spark, T.cells_equal(A, B_), a, b) is equal


def test_trigram_coverage_and_subject(spark):
    assert one(spark, T.trigram_coverage(A, B_), "abc", "xxabcxx") == 1.0
    assert one(spark, T.trigram_coverage(A, B_), "abcdef", "abc") == 0.5
    assert one(spark, T.trigram_coverage(A, B_), "abcdx", "abcdy") == pytest.approx(2 / 3)
    assert one(spark, T.common_subject(A, B_), "新能源装机容量", "光伏装机容量") == "装机容量"


def test_answer_claims(spark):
    got = one(spark, T.answer_claims(A), "First fact。##1$$ ##3$$ Second! \n - \nthird")
    assert [(c["claim_index"], c["text"], c["citation_ids"]) for c in got] == [(1, "First fact  。", [1, 3]), (2, "Second!", []), (3, "third", [])]


def test_preservation(spark):
    got = one(spark, preserve.rewrite_check(A, B_), "2025年装机容量不低于100万元", "2025年装机容量不低于100万元")
    assert got["valid"] and not got["missing_anchors"]
    got = one(spark, preserve.rewrite_check(A, B_), "2025年收入不低于100万元", "2024年收入低于100万元")
    assert not got["valid"] and "comparison_operator_changed" in got["conflicts"] and any("2024" in x for x in got["added_risky_terms"])
    assert one(spark, preserve.organizations(A), "请问国电电力的收入") == ["国电电力"]
    assert one(spark, preserve.organizations(A, ["国电", "国电电力"]), "国电电力和国电") == ["国电电力", "国电"]


@pytest.mark.parametrize(
    ("query", "candidate", "name", "want"),
    [
        ("2025年第二季度收入", "25Q2收入", "time", "compatible"),
        ("2025年第二季度收入", "2025年上半年收入", "time", "conflict"),
        ("2025年收入", "2025年第二季度收入", "time", "compatible"),
        ("2025年第二季度收入", "2025年收入情况", "time", "unknown"),
        ("国电电力的利率", "该行利率5%", "entity", "unknown"),
        ("2025年收入", "2024年收入", "time", "conflict"),
        ("实际收入", "预计收入", "status", "conflict"),
        ("表1收入", "图3收入", "locator", "conflict"),
        ("利率", "10万元", "dimension", "conflict"),
        ("收入", "2024年收入", "time", "unknown"),
    ],
)
def test_constraints(spark, query, candidate, name, want):
    row = constraint_compatibility(spark.createDataFrame([(query, candidate)], "query string, candidate string")).first()
    assert row[name] == want


def test_rrf(spark):
    rows = [("q", "s1", "a", 2), ("q", "s2", "a", 1), ("q", "s3", "a", 2), ("q", "s1", "b", 1), ("q", "s1", "b", 3), ("q", "s4", "z", 1)]
    weights = [("q", s, w) for s, w in (("s1", 1.0), ("s2", 1.0), ("s3", 1.0), ("s4", 0.0))]
    got = R.rrf(spark.createDataFrame(rows, "query_id string, branch string, chunk_id string, rank int"), spark.createDataFrame(weights, "query_id string, branch string, weight double")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 62) and got[1]["score"] == pytest.approx(1 / 61)


def test_redistribution(spark):
    weights = spark.createDataFrame([(1, "vector_original", "vector", 0.6), (1, "keyword_original", "keyword", 0.2), (1, "keyword_expanded", "keyword", 0.2)], "query_id int, branch string, family string, weight double")
    share = lambda hits: {r["branch"]: round(r["weight"], 6) for r in R.redistribute_weights(weights, spark.createDataFrame([(1, h) for h in hits], "query_id int, branch string")).collect()}
    assert share(["vector_original", "keyword_original"]) == {"vector_original": 0.6, "keyword_original": 0.4, "keyword_expanded": 0.0}
    assert share(["keyword_original", "keyword_expanded"]) == {"vector_original": 0.0, "keyword_original": 0.5, "keyword_expanded": 0.5}
    assert share([]) == {"vector_original": 0.6, "keyword_original": 0.2, "keyword_expanded": 0.2}


def test_limit_identities_stops_at_the_last_new_one(spark):
    ranked = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("ABABCADC")], "query_id int, rank int, identity string")
    assert [r["rank"] for r in R.limit_identities(ranked, 3).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert [r["rank"] for r in R.limit_identities(ranked, 2, 2).orderBy("rank").collect()] == [5, 7]
    assert R.limit_identities(ranked, 9).count() == 8 and [r["rank"] for r in R.limit_identities(ranked, 9, 2).orderBy("rank").collect()] == [5, 7, 8]


def test_conflicts_rank_last(spark):
    rows = [("q", "a", 1, 0.9, 0.9, 1), ("q", "b", 3, 0.1, 0.2, 0), ("q", "c", 2, 0.2, None, 0)]
    got = R.final_rank(spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double, semantic double, conflicts int")).orderBy("final_rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "c", "a"]


def test_filters_keep_null_availability(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "chunk_id int, available_int int")
    assert [r["chunk_id"] for r in R.apply_filters(df, available=1).collect()] == [1, 3]
    assert [r["chunk_id"] for r in R.apply_filters(df, available=0).collect()] == [2]


def test_knn_blocks_agree_with_broadcast(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "chunk_id long, embedding array<float>")
    q = v.filter("chunk_id < 5").selectExpr("chunk_id AS query_id", "embedding AS qvec")
    small = sorted(map(tuple, R.knn(q, v, 7).collect()))
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 1)
    assert sorted(map(tuple, R.knn(q, v, 7).collect())) == small


def test_hybrid_search_uses_every_part(spark):
    """Filters, expansion, relaxation, identities and conflicts each change the page."""
    texts = {
        1: "solar output report for the plant", 2: "solar output report for the plant", 3: "photovoltaic yield", 4: "solar output report for the plant", 5: "wind turbine manual",
        6: "solar output report for the plant", 7: "hidden solar output report for the plant",
    }
    years = {1: "2023年", 2: "2022年", 3: "2022年", 4: "2021年", 5: "2022年", 6: "2021年", 7: "2022年"}
    rows = [(i, i, "kb2" if i == 5 else "kb1", 0 if i == 7 else 1, f"doc {years[i]}", v, "t" if i in (4, 6) else None) for i, v in texts.items()]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, kb_id string, available_int int, document_name string, content string, identity string").withColumn("tokens", T.tokenize(F.col("content")))
    q = spark.createDataFrame([(1, "solar output report plant overview 2022年"), (2, "wind turbine manual reader guide 2022年"), (3, "plant 光伏 风电 煤电 核电 水电 储能 碳价")], "query_id long, text string").withColumn("qvec", F.lit(None).cast("array<float>"))
    page = lambda options, **more: {(r["query_id"], r["chunk_id"]): r for r in hybrid.search(q, chunks, None, options, **more).collect()}
    plain = page(hybrid.Options(available=1))
    assert (1, 7) not in plain
    # The chunk of the year asked for comes first although all have the same words, those of other years conflict.
    assert plain[1, 2]["final_rank"] == 1 and plain[1, 2]["conflicts"] == 0 and plain[1, 1]["conflicts"] == 1
    other = page(hybrid.Options(kb_ids=("kb1",), relaxed_match=0.3))
    assert (2, 5) in plain and (2, 5) not in other and (1, 7) in other
    # Eight groups ask for two matches; none has them, so one is enough.
    assert (3, 1) in plain and (3, 1) not in other
    assert (1, 3) not in plain
    aliases = spark.createDataFrame([("solar", "photovoltaic", 1, None)], "canonical string, alias string, ord int, narrower string")
    wider = page(hybrid.Options(available=1), aliases=aliases)
    assert set(wider[1, 3]["branch_scores"]) == {"keyword_expanded"}
    # Two rows of one table take one place: the second page of two begins with it.
    assert {c for i, c in plain if i == 1} == {1, 2, 4, 6}
    assert {c for i, c in page(hybrid.Options(available=1, page_size=2, page=2)) if i == 1} == {4, 6}


def test_hybrid_options_are_checked():
    with pytest.raises(ValueError):
        hybrid.Options(vector_weight=2)
    with pytest.raises(ValueError):
        hybrid.Options(page_size=0)


def test_budgets(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}", s) for i, s in enumerate((5, 9, 3, 2, 1))], "question_id int, pos int, evidence_id string, size int")
    got = E.budget_select(rows, 10).first()
    assert got["chosen"] == ["e0", "e2", "e3"] and got["omitted"] == ["e1", "e4"]
    goals = spark.createDataFrame([(1, 0, "oil price"), (1, 1, "gas price")], "question_id int, goal_no int, text string")
    evidence = spark.createDataFrame([(1, "e1", 0, "oil price up"), (1, "e2", 1, "gas price up"), (1, "e3", 2, "weather")], "question_id int, evidence_id string, ord int, text string")
    assert [r["evidence_id"] for r in E.goal_round_robin(goals, evidence).orderBy("pos").collect()] == ["e1", "e2", "e3"]


def test_goal_takes_its_best_free_item(spark):
    """Orders ABCD and ACBD: the second goal's first choice is gone, so it takes C and not the item of its second turn."""
    goals = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a c x_1"), (2, 0, "none")], "question_id int, goal_no int, text string")
    texts = {"A": "a b c d", "B": "b c d", "C": "a c d", "D": "d"}
    rows = [(1, k, i, v) for i, (k, v) in enumerate(texts.items())] + [(2, "Z", 0, "q"), (3, "N", 1, "later"), (3, "M", 0, "first")]
    evidence = spark.createDataFrame(rows, "question_id int, evidence_id string, ord int, text string")
    got = {}
    for r in E.goal_round_robin(goals, evidence).orderBy("question_id", "pos").collect():
        got.setdefault(r["question_id"], []).append(r["evidence_id"])
    assert got == {1: ["A", "C", "B", "D"], 2: ["Z"], 3: ["M", "N"]}


def test_requirements_and_metrics(spark):
    atoms = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)], "id int, req int, alt int, atom int")
    matches = spark.createDataFrame([(1, 0, 1, 0, 4, 0.9), (1, 0, 1, 1, 2, 0.85), (1, 1, 0, 0, 1, 0.8), (1, 0, 0, 0, 3, 0.5)], "id int, req int, alt int, atom int, rank int, score double")
    got = {r["req"]: r for r in V.evaluate_requirements(atoms, matches).collect()}
    assert (got[0]["matched"], got[0]["matched_rank"], got[0]["alternative"], got[1]["matched_rank"]) == (True, 4, 1, 1)
    samples = spark.createDataFrame([(1, True), (2, False)], "id int, answerable boolean")
    m = {(r["id"], r["k"]): r for r in V.retrieval_metrics(samples, atoms, matches, [3, 5]).collect()}
    assert m[1, 3]["hit"] is False and m[1, 3]["recall"] == 0.5 and m[1, 3]["mrr"] == 0
    assert m[1, 5]["hit"] is True and m[1, 5]["mrr"] == 0.25 and m[1, 5]["precision"] == 0.6
    assert m[2, 5]["hit"] is None and m[2, 5]["precision"] is None


def test_three_valued_folds_and_latency(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, True), (3, False), (3, None), (4, None)], "k int, v boolean")
    got = {r["k"]: (r["a"], r["b"]) for r in df.groupBy("k").agg(V.all3(F.col("v")).alias("a"), V.any3(F.col("v")).alias("b")).collect()}
    assert got == {1: (None, True), 2: (True, True), 3: (False, None), 4: (None, None)}
    row = V.latency_summary(spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 4.0), (None, -1.0), ("x", 9.0)], "error string, latency_ms double")).first()
    assert (row["n"], row["p50"], row["p95"], row["p99"]) == (3, 2.0, 3.8, 3.96)


def test_sample_rules(spark):
    atom = lambda kind: [(("a"), kind, "d", "t", None)]
    rows = [("s1", "q", True, [("r1", [atom("text")])], [("c", "t", ["r1"])]), ("s1", "q", True, [], []), ("s2", " ", False, [("r1", [[], atom("video")])], [("c", "t", ["r9"])])]
    df = spark.createDataFrame(rows, f"id string, question string, answerable boolean, requirements {V.REQUIREMENTS}, claims array<struct<id:string,text:string,required_evidence_ids:array<string>>>")
    got = {(r["id"], r["rule"]) for r in V.validate_samples(df).collect()}
    assert {("s1", "duplicate_id"), ("s1", "answerable_without_requirement"), ("s2", "missing_question"), ("s2", "unanswerable_with_requirement"), ("s2", "empty_alternative"), ("s2", "unknown_type"), ("s2", "dangling_evidence")} == got


HTML = """<table><caption>Cap</caption><tr><th rowspan=2>项目</th><th colspan=2>2024</th></tr><tr><th>Q1</th><th>Q2</th></tr>
<tr><td colspan=3>Section</td></tr><tr><td>收入</td><td>10</td><td>20</td></tr><tr><td>同比</td><td>5%</td><td>6%</td></tr></table>"""


def test_tables(spark):
    bad = "<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>"
    wide = '<table><tr><td colspan="999">x</td></tr></table>'
    pair = "<table><tr><th>甲</th><th>1</th></tr><tr><td>乙</td><td>2</td></tr></table>"
    overlap = '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td rowspan="2">c</td></tr></table>'
    df = spark.createDataFrame([(1, HTML), (2, bad), (3, wide), (4, pair), (5, None), (6, overlap)], "table_id long, html string")
    grid = B.html_table_grid(df)
    assert {r["table_id"] for r in grid.select("table_id").distinct().collect()} == {1, 4}
    rows = B.bind_table_rows(grid).orderBy("row_index").collect()
    assert [(r["context"], r["preamble"], r["headers"], r["cells"]) for r in rows] == [
        ("Section", "", ["项目", "2024 / Q1", "2024 / Q2"], ["收入", "10", "20"]),
        ("Section", "上一数据行指标：收入", ["项目", "2024 / Q1", "2024 / Q2"], ["同比", "5%", "6%"]),
    ]
    chunk = B.table_row_chunks(B.bind_table_rows(grid)).orderBy("row_index").first()["semantic_text"]
    assert chunk == "Cap；Section\n项目：收入；2024 / Q1：10；2024 / Q2：20"


def test_chunks_overshoot_by_one_segment(spark):
    df = spark.createDataFrame([(1, "a b c! d e f! g h i! j"), (2, ""), (3, None)], "doc_id int, text string")
    got = [r["content"] for r in D.chunk_by_budget(df, 4).orderBy("doc_id", "seq").collect()]
    assert got == ["a b c! d e f", "! g h i", "! j"] or "".join(got) == "a b c! d e f! g h i! j"


def test_html_and_json_sections(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><p>One &amp; two<br>three</p><script>x()</script></article><footer>f</footer></body></html>"
    assert [r["text"] for r in D.html_sections(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("pos").collect()] == ["T", "One & two", "three"]
    raw = json.dumps({"a": {"b": [1, 2]}, "c": "x" * 300, "d": 1})
    got = [r["section"] for r in D.json_sections(spark.createDataFrame([(1, raw)], "doc_id int, json string"), size=60).orderBy("pos").collect()]
    assert "".join(got).splitlines()[:2] == ["/a/b/0=1", "/a/b/1=2"] and len(got) >= 2


def test_mentions_and_dates(spark):
    reg = spark.createDataFrame([("n1", "Acme"), ("n2", "Acme Power"), ("n3", "Acme"), ("n4", "国电"), ("n5", "国电电力")], "entity_id string, alias string")
    got = N.entity_mentions(spark.createDataFrame([(1, "Acme Power and Acme, not Acmes; 国电电力")], "text_id int, text string"), reg).orderBy("start").collect()
    assert [(r["alias"], r["start"], r["entity_ids"]) for r in got] == [("Acme Power", 0, ["n2"]), ("Acme", 15, ["n1", "n3"]), ("国电电力", 32, ["n5"])]
    dates = {v: one(spark, N.partial_date(A), v) for v in ("2020年13月", "2001-02-03", "1609459200", "至今")}
    assert dates == {"2020年13月": datetime.date(2020, 1, 1), "2001-02-03": datetime.date(2001, 2, 3), "1609459200": datetime.date(2021, 1, 1), "至今": None}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "# x"), ("b.exe", "z"), ("c.TXT", "y")):
        (tmp_path / "in" / name).write_text(text)
    docs, rejects = S.read_corpus(spark, str(tmp_path / "in"))
    assert sorted(r["format"] for r in docs.collect()) == ["md", "txt"] and rejects.count() == 1
    lines = [{"id": "1", "question": "q", "answerable": True}, {"id": "2", "question": "q", "answerable": True}, {"id": "2", "question": "r", "answerable": True}, {"id": "3"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    good, problems = S.read_samples(spark, str(tmp_path / "s.jsonl"))
    assert [r["id"] for r in good.collect()] == ["1"]
    assert sorted(r["problem"] for r in problems.collect()) == ["broken line", "missing field", "repeated id", "repeated id"]
    with pytest.raises(ValueError):
        S.select_samples(good, ids=["9"])
    S.write_chunks(spark.createDataFrame([("k", 1), ("l", 2)], "kb_id string, chunk_id int"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).filter("kb_id = 'k'").count() == 1
    S.write_eval_run(good, problems, str(tmp_path / "run"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_eval_run(good, problems, str(tmp_path / "run"))


def test_delta_stream(spark, tmp_path):
    """Streams end once, whatever the order and repeats of their deltas, and leave no state."""
    schema = "stream_id string, seq int, text string, finish boolean"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    batches = [
        [("s", 1, "b", False), ("s", 0, "a", False), ("s", 1, "b", False), ("t", 0, "x", True), ("u", 2, "z", True), ("idle", 0, "part", False)],
        [("s", 2, "c", True), ("t", 5, "late", False), ("u", 0, "y", False), ("s", 2, "c", True)],
        [("u", 1, None, False), ("s", 3, "late", False)],
    ]
    query = X.fold_delta_stream(source, idle=12, grace=2).writeStream.outputMode("append").format("memory").queryName("folded").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        until, state = time.time() + 90, lambda: (query.lastProgress or {}).get("stateOperators") or [{"numRowsTotal": 1}]
        while time.time() < until and (spark.table("folded").count() < 4 or state()[0]["numRowsTotal"] > 0):
            assert query.exception() is None
            time.sleep(1)
        left = state()[0]["numRowsTotal"]
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("folded").collect())) == [("idle", "part", 1, False), ("s", "abc", 3, True), ("t", "x", 1, True), ("u", "yz", 3, True)]
    assert left == 0


def test_incremental_ingest(spark, tmp_path):
    """A new version replaces the old one, one without chunks removes it, and a batch that runs again changes nothing."""
    schema = "doc_id int, text string"
    spark.createDataFrame([(1, "a! b"), (2, "c"), (3, "d")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    chunk = lambda df: D.chunk_by_budget(df, 1)
    for _ in range(2):
        X.incremental_ingest(stream, chunk, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(1, "new"), (3, "  ")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    table = ChunkTable(spark, str(tmp_path / "out"))
    live = lambda: sorted((r["doc_id"], r["content"]) for r in table.read().collect())
    assert live() == [(1, "new"), (2, "c")]
    table.replace(spark.createDataFrame([(2, "again")], "doc_id int, content string"), batch=1)
    assert live() == [(1, "new"), (2, "c")]


def test_chunk_table(spark, tmp_path, monkeypatch):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, content string")
    table = ChunkTable(spark, str(tmp_path / "t"))
    live = lambda v=None: sorted((r["doc_id"], r["content"]) for r in table.read(v).collect())
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(make((1, "a"), (1, "b"), (2, "c"), (None, "n")).filter("doc_id is not null"))
    before = table.read()
    # A change that dies before its commit leaves the old state.
    with monkeypatch.context() as m:
        m.setattr(ChunkTable, "_commit_as", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.replace(make((1, "x")))
    assert live() == [(1, "a"), (1, "b"), (2, "c")]
    table.replace(make((1, "x")))
    assert live() == [(1, "x"), (2, "c")] and live(0) == [(1, "a"), (1, "b"), (2, "c")]
    assert sorted(r["content"] for r in before.collect()) == ["a", "b", "c"]  # an open reader keeps its version whole
    table.delete(make((2, None)))
    assert live() == [(1, "x")]
    assert table.compact() == 3 and live() == [(1, "x")] and len(table.commits()) == 1
    # Of two writers of one version the later one fails.
    with monkeypatch.context() as m:
        m.setattr(ChunkTable, "commits", lambda self: [{"version": 2, "batch": None}])
        with pytest.raises(Exception, match="exists"):
            table.replace(make((9, "z")))
    table.replace(make((5, "e")))
    assert live() == [(1, "x"), (5, "e")]
    table.delete(make((1, None), (5, None)))
    assert live() == []


def test_session_state_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    spark.createDataFrame([("s", at(1), "old"), ("s", at(1).replace(minute=30), "new")], "session_id string, ts timestamp, name string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, ts timestamp, name string").parquet(str(tmp_path / "in"))
    query = X.session_doc_state(stream).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT name FROM sessions").first()["name"] == "new"


def test_hooks(spark):
    claims = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "case_id long, claim_index int, text string")
    judged = hooks.judge_with(claims, lambda p: p.assign(requires=True, supported=p["text"] == "x", citation_ids=[[1]] * len(p))[["case_id", "claim_index", "requires", "supported", "citation_ids"]])
    assert sorted((r["claim_index"], r["supported"]) for r in judged.collect()) == [(1, True), (2, False)]
    evidence = spark.createDataFrame([(1, "s", 5, "Acme leads"), (1, "s", 6, "none")], "task_id long, slot string, chunk_id long, content string")
    bound = hooks.bind_with(evidence, lambda p: p[p["content"].str.contains("Acme")].assign(value="Acme", quote="Acme leads")[["task_id", "slot", "chunk_id", "value", "quote"]])
    assert R.validate_bindings(bound.withColumn("binding_id", F.lit(1)), evidence).first()["valid"]


def test_mentions_in_long_registry(spark):
    """Aliases in words, in other scripts and with signs, covered ones left out, places by characters."""
    from sievelight.operators import entities as N

    texts = spark.createDataFrame([(1, "The C++ guild and the guild; 国电电力公司 and other"), (2, None), (3, "")], "text_id long, text string")
    registry = spark.createDataFrame([("e1", "guild"), ("e2", "the guild"), ("e3", "国电电力"), ("e4", "电力"), ("e5", "C++"), ("e6", "the"), ("e7", "")], "entity_id string, alias string")
    got = [(r["alias"], r["start"], r["end"]) for r in N.entity_mentions(texts, registry).orderBy("start").collect()]
    assert got == [("the", 0, 3), ("C++", 4, 7), ("guild", 8, 13), ("the guild", 18, 27), ("国电电力", 29, 33)]


def test_hierarchy_with_a_cycle_and_a_long_chain(spark):
    from sievelight.operators import entities as N

    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(20)] + [(100, 101, "a"), (101, 100, "b")]
    got = {r["id"]: r["path"] for r in N.hierarchy_path(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert got[19] == [f"n{i}" for i in range(19, -1, -1)] and got[0] == ["n0"]
    assert got[100] == ["a", "b"] and got[101] == ["b", "a"]


def test_knn_of_blocks(spark):
    from sievelight.operators import search as R

    vectors = spark.createDataFrame([(i, [1.0, i / 50.0]) for i in range(50)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<double>")
    got = [r["chunk_id"] for r in R.knn(queries, vectors, 5).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_summary_keeps_cases_without_a_type(spark):
    from sievelight.catalog.evaluation import CASES
    from sievelight.operators import evaluation as V

    orders = spark.createDataFrame([(i, i, None if i % 2 else "x", "F", 5000.0) for i in range(1, 9)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    got = {r["question_type"] for r in V.e2e_summary(orders.selectExpr(*[f"{e} AS {n}" for n, e in CASES.items()])).collect()}
    assert got == {"overall", "x", None}


def test_session_expires_after_its_last_write(spark, tmp_path):
    """A later write prolongs the state; once the watermark is a time to live behind it, the session is gone."""
    schema = "session_id string, ts timestamp, name string"
    files = [[("a", "2025-01-01 10:00:00", "old")], [("a", "2025-01-01 11:30:00", "new")], [("b", "2025-01-01 12:40:00", "x")], [("b", "2025-01-01 14:00:00", "y")], [("b", "2025-01-01 14:01:00", "z")]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "session_id string, ts string, name string").selectExpr("session_id", "CAST(ts AS TIMESTAMP) AS ts", "name").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = X.session_doc_state(stream).writeStream.outputMode("update").format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    rows = [(r["session_id"], r["name"], r["live"]) for r in spark.sql("SELECT * FROM expiring").collect()]
    assert ("a", "old", True) in rows and ("a", "new", True) in rows
    assert [r for r in rows if not r[2]] == [("a", "new", False)]


def test_nested_json_sections(spark):
    from sievelight.operators import corpus as D

    json = '{"a": {"b": {"c": {"d": {"e": [1, {"f": 2}]}}}}, "g": 3}'
    out = "".join(r["section"] for r in D.json_sections(spark.createDataFrame([(1, json)], "doc_id long, json string")).orderBy("pos").collect())
    assert out.splitlines() == ["/a/b/c/d/e/0=1", "/a/b/c/d/e/1/f=2", "/g=3"]


def test_knn_of_odd_vectors_is_that_of_a_fold(spark):
    """Null, zero, not finite, of another length, and many copies: what the built-in cosine gives, ranked alike."""
    from pyspark.sql import Window

    vectors = [[float(i % 7) - 3, float(i % 5), 1.0] for i in range(40)] + [[1.0, 2.0, 3.0]] * 30 + [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 1.0]]
    v = spark.createDataFrame(list(enumerate(vectors)), "chunk_id long, embedding array<double>")
    q = v.filter("chunk_id % 3 = 0 or chunk_id >= 70").selectExpr("chunk_id AS query_id", "embedding AS qvec")
    unit = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    for least, k in ((0.1, 6), (-1.0, 6), (0.1, 1000)):
        dot = F.aggregate(F.zip_with("qvec", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        score = F.when((unit(F.col("qvec")) > 0) & (unit(F.col("embedding")) > 0), dot / (unit(F.col("qvec")) * unit(F.col("embedding")))).otherwise(0.0)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
        plain = q.crossJoin(v).select("query_id", "chunk_id", score.alias("score")).filter(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        shown = lambda rows: sorted((r["query_id"], r["rank"], r["chunk_id"], str(r["score"])) for r in rows)
        assert shown(R.knn(q, v, k, least, block=20).collect()) == shown(plain.collect()), (least, k)


def test_knn_sends_no_row_per_pair(spark):
    """Scores are made and cut inside the task of a block: no join of queries and vectors is in the plan."""
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "chunk_id long, embedding array<double>")
    plan = R.knn(v.selectExpr("chunk_id AS query_id", "embedding AS qvec"), v, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_even_weights_search_nothing(spark):
    from sievelight.catalog import registry, retrieval

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    weights = retrieval.even_weights(t)
    assert "CoGroup" not in weights._jdf.queryExecution().executedPlan().toString()
    asked = {(r["query_id"], r["branch"]) for r in weights.collect()}
    assert {(r["query_id"], r["branch"]) for r in retrieval.rankings(t).select("query_id", "branch").distinct().collect()} <= asked


def test_matched_tags_are_those_of_a_join(spark):
    """Blocks give what a join of all terms gives, with rows of one chunk, repeated tokens, null tags and keys without a match; no pair of key and chunk is a row."""
    from sievelight.operators import terms as W

    rows = [(i % 37, [f"t{(i * k) % 11}" for k in range(1, 7)], ["a", None if i % 5 == 0 else f"x{i % 3}"]) for i in range(60)] + [(99, None, ["a"]), (None, ["t1", "t2"], ["a"])]
    c = spark.createDataFrame(rows, "chunk_id long, tokens array<string>, tags array<string>")
    terms = spark.createDataFrame([(q, f"t{(q + k) % 13}") for q in range(9) for k in range(4)], "q long, term string")
    for least in (1, 3):
        posts = W.postings(c).filter("chunk_id is not null")
        hit = terms.join(posts, "term").groupBy("q", "chunk_id").agg(F.count("*").alias("m")).filter(F.col("m") >= least)
        plain = hit.join(c.select("chunk_id", F.explode("tags").alias("tag")), "chunk_id").groupBy("q", "tag").agg(F.count("*").alias("c"))
        got = W.matched_tags(terms, c, "q", least)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_short_tokens_are_merged_without_copying_what_is_done(spark):
    """As a plain loop does; no fold that copies its result for each token."""
    import random

    def plain(t):
        short = lambda x: (len(x) == 1 or x in ("ab", "07")) and x not in T.STOP_WORDS
        if len(t) > 1 and (len(t[0]) == 1 or t[0] in ("ab", "07")) and len(t[1]) > 1 and not t[1][0].isascii():
            return [f"{t[0]} {t[1]}", *plain_runs(t[2:], short)]
        return plain_runs(t, short)

    def plain_runs(t, short):
        out, run = [], []
        for x in [*t, None]:
            if x is not None and short(x):
                run.append(x)
                continue
            while len(run) > 4:
                out.append(" ".join(run[:2]))
                run = run[2:]
            out += ([" ".join(run)] if run else []) + ([x] if x is not None else [])
            run = []
        return out

    pick = random.Random(5)
    rows = [([pick.choice(["x", "ab", "07", "long", "煤电", "是"]) if pick.random() < 0.8 else "y" for _ in range(n % 23)],) for n in range(200)]
    df = spark.createDataFrame(rows, "t array<string>").select("t", T.merge_short_tokens(F.col("t")).alias("m"))
    assert [r["m"] for r in df.collect()] == [plain(r["t"]) for r in df.collect()]
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_without_chinese_skip_its_patterns(spark):
    plan = spark.range(1).select(preserve.organizations(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert T.CJK_ON in plan or "2e7f" in plan
    assert one(spark, preserve.organizations(A), "plain Latin 电力") == [] and one(spark, preserve.organizations(A), "国电电力") == ["国电电力"]


def test_short_rows_are_spread_whatever_the_splits(spark):
    from sievelight.sources.tables import spread

    cores = spark.sparkContext.defaultParallelism
    many = spark.createDataFrame([(i,) for i in range(400)], "k long").coalesce(1).unionByName(*[spark.createDataFrame([], "k long").repartition(2 * cores)])
    assert max(spread(many).rdd.glom().map(len).collect()) < 400


def test_assessments_are_validated_in_one_pass(spark):
    """All rules, goals asked twice or never assessed, nulls; no join, which held all rows of a task in memory."""
    a = spark.createDataFrame([(1, 1, "supported", True, ["x"]), (2, 1, "supported", True, []), (2, 1, "missing", True, ["x"]), (3, 2, "missing", True, []), (5, None, "supported", True, ["x"])] + [(4, i, "missing", False, []) for i in range(9)], "question_id long, goal_id int, status string, sufficient boolean, supporting_ids array<string>")
    goals = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, None)], "question_id long, goal_id int")
    got = E.validate_assessments(a, goals)
    assert sorted(map(tuple, got.collect())) == [(2, "goal_not_once"), (2, "support_without_source"), (2, "verdict_contradicts_missing"), (3, "goal_not_once"), (3, "verdict_contradicts_missing"), (4, "too_many_missing"), (5, "goal_not_once")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_citations_are_scored_in_one_pass(spark):
    """Claims given twice, judged twice, not judged, and judgments of no claim; no join."""
    claims = spark.createDataFrame([(1, 1, [1]), (1, 2, []), (2, 1, [1]), (3, 1, [1]), (4, 1, [1]), (4, 1, [])], "case_id int, claim_index int, citation_ids array<int>")
    judged = spark.createDataFrame([(1, 1, True, True, [1]), (1, 2, True, False, [1]), (2, 1, True, True, [1]), (2, 1, True, True, [1]), (4, 1, True, True, [1]), (9, 1, True, True, [1])], "case_id int, claim_index int, requires boolean, supported boolean, citation_ids array<int>")
    got = V.citation_scores(claims, judged)
    assert sorted(map(tuple, got.select("case_id", "complete", "completeness", "precision", "recall").collect())) == [(1, True, 0.5, 1.0, 0.5), (2, False, None, None, None), (3, False, None, None, None), (4, True, 0.5, 1.0, 1.0)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_hybrid_similarity_broadcasts_terms_and_query_vectors(spark):
    """Only what a chunk has once is dealt again, its vector: no pair of query and chunk is sorted for a join."""
    from sievelight.catalog import registry

    plan = registry.QUERIES["w08_hybrid_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("InMemoryRelation")[0]


@pytest.mark.parametrize("bound", [0, 1000])
def test_paragraph_weights_stay_with_their_chunk(spark, monkeypatch, bound):
    """As by a join with the statistics of all terms, whether these are broadcast or not; where they are, only tokens are shuffled, by chunk."""
    monkeypatch.setattr(W, "BROADCAST_STATS", bound)
    texts = ["solar power 2024", "solar " * 12 + "grid a", "once " * 11 + "rare rare", "", "2024 42 grid"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string").select("chunk_id", T.tokenize(F.col("text")).alias("tokens"))
    chunks = chunks.unionByName(spark.createDataFrame([(7, ["grid", None, "new"])], "chunk_id long, tokens array<string>"))
    posts, stats = W.postings(chunks), W.term_stats(chunks)
    raw = posts.join(stats, "term").withColumn("raw", W.raw_weight(F.col("term"), F.col("freq"), F.col("df")))
    wanted = {(r["chunk_id"], r["term"]): r["w"] for r in raw.join(raw.groupBy("chunk_id").agg(F.sum(F.col("raw") * F.col("tf")).alias("s")), "chunk_id").select("chunk_id", "term", (F.col("raw") / F.col("s")).alias("w")).collect()}
    weights = W.paragraph_weights(posts, stats)
    got = {(r["chunk_id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in got)
    if bound:
        plan = weights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1


def test_canonical_text_by_all_rules_in_turn(spark):
    """Texts with and without Chinese characters: as by every rule in its order, also where one rule's term makes another's name; few patterns run over all of a text."""
    import random
    import re

    aliases = {"ab": ["eps"], "eps": ["xx", "第一"], "市": ["第"], "dps": ["eps2"]}
    rng = random.Random(5)
    plain = ["2020", "1999", "-", "—", "−", " ", "q1", "q2", "q11", "h1", "h2", "eps", "pe", "P/E", "pb", "dps", "FCFF", "x", "\n", "%", "é"]
    parts = plain + ["年", "季度", "第", "一", "二", "营收", "装机量", "本", "公司", "上年度", "到", "至", "，", "Ｑ", "１", "第一", "今年"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(1, 14))) for p in (plain, parts) for _ in range(1500)] + ["", None]

    def rules(*tables):
        names = {o.lower(): t.lower() for table in tables for t, others in table.items() for o in others}
        named = [(rf"(?<![a-z]){re.escape(o)}(?![a-z])" if o.isascii() else re.escape(o), t) for o, t in sorted(names.items(), key=lambda x: len(x[0]), reverse=True)]
        return [*((p, re.sub(r"\$(\d)", r"\\\1", t)) for p, t in T.SPELLINGS), *named]

    def wanted(text, table):
        out = (text or "").translate(str.maketrans(T.FULL_WIDTH, T.HALF_WIDTH)).lower()
        for pattern, put in rules(table, T.EVERYDAY):
            out = re.sub(pattern, put, out, flags=re.ASCII)
        return "".join(ch for ch in out if ch.isalpha() or ch.isdigit() or ch in "+-%./<>=")

    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for table in (T.ALIASES, aliases):
        got = docs.select("text", T.canonical_text(F.col("text"), table).alias("c")).collect()
        assert [(r["text"], r["c"]) for r in got] == [(t, wanted(t, table)) for t in texts]
    plan = docs.select(T.canonical_text(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("replace(") and plan.count("RLIKE") >= 4


def test_best_bm25_keeps_what_top_matching_of_bm25_does(spark, monkeypatch):
    """Postings looked up in tasks and scores added up in blocks, against plain joins: ties, repeated chunks, two fields, relaxed queries."""
    rng = random.Random(19)
    words = [f"w{i}" for i in range(12)]
    rows = [(i % 150, [rng.choice(words) for _ in range(rng.randrange(9))], [rng.choice(words[:3])]) for i in range(160)] + [(200, None, ["w0"]), (201, [], [])]
    chunks = spark.createDataFrame(rows, "chunk_id long, tokens array<string>, title array<string>")
    asked = [(q, q % 2 == 0, g, rng.choice([*words, "w1 w2", "w3 w3", "w0 w5", "absent"]), 0.5 + rng.randrange(3) / 4) for q in range(6) for g in range(9)] + [(7, False, g, t, 1.0) for g, t in enumerate(["w0 w1", *(f"absent{i}" for i in range(9))])]
    terms = spark.createDataFrame([(((q,), *rest)) for q, *rest in asked], "query_id struct<query_id: int>, latin boolean, grp int, term string, boost double")

    def posts(name):
        return {(r["chunk_id"], r["term"]): r["tf"] for r in W.build_index(chunks, terms.select("term"), name, pairs=True).rows.collect()}

    looked_up = {name: posts(name) for name in ("tokens", "title")}
    monkeypatch.setattr(W, "listed", lambda df: None)
    assert looked_up == {name: posts(name) for name in ("tokens", "title")}
    monkeypatch.undo()
    fields = {name: (W.build_index(chunks, terms.select("term"), name, pairs=True), boost) for name, boost in (("tokens", 2.0), ("title", 10.0))}

    def best(df):
        return sorted((r["query_id"][0], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())

    expected = best(R.top_matching(R.bm25(terms, fields), terms.filter("not latin"), 7, 0.5, 0.1))
    assert best(R.best_bm25(terms, fields, 7, 0.5, 0.1)) == expected and len(expected) > 40
    monkeypatch.setattr(R, "BLOCK_CHUNKS", 20)
    monkeypatch.setattr("sievelight.operators.products.SLICE_CELLS", 50)
    assert best(R.best_bm25(terms, fields, 7, 0.5, 0.1)) == expected == best(R.best_bm25(terms, fields, 7, 0.5, 0.1, rows=3))
