"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.catalog.registry import query
from sievelight.functions import preserve, text as T
from sievelight.sources.tables import spread

FROM, TO = T.FULL_WIDTH, T.HALF_WIDTH.replace("'", "''")
def half(c: str) -> str:
    return f"translate({c}, '{FROM}', '{TO}')"


def norm(c: str) -> str:
    return rf"regexp_replace(lower({half(f'''coalesce({c}, '')''')}), '[^\p{{L}}\p{{N}}]', '', 'g')"


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def picked(key: str, items):
    """One of ``items`` by a table's key, in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col(key) % len(items) + 1).cast("int"))


def picked_sql(key: str, items) -> str:
    shown = ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in items)
    return f"([{shown}])[{key} % {len(items)} + 1]"


@query("t01_normalize_text", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def t01(t):
    return t.documents.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("t02_document_name", f"SELECT page_id, lower(regexp_extract({half('''replace(coalesce(url, ''), chr(92), '/')''')}, '[^/]*$')) AS name FROM pages")
def t02(t):
    return t.pages.select("page_id", T.normalize_document_name(F.col("url")).alias("name"))


@query("t03_map_chars", f"SELECT doc_id, translate({half('text')}, 'äöüéèêç', 'aoueeec') AS folded FROM documents")
def t03(t):
    return t.documents.select("doc_id", T.map_chars(T.to_halfwidth(F.col("text")), dict(zip("äöüéèêç", "aoueeec"))).alias("folded"))


def _clean(c: str) -> str:
    return _drop(f"trim(regexp_replace({half(f'lower({c})')}, '{T.QUESTION_PUNCTUATION}', ' ', 'g'))")


def _drop(out: str) -> str:
    for pattern, put in ((T.INTERROGATIVES, ""), (T.QUESTION_WORDS, " "), (T.FUNCTION_WORDS, " ")):
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), put)
    return out


@query("t04_clean_question", f"SELECT item_id, {_clean('text')} AS question FROM benchmark")
def t04(t):
    return t.benchmark.select("item_id", T.clean_question(F.col("text")).alias("question"))


@query("t05_tokenize", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def t05(t):
    tokens = T.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query("t06_mixed_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))), ' ') AS terms FROM documents")
def t06(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(T.mixed_terms(F.col("text"))), " ").alias("terms"))


@query("t07_fine_tokens", r"SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), ' ') AS parts FROM pages")
def t07(t):
    return t.pages.select("page_id", F.array_join(T.fine_tokens(F.array("url")), " ").alias("parts"))


@query("t08_pretoken", rf"SELECT doc_id, array_to_string(list_filter({TOKENS}, lambda x: NOT regexp_matches(x, '^[\p{{P}}\p{{S}}\s]') AND NOT regexp_matches(x, '^[0-9]$')), ' ') AS tokens FROM documents")
def t08(t):
    return t.documents.select("doc_id", F.array_join(T.pretoken(T.tokenize(F.col("text"))), " ").alias("tokens"))


@query("t09_merge_short_tokens", rf"""WITH tk AS (SELECT doc_id, {TOKENS} AS t FROM documents),
l AS (SELECT doc_id, t, coalesce(len(t) > 1 AND regexp_matches(t[1], '^.$|^[0-9a-z]{{1,2}}$') AND length(t[2]) > 1 AND NOT regexp_matches(t[2], '^[0-9a-zA-Z]'), false) AS lead FROM tk),
u AS (SELECT doc_id, unnest(CASE WHEN lead THEN t[3:] ELSE t END) AS x, unnest(range(0, len(t) - CASE WHEN lead THEN 2 ELSE 0 END)) AS i FROM l),
s AS (SELECT *, regexp_matches(x, '^.$|^[0-9a-z]{{1,2}}$') AND x NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) AS short FROM u),
g AS (SELECT doc_id, short, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, short ORDER BY i) AS run FROM s) GROUP BY doc_id, short, run),
m AS (SELECT doc_id, sum(CASE WHEN NOT short THEN n WHEN n < 5 THEN 1 ELSE (n - 3) // 2 + 1 END) AS n FROM g GROUP BY doc_id)
SELECT doc_id, (lead::INT + coalesce(n, 0))::INT AS n_merged FROM l LEFT JOIN m USING (doc_id)""")
def t09(t):
    return t.documents.select("doc_id", F.size(T.merge_short_tokens(T.tokenize(F.col("text")))).alias("n_merged"))


@query("t10_squeeze_spaces", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([^a-zA-Z0-9.,>]) +([^ ])', '\1\2', 'g'), '([^ ]) +([^a-zA-Z0-9.,<])', '\1\2', 'g') AS squeezed FROM documents")
def t10(t):
    return t.documents.select("doc_id", T.squeeze_spaces(F.col("text")).alias("squeezed"))


@query("t11_canonical_text")
def t11(t):
    return t.documents.select("doc_id", T.canonical_text(F.col("text")).alias("canonical"))


@query("t12_relative_years", "SELECT event_id, replace(replace(replace(event_type || ' 今年 去年 明年', '今年', year(ts) || '年'), '去年', (year(ts) - 1) || '年'), '明年', (year(ts) + 1) || '年') AS resolved FROM events")
def t12(t):
    return t.events.select("event_id", T.resolve_relative_years(F.concat("event_type", F.lit(" 今年 去年 明年")), F.col("ts")).alias("resolved"))


@query("t13_time_scopes")
def t13(t):
    return t.documents.select("doc_id", F.array_join(T.time_scopes(F.col("text")), ",").alias("scopes"))


@query("t14_statuses_locators_dimensions", r"""
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(^|[^0-9])((19|20)[0-9]{2}|[0-9]{2})E($|[^A-Za-z])') THEN 'forecast' ELSE '' END AS statuses, (CASE WHEN regexp_matches(translate(coalesce(text, ''), '％', '%'), '%') THEN 'rate' ELSE '' END) ||
 (CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z])EPS($|[^A-Za-z])') THEN CASE WHEN regexp_matches(text, '%') THEN ',' ELSE '' END || 'per_share' ELSE '' END) AS dims FROM documents""")
def t14(t):
    return t.documents.select("doc_id", F.array_join(T.fact_statuses(F.col("text")), ",").alias("statuses"), F.array_join(F.array_intersect(T.measurement_dimensions(F.col("text")), F.array(F.lit("rate"), F.lit("per_share"))), ",").alias("dims"))


@query("t15_reporting_periods")
def t15(t):
    return t.documents.select("doc_id", F.array_join(T.reporting_periods(F.col("text")), ",").alias("periods"))


@query("t16_query_anchors")
def t16(t):
    return t.documents.select("doc_id", F.explode(preserve.anchors(F.col("text"))).alias("a")).select("doc_id", "a.*")


@query("t17_organizations")
def t17(t):
    return t.conversations.select("conv_id", "turn", F.array_join(preserve.organizations(F.col("text")), ",").alias("organizations"))


@query("t18_rewrite_check")
def t18(t):
    """Each user turn against the next user turn, as if it were its rewrite."""
    from pyspark.sql import Window

    turns = t.conversations.filter(F.col("role") == "user")
    pairs = turns.withColumn("candidate", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).filter("candidate is not null")
    return pairs.select("conv_id", "turn", preserve.rewrite_check(F.col("text"), F.col("candidate")).alias("c")).select("conv_id", "turn", "c.valid", F.size("c.missing_anchors").alias("n_missing"), F.size("c.added_risky_terms").alias("n_added"), F.array_join("c.conflicts", ",").alias("conflicts"))


@query("t19_parse_number", r"""
SELECT l_orderkey, l_linenumber, n::DOUBLE AS number, CASE WHEN unit = '%' THEN 'percent' ELSE 'currency' END AS dimension FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '%' ELSE '万元' END AS unit, round(l_quantity, 2) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 10000 END AS n FROM lineitem)""")
def t19(t):
    shown = F.concat(F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "%").otherwise(" 万元"))
    parsed = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", T.parse_number(shown).alias("n"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("n.value").cast("double").alias("number"), F.col("n.dimension").alias("dimension"))


@query("t20_normalize_cell", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}.%+-]', '', 'g') AS name, 'number:' || regexp_replace(p_retailprice::VARCHAR, '\.0+$', '') AS price, true AS same FROM part")
def t20(t):
    return spread(t.part.select("p_partkey", "p_name", "p_retailprice", "p_size")).select("p_partkey", T.normalize_cell(F.col("p_name")).alias("name"), T.normalize_cell(F.col("p_retailprice").cast("string")).alias("price"), T.cells_equal(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")), F.concat(F.lit("-"), F.col("p_size").cast("string"))).alias("same"))


@query("t21_citation_ids", r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || ' ##' || doc_id || '$$ ##7$$', '##(\d+)\$\$', 1), lambda x: x::INT::VARCHAR), ',') AS ids FROM documents")
def t21(t):
    cited = F.concat("text", F.lit(" ##"), F.col("doc_id").cast("string"), F.lit("$$ ##7$$"))
    return t.documents.select("doc_id", F.array_join(T.citation_ids(cited).cast("array<string>"), ",").alias("ids"))


@query("t22_answer_claims", r"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn, t ORDER BY i)::INT AS claim_index, s AS text, 0 AS n_cited FROM (
 SELECT conv_id, turn, t, i, trim(p) AS s FROM (SELECT conv_id, turn, t, unnest(parts) AS p, unnest(range(0, len(parts))) AS i FROM (
  SELECT conv_id, turn, row_number() OVER () AS t, regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\n]*[。！？!?；;]|[^。！？!?；;\n]+') AS parts FROM conversations WHERE role = 'assistant')))
WHERE regexp_matches(s, '[\w\p{L}]')""")
def t22(t):
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.explode(T.answer_claims(F.col("text"))).alias("c")).select("conv_id", "turn", "c.claim_index", "c.text", F.size("c.citation_ids").alias("n_cited"))


@query("t23_truncate_middle", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 130) || chr(10) || '...' || chr(10) || right(text, 65) END AS cut FROM documents")
def t23(t):
    return t.documents.select("doc_id", T.truncate_middle(F.col("text"), 200).alias("cut"))


@query("t24_token_count", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS n_tokens, len(regexp_extract(text, '^(?:\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])){0,100}')) AS first_chars FROM documents")
def t24(t):
    return t.documents.select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"), F.length(T.truncate_tokens(F.col("text"), 100)).cast("long").alias("first_chars"))


@query("t25_session_title", r"SELECT conv_id, turn, CASE WHEN s = '' THEN '新会话' ELSE s END AS title FROM (SELECT conv_id, turn, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 30) AS s FROM conversations)")
def t25(t):
    return t.conversations.select("conv_id", "turn", T.session_title(F.col("text")).alias("title"))


@query("t26_highlight", r"""WITH s AS (SELECT doc_id, unnest(p) AS s, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[\r\n]', ' ', 'g'), '[^.?!;。？！；]*[.?!;。？！；]|[^.?!;。？！；]+') AS p FROM documents)),
w AS (SELECT doc_id, i, regexp_extract_all(s, '[A-Za-z0-9]+|[^A-Za-z0-9]') AS p FROM s),
m AS (SELECT doc_id, i, trim(array_to_string(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN lower(p[k]) IN ('the', 'der') AND (k = 1 OR p[k - 1] <> '<') AND (k = len(p) OR p[k + 1] <> '>') THEN '<em>' || p[k] || '</em>' ELSE p[k] END), '')) AS s FROM w),
j AS (SELECT doc_id, string_agg(s, '...' ORDER BY i) AS shown FROM m WHERE contains(s, '<em>') GROUP BY doc_id)
SELECT doc_id, coalesce(shown, '') AS shown FROM documents LEFT JOIN j USING (doc_id)""")
def t26(t):
    return t.documents.select("doc_id", T.highlight(F.col("text"), F.array(F.lit("the"), F.lit("der"))).alias("shown"))


def _grams(c: str, n: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - {n} + 2, 2)), lambda i: substring({c}, i, {n})))"


@query("t27_trigram_coverage", rf"""
WITH p AS (SELECT conv_id, turn, {norm('text')} AS a, {norm("lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text)")} AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(b, a) THEN 1.0 WHEN contains(a, b) THEN length(b) / length(a)
  ELSE len(list_intersect({_grams('a', 'least(3, length(a))')}, {_grams('b', 'least(3, length(a))')})) / len({_grams('a', 'least(3, length(a))')}) END, 6) AS coverage FROM p""")
def t27(t):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pairs = t.conversations.withColumn("before", before)
    return pairs.select("conv_id", "turn", F.round(T.trigram_coverage(F.col("text"), F.col("before")), 6).alias("coverage"))


@query("t28_common_subject", """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), n AS (SELECT *, unnest(range(2, 17)) AS n FROM p), c AS (SELECT p_partkey, b, n, unnest(range(1, greatest(length(a) - n + 2, 1))) AS i, a FROM n),
f AS (SELECT p_partkey, min_by(substring(a, i, n), (-n, i)) AS s FROM c WHERE contains(b, substring(a, i, n)) GROUP BY p_partkey) SELECT p_partkey, coalesce(s, '') AS subject FROM p LEFT JOIN f USING (p_partkey)""")
def t28(t):
    return spread(t.part.select("p_partkey", "p_name", "p_type")).select("p_partkey", T.common_subject(F.lower("p_name"), F.lower("p_type")).alias("subject"))


@query("t29_web_sources", r"""
SELECT host, page_id, url, 'web-' || left(sha256(url), 16) AS source_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM (
    SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
  WHERE host <> '' AND trim(title) <> '') WHERE rank <= 10""")
def t29(t):
    from sievelight.operators.results import web_sources

    titled = t.pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return web_sources(titled, "host", "page_id").select("host", "page_id", "url", "source_id", "rank")


@query("t30_strip_provider_refs", r"SELECT doc_id, regexp_replace('[ref_1] ' || text, '\[ref_\d+\]', '', 'g') AS plain FROM documents")
def t30(t):
    return t.documents.select("doc_id", T.strip_provider_refs(F.concat(F.lit("[ref_1] "), "text")).alias("plain"))


#: Texts that reach every branch of the functions below, dealt to customers by key, and what they give.
CANONICAL = {
    "2024年第三季度 营收": "2024第三季度营业收入",
    "2023 至 2025 年 EPS！": "2023-2025每股收益",
    "25Q3 ROE＞10%": "25第三季度roe>10%",
    "2024H1 本公司 PE": "2024上半年该公司市盈率",
    "P/E 与 open": "市盈率与open",
}
SCOPES = {"2024年第三季度": "2024-Q3", "2023年全年": "2023-FY", "Q1 2024": "2024-Q1", "上半年": "ANY-H1", "2024 与 2025": "", "2026": "2026-YEAR", "2025E": "2025-FY", "2024年6月": "2024-M06"}
FACTS = {
    "2024年实际净利率12%": ("actual", "", "rate"),
    "预计每股收益1.2元/股": ("forecast", "", "per_share"),
    "目标装机 30 万千瓦，见表 2-1": ("target", "表21", "power"),
    "公司实现收入5亿元，图3": ("actual", "图3", "currency_amount"),
    "发电量100亿千瓦时，第三章": ("", "第三章", "energy"),
    "共 12 台，3 倍": ("", "", "count,multiple"),
}
PERIODS = {"2024年上半年与第三季度": "2024上半年,2024第三季度", "2025E净利润": "2025预测", "2023年和2024年全年": "2023,2024全年", "预测2025年全年": "2025预测全年", "无日期": ""}
ANCHORS = {
    "张三在上海负责": "named:上海,named:张三",
    "产品 X1 的发电量": "canonical_term:发电量,metric:发电量,named:产品 X1",
    "“核心资产”不超过30%": "negation:不超过,number:30,number_with_unit:30%,quoted:核心资产",
    "中国银行2024年营收": "date:2024年,metric:营业收入,number:2024,organization:中国银行",
}
NAMES = {"归属于母公司股东的净利润": "", "请问国电电力与华能国际股份的关系": "国电电力,华能国际股份", "推荐公司": "", "研报推荐的公司": ""}
#: (question, rewrite): (valid, missing, added, conflicts).
REWRITES = {
    ("A公司比B公司高吗", "B公司比A公司高吗"): (False, 1, 2, "comparison_subjects_changed"),
    ("国电电力的营收", "国电电力的营业收入"): (True, 0, 0, ""),
    ("产品 X1 不超过30%", "产品 X1 超过30%"): (False, 1, 0, "comparison_operator_changed"),
    ("火电利用小时", "煤电利用小时"): (False, 0, 1, ""),
    ("2024年预测净利润", "2024E净利润"): (False, 1, 0, ""),
}


def _column(items, i: int) -> list:
    return [v[i] for v in items]


@query("t11_canonical_cases", f"SELECT c_custkey, {picked_sql('c_custkey', CANONICAL.values())} AS canonical FROM customer")
def t11_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", T.canonical_text(picked("c_custkey", CANONICAL)).alias("canonical"))


@query("t13_time_scope_cases", f"SELECT c_custkey, {picked_sql('c_custkey', SCOPES.values())} AS scopes FROM customer")
def t13_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(T.time_scopes(picked("c_custkey", SCOPES)), ",").alias("scopes"))


@query("t14_fact_cases", "SELECT c_custkey, " + ", ".join(f"{picked_sql('c_custkey', _column(FACTS.values(), i))} AS {n}" for i, n in enumerate(("statuses", "locators", "dims"))) + " FROM customer")
def t14_cases(t):
    x = picked("c_custkey", FACTS)
    return spread(t.customer.select("c_custkey")).select("c_custkey", *[F.array_join(f(x), ",").alias(n) for f, n in ((T.fact_statuses, "statuses"), (T.locators, "locators"), (T.measurement_dimensions, "dims"))])


@query("t15_reporting_period_cases", f"SELECT c_custkey, {picked_sql('c_custkey', PERIODS.values())} AS periods FROM customer")
def t15_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(T.reporting_periods(picked("c_custkey", PERIODS)), ",").alias("periods"))


@query("t16_query_anchor_cases", f"SELECT c_custkey, {picked_sql('c_custkey', ANCHORS.values())} AS anchors FROM customer")
def t16_cases(t):
    found = F.transform(preserve.anchors(picked("c_custkey", ANCHORS)), lambda a: F.concat_ws(":", a["kind"], a["text"]))
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(F.array_sort(found), ",").alias("anchors"))


@query("t17_organization_cases", f"SELECT c_custkey, {picked_sql('c_custkey', NAMES.values())} AS organizations FROM customer")
def t17_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(preserve.organizations(picked("c_custkey", NAMES)), ",").alias("organizations"))


@query("t18_rewrite_cases", "SELECT c_custkey, " + ", ".join(f"{picked_sql('c_custkey', _column(REWRITES.values(), i))} AS {n}" for i, n in enumerate(("valid", "n_missing", "n_added", "conflicts"))) + " FROM customer")
def t18_cases(t):
    pairs = spread(t.customer.select("c_custkey")).select("c_custkey", *[picked("c_custkey", _column(REWRITES, i)).alias(n) for i, n in enumerate(("q", "r"))])
    return pairs.select("c_custkey", preserve.rewrite_check(F.col("q"), F.col("r")).alias("c")).select("c_custkey", "c.valid", F.size("c.missing_anchors").alias("n_missing"), F.size("c.added_risky_terms").alias("n_added"), F.array_join("c.conflicts", ",").alias("conflicts"))


#: Mixed Chinese and Latin terms, and tokens with inner cuts.
MIXED = {"煤电 A1 装机量": "a1,煤电,装机,机量", "Alpha beta alpha": "alpha,beta", "风": "", "x_1 风电 a-b": "x_1,a,b,风电"}


@query("t06_mixed_term_cases", f"SELECT c_custkey, {picked_sql('c_custkey', MIXED.values())} AS terms FROM customer")
def t06_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(T.mixed_terms(picked("c_custkey", MIXED)), ",").alias("terms"))


CUT = {"煤电/风电": "煤电,风电", "可再生能源": "可再,再生,生能,能源", "a//b": "a,b", "风电": "风电"}


@query("t07_fine_token_cases", f"SELECT c_custkey, {picked_sql('c_custkey', CUT.values())} AS parts FROM customer")
def t07_cases(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.array_join(T.fine_tokens(F.array(picked("c_custkey", CUT))), ",").alias("parts"))
