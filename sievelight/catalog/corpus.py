"""Queries of corpus preparation, streaming forms and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.catalog.registry import query
from sievelight.functions import hooks
from sievelight.operators import corpus as D
from sievelight.streaming import jobs as X


def _without(tags) -> str:
    return "|".join(rf"<{x}\b[^>]*>.*?</{x}>" for x in tags)


BREAKS = r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?section|/?article|/?blockquote)\b[^>]*>"
PLAIN = "x"
for name, char in D.ENTITIES:
    PLAIN = "replace({}, '{}', '{}')".format(PLAIN, name, char.replace("'", "''"))


@query("d01_html_sections", rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), b AS (SELECT page_id, regexp_extract(h, '(?is)<title[^>]*>([^<]*)</title>', 1) AS title,
 regexp_replace(h, '(?is)<!--.*?-->|{_without(("script", "style", "nav", "header", "footer", "aside", "noscript"))}|<head\b.*?</head>', '', 'g') AS body FROM p),
m AS (SELECT page_id, title, body, regexp_extract(body, '(?is){_without(("article", "main")).replace(".*?", "(.*?)")}', ['a', 'b']) AS g FROM b),
x AS (SELECT page_id, title || chr(10) || regexp_replace(regexp_replace(CASE WHEN g.a || g.b <> '' THEN g.a || g.b ELSE body END, '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM m),
l AS (SELECT page_id, list_filter(list_transform(string_split({PLAIN}, chr(10)), lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))), lambda y: y <> '') AS l FROM x)
SELECT page_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS text FROM l""")
def d01(t):
    return D.html_sections(t.pages)


@query("d02_split_segments", r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, seg AS segment FROM (SELECT doc_id, unnest(s) AS seg, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([\n!?;。；！？])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents))")
def d02(t):
    return D.split_segments(t.documents)


@query("d03_chunk_by_budget", r"""WITH RECURSIVE segs AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([\n!?;。；！？])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
sized AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) AS n FROM segs),
walk AS (SELECT doc_id, s, n, 1 AS i, 0::BIGINT AS held, 0 AS block, ''::VARCHAR AS piece FROM sized
 UNION ALL SELECT doc_id, s, n, i + 1, CASE WHEN held > 128 THEN n[i] ELSE held + n[i] END, CASE WHEN held > 128 THEN block + 1 ELSE block END, s[i] FROM walk WHERE i <= len(s)),
blocks AS (SELECT doc_id, block, string_agg(piece, '' ORDER BY i) AS content FROM walk WHERE i > 1 GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS seq, content FROM blocks WHERE trim(content) <> ''""")
def d03(t):
    return D.chunk_by_budget(t.documents)


@query("d04_json_sections", "SELECT event_id AS doc_id, '/k=' || regexp_extract(props, '\\d+') || chr(10) AS section FROM events")
def d04(t):
    return D.json_sections(t.events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))).select("doc_id", "section")


@query("d05_markdown_blocks", r"""WITH m AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '(?m)^(\S+ \S+)\.$', '# \1', 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS n FROM m), g AS (SELECT *, coalesce(starts_with(lag(line) OVER (PARTITION BY doc_id ORDER BY n), '#'), false) AS glued FROM u),
b AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS block FROM g), j AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY n) AS text FROM b GROUP BY ALL),
h AS (SELECT doc_id, block, CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) > 384 THEN [left(text, ceil(length(text) / 2)::INT), substring(text, ceil(length(text) / 2)::INT + 1)] ELSE [text] END AS parts FROM j)
SELECT doc_id, block, unnest(range(0, len(parts)))::INT AS part, unnest(parts) AS text FROM h""")
def d05(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?m)^(\S+ \S+)\.$", "# $1").alias("text"))
    return D.markdown_blocks(marked)


@query("d06_markdown_tables", "SELECT s_suppkey AS doc_id, 1 AS n_tables, length('before' || chr(10) || 'after ' || s_name)::BIGINT AS rest_chars FROM supplier")
def d06(t):
    text = F.concat(F.lit("before\n| a | b |\n| --- | --- |\n| "), "s_name", F.lit(" | x |\nafter "), "s_name")
    return D.markdown_tables(t.supplier.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))).select("doc_id", F.size("tables").alias("n_tables"), F.length("rest").cast("long").alias("rest_chars"))


@query("d07_rows_to_text", "SELECT p_partkey, concat_ws('; ', 'p_name：' || p_name, 'p_brand：' || p_brand, 'p_size：' || p_size) || ' ——Parts' AS text FROM part")
def d07(t):
    return D.rows_to_text(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", "Parts").select("p_partkey", "text")


def cells(t):
    """Parts as tables of forty: a header row, then names, sizes and prices."""
    p = t.part.select(F.expr("p_partkey div 40").alias("table_id"), (F.col("p_partkey") + 1).alias("row"), F.posexplode(F.array(F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.when(F.col("p_partkey") % 9 == 0, "Total").otherwise(F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 9 == 0, "sum up").otherwise("7"), F.when(F.col("p_partkey") % 9 == 0, "of all").otherwise("8"))).alias("col", "text"))
    head = t.part.select(F.expr("p_partkey div 40").alias("table_id")).distinct().select("table_id", F.lit(0).cast("long").alias("row"), F.posexplode(F.array(F.lit("size"), F.lit("price"), F.lit("key"), F.lit("a b"), F.lit("c d"))).alias("col", "text"))
    return head.unionByName(p)


@query("d08_infer_header_rows", "SELECT p_partkey // 40 AS table_id, p_partkey + 1 AS row, p_partkey % 9 = 0 AS header FROM part UNION ALL SELECT DISTINCT p_partkey // 40, 0, true FROM part")
def d08(t):
    return D.infer_header_rows(cells(t)).select("table_id", "row", "header")


@query("d08_header_labels", """WITH c AS (SELECT p_partkey // 40 AS table_id, p_partkey + 1 AS row, p_partkey % 9 = 0 AS header, [p_size::VARCHAR, p_retailprice::VARCHAR, CASE WHEN p_partkey % 9 = 0 THEN 'Total' ELSE p_partkey::VARCHAR END, CASE WHEN p_partkey % 9 = 0 THEN 'sum up' ELSE '7' END, CASE WHEN p_partkey % 9 = 0 THEN 'of all' ELSE '8' END] AS t FROM part
 UNION ALL SELECT DISTINCT p_partkey // 40, 0, true, ['size', 'price', 'key', 'a b', 'c d'] FROM part),
g AS (SELECT *, header AND NOT coalesce(lag(header) OVER (PARTITION BY table_id ORDER BY row), false) AS gap FROM c), b AS (SELECT *, sum(gap::INT) OVER (PARTITION BY table_id ORDER BY row) AS block FROM g),
x AS (SELECT table_id, row, header, block, unnest(range(0, 5))::INT AS col, unnest(t) AS text FROM b), l AS (SELECT table_id, block, col, string_agg(text, ',' ORDER BY row) AS label FROM x WHERE header GROUP BY ALL)
SELECT table_id, row, col, text, label FROM x LEFT JOIN l USING (table_id, block, col) WHERE NOT header""")
def d08b(t):
    c = cells(t)
    return D.header_labels(c, D.infer_header_rows(c))


@query("d13_content_ids", """SELECT doc_id, sha256('{"name":"' || source || '","seq":' || doc_id || ',"content":"' || lang || '"}') AS chunk_sha FROM documents""")
def d13(t):
    return D.content_ids(t.documents.select("doc_id", F.col("source").alias("name"), F.col("doc_id").alias("seq"), F.col("lang").alias("content"))).select("doc_id", "chunk_sha")


#: A text that is no Latin one, between table tags of all kinds and what only looks like them.
TAGGED = '<table><tr><td class="x">可再生能源 装机</td><th>A1</th></tr></table> <tr- <table width="a longer one">'
FINE = r"flatten(list_transform({}, lambda x: CASE WHEN regexp_full_match(x, '[\x{{4e00}}-\x{{9fff}}]{{3,}}') THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END))"


@query("d14_build_chunk_record", rf"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{TAGGED}' ELSE text END AS content, CASE WHEN doc_id % 7 = 0 THEN '发电量报告' ELSE source END AS title FROM documents),
t AS (SELECT doc_id, content, regexp_extract_all(lower(regexp_replace(coalesce(content, ''), '</?(table|td|caption|tr|th)( [^<>]{{0,12}})?>', ' ', 'g')), '[\p{{L}}\p{{N}}_]+') AS tokens, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') AS title FROM c)
SELECT doc_id, length(content) AS chars, array_to_string(tokens, ' ') AS tokens, array_to_string({FINE.format('tokens')}, ' ') AS fine_tokens, array_to_string(title, ' ') AS title, array_to_string({FINE.format('title')}, ' ') AS title_fine FROM t""")
def d14(t):
    other = F.col("doc_id") % 7 == 0
    c = t.documents.select("doc_id", F.when(other, TAGGED).otherwise(F.col("text")).alias("content"), F.when(other, "发电量报告.pdf").otherwise(F.concat("source", F.lit(".txt"))).alias("name"))
    joined = {"tokens": "tokens", "fine_tokens": "fine_tokens", "title": "title_tokens", "title_fine": "title_fine_tokens"}
    return D.build_chunk_record(c).select("doc_id", F.length("content").cast("long").alias("chars"), *[F.array_join(v, " ").alias(k) for k, v in joined.items()])


def outline(t):
    """Suppliers' outlines: numbered sections of their id."""
    k = F.col("s_suppkey").cast("string")
    lines = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("第1章 a"), F.lit("第2节 b"), F.lit("第3节 c"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.concat(F.lit("Section "), k), F.lit("Article 2"), F.lit("Article 3"))).otherwise(F.array(F.lit("plain"), F.lit("text"), F.lit("0 none")))
    return t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(lines).alias("pos", "text"))


@query("d15_outline_scheme", "SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE -1 END AS scheme FROM supplier")
def d15(t):
    return D.outline_scheme(outline(t))


@query("d16_outline_levels", "SELECT s_suppkey AS doc_id, pos, CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN pos = 0 THEN 1 ELSE 2 END ELSE CASE WHEN pos = 0 THEN 2 ELSE 3 END END AS level FROM supplier, (VALUES (0), (1), (2)) v(pos) WHERE s_suppkey % 3 < 2")
def d16(t):
    o = outline(t)
    return D.outline_levels(o, D.outline_scheme(o))


@query("d17_language_share", r"""WITH x AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l, regexp_split_to_array(coalesce(text, ''), '[ \t]+') AS k FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^[ `a-zA-Z0-9,.:;''"?<>!()\-]+$'))) > 0.8 * len(l) AS english, len(k) <= 3 OR len(list_filter(k, lambda x: NOT regexp_matches(x, '^[a-zA-Z]+$'))) >= 0.7 * len(k) AS non_latin FROM x""")
def d17(t):
    return t.documents.select("doc_id", D.language_share(F.col("text")).alias("s")).select("doc_id", "s.english", "s.non_latin")


@query("d18_session_chunks", r"""WITH RECURSIVE t AS (SELECT doc_id, left(text, 4000) AS t FROM documents), p AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM t WHERE length(t) > 2000),
u AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM p), k AS (SELECT doc_id, i, x, unnest(range(0, ceil(length(x) / 2000)::INT)) AS j FROM u),
s AS (SELECT doc_id, i, j, substring(x || chr(10), (j * 2000 + 1)::INT, CASE WHEN j = ceil(length(x) / 2000)::INT - 1 THEN 2001 ELSE 2000 END) AS piece FROM k), l AS (SELECT doc_id, list(piece ORDER BY i, j) AS s FROM s GROUP BY doc_id),
walk AS (SELECT doc_id, s, 1 AS i, 0::BIGINT AS held, 0 AS block, ''::VARCHAR AS piece FROM l UNION ALL SELECT doc_id, s, i + 1, CASE WHEN held > 0 AND held + length(s[i]) > 2000 THEN length(s[i]) ELSE held + length(s[i]) END, CASE WHEN held > 0 AND held + length(s[i]) > 2000 THEN block + 1 ELSE block END, s[i] FROM walk WHERE i <= len(s))
SELECT doc_id, 0 AS seq, t AS content FROM t WHERE length(t) <= 2000 UNION ALL SELECT doc_id, block, string_agg(piece, '' ORDER BY i) FROM walk WHERE i > 1 GROUP BY doc_id, block""")
def d18(t):
    return D.session_chunks(t.documents)


@query("d19_check_vectors", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 7 = 1 THEN 'not_unit' END AS problem FROM embeddings")
def d19(t):
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 7 == 1, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    return D.check_vectors(t.embeddings.select("vec_id", v.alias("embedding")), 64).select("vec_id", "problem")


@query("x01_fold_deltas", "SELECT user_id::VARCHAR AS stream_id, string_agg(event_type, '' ORDER BY event_id) AS answer, count(*) AS n_pieces FROM events GROUP BY 1")
def x01(t):
    return X.fold_deltas(t.events.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text")))


@query("x02_stream_timings", "WITH g AS (SELECT user_id, ts, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id AS stream_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS span, round(coalesce(max(gap), 0) / 1e6, 3) AS max_gap, sum(length(event_type))::BIGINT AS chars FROM g GROUP BY 1")
def x02(t):
    e = t.events.select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return X.stream_timings(e).select("stream_id", F.round("span", 3).alias("span"), F.round("max_gap", 3).alias("max_gap"), "chars")


def _embedder():
    return lambda texts: [[float(len(x) + 1), 1.0, 0.0] for x in texts]


def _scorer():
    return lambda pairs: [len(set(q.split()) & set(x.split())) / max(1, len(set(q.split()))) for q, x in pairs]


@query("u01_embed_with", "SELECT doc_id, CASE WHEN length(text) >= 0 THEN 'not_unit' END AS problem, round(sqrt((length(coalesce(text, '')) + 1) * (length(coalesce(text, '')) + 1) + 1), 2) AS norm FROM documents")
def u01(t):
    return hooks.embed_with(t.documents.select("doc_id", "text"), _embedder, 3).select("doc_id", "problem", F.round("norm", 2).alias("norm"))


@query("u02_score_pairs_with", r"SELECT conv_id, turn, CASE WHEN list_contains(regexp_split_to_array(text, '\s+'), role) THEN 1.0 ELSE 0.0 END::DOUBLE AS raw FROM conversations")
def u02(t):
    return hooks.score_pairs_with(t.conversations.select("conv_id", "turn", F.col("role").alias("query"), "text"), _scorer).select("conv_id", "turn", "raw")
