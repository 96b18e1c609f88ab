"""Queries of term statistics and retrieval; documents are the chunks, benchmark passages the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.catalog.registry import Tables, query
from sievelight.catalog.texts import _clean as clean_sql
from sievelight.catalog.texts import _drop as drop_sql
from sievelight.catalog.texts import TOKENS, picked, picked_sql
from sievelight.catalog.texts import half as half_sql
from sievelight.functions import text as T
from sievelight.operators import search as R
from sievelight.operators import terms as W
from sievelight.operators.joins import settled, small
from sievelight.plans import hybrid
from sievelight.sources.tables import spread

#: Synonyms and aliases that the queries use as dictionary tables.
SYNONYMS = (("the", "der"), ("and", "und"), ("of", "de"), ("for", "pour"))
ALIASES = (("the", "der", 1, None), ("the", "la", 2, None), ("and", "und", 3, "hand"), ("of", "von", 4, None))


def values(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def chunks(t: Tables) -> DataFrame:
    d = t.documents
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("kb_id"), "lang", F.col("text").alias("content"), T.tokenize(F.col("text")).alias("tokens"), F.array("lang", "source").alias("tags"))


def question_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.posexplode(T.tokenize(F.col("text"))).alias("pos", "term"))


def index(t: Tables) -> W.Index:
    """The chunks' postings of all terms that a question holds."""
    return W.build_index(chunks(t), question_tokens(t))


def weights(t: Tables, by: W.Index | None = None) -> DataFrame:
    return W.term_weights(question_tokens(t), (by or index(t)).stats())


def asked(t: Tables, by: W.Index | None = None) -> DataFrame:
    """Weighted distinct terms of every query."""
    return weights(t, by).groupBy("query_id", "term").agg(F.sum("weight").alias("boost"))


def hits(t: Tables) -> DataFrame:
    """BM25 hits of all questions."""
    by = index(t)
    return R.bm25(asked(t, by), by)


BASE = r"""tok AS (SELECT doc_id AS chunk_id, doc_id, source AS kb_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS tokens FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT term, sum(tf)::BIGINT AS freq, count(*) AS df FROM post GROUP BY term)"""


def weigh(source: str, key: str) -> str:
    number, latin = "regexp_matches(term, '^[0-9. -]{2,}$')", "regexp_matches(term, '^[a-z. -]+$')"
    f = f"CASE WHEN {number} THEN 3.0 WHEN freq IS NOT NULL THEN greatest(freq, 10) WHEN {latin} THEN 300 ELSE 10 END::DOUBLE"
    d = f"CASE WHEN {number} THEN 5.0 WHEN df IS NOT NULL THEN df + 3 WHEN {latin} THEN 300 ELSE 3 END::DOUBLE"
    kind = "(CASE WHEN regexp_matches(term, '^[0-9,.]{2,}$') THEN 2.0 WHEN regexp_matches(term, '^[a-z]{1,2}$') THEN 0.01 ELSE 1.0 END::DOUBLE * CASE WHEN regexp_matches(term, '^[0-9-]+') THEN 2 ELSE 1 END)"
    return f"""SELECT {key}, pos, term, raw / sum(raw) OVER (PARTITION BY {key}) AS weight FROM (
 SELECT {key}, pos, term, (0.3 * log10(10 + (1e7 - f + 0.5) / (f + 0.5)) + 0.7 * log10(10 + (1e9 - d + 0.5) / (d + 0.5))) * kind AS raw
 FROM (SELECT {key}, pos, term, {f} AS f, {d} AS d, {kind} AS kind FROM {source} LEFT JOIN stats USING (term)))"""


WEIGHTS = BASE + r""",
qtok AS (SELECT query_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM benchmark)),
w AS (""" + weigh("qtok", "query_id") + """),
asked AS (SELECT query_id, term, sum(weight) AS boost FROM w GROUP BY ALL)"""
HITS = WEIGHTS + """,
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
part AS (SELECT p.chunk_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avgdl)) AS part
  FROM post p JOIN stats USING (term) JOIN tok ON tok.chunk_id = p.chunk_id, size),
hits AS (SELECT query_id, chunk_id, sum(boost * part) AS score, count(*) AS n_terms FROM asked JOIN part USING (term) GROUP BY ALL)"""
TOP = HITS + """,
top AS (SELECT * FROM (SELECT query_id, chunk_id, score, n_terms, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits) WHERE rank <= {n})"""


def top_sql(n: int) -> str:
    return TOP.replace("{n}", str(n))


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("w01_term_stats", f"WITH {BASE} SELECT term, freq, df FROM stats")
def w01(t):
    return W.term_stats(chunks(t))


@query("w02_term_weights", f"WITH {WEIGHTS} SELECT query_id, pos, term, round(weight, 6) AS weight FROM w")
def w02(t):
    return weights(t).select("query_id", F.col("pos").cast("long").alias("pos"), "term", r6("weight"))


def synonyms(t):
    return t.spark.createDataFrame(SYNONYMS, "term string, synonym string")


@query("w03_synonyms", f"WITH {WEIGHTS}, syn(term, synonym) AS (VALUES {values(SYNONYMS)}) SELECT query_id, synonym AS term, round(weight / 4, 6) AS boost FROM w JOIN syn USING (term)")
def w03(t):
    return W.expand_synonyms(weights(t), synonyms(t)).select("query_id", "term", r6("boost"))


PHRASES = "SELECT query_id, term || ' ' || next AS term, 2 * greatest(weight, nw) AS boost FROM (SELECT *, lead(term) OVER o AS next, lead(weight) OVER o AS nw FROM w {where} WINDOW o AS (PARTITION BY query_id ORDER BY pos)) WHERE next IS NOT NULL"


@query("w04_phrases", f"WITH {WEIGHTS} SELECT query_id, term, round(boost, 6) AS boost FROM ({PHRASES.format(where='')})")
def w04(t):
    return W.phrase_terms(weights(t)).select("query_id", "term", r6("boost"))


#: Questions that are not Latin: with group synonyms, Latin words in one group, finer tokens, and more keywords than count.
OTHER_QUESTIONS = (
    "2024年 可再生能源 装机容量 是多少",
    "火电 利用小时数 solar power output 同比 A1",
    "新能源 发电量",
    "光伏组件 价格走势 风电机组 储能电站 输电线路 碳排放权 交易价格 绿色电力 证书核发 容量电价 辅助服务 市场化改革",
)
OTHER_SYNONYMS = SYNONYMS + (("装机容量", "装机规模"), ("发电量", "电量"), ("发电量", "上网电量"), ("solar", "photovoltaic"))


def asked_texts(t: Tables) -> DataFrame:
    """Passages as questions, every third one replaced by a question that is not Latin."""
    n = F.col("item_id")
    return t.benchmark.select(n.alias("query_id"), F.when(n % 3 == 0, picked("item_id", OTHER_QUESTIONS)).otherwise(F.col("text")).alias("text"))


def question_sql(source: str) -> str:
    """CTEs that make ``terms(query_id, latin, grp, kind, term, boost)`` of ``source(query_id, text)``, with ``stats`` and ``syn`` at hand."""
    tokens = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    fine = r"CASE WHEN length(term) >= 3 AND NOT regexp_full_match(term, '[0-9a-z.+#_*-]+') AND regexp_full_match(term, '[\x{4e00}-\x{9fff}]+') THEN list_transform(range(1, length(term)), lambda i: substr(term, i, 2)) ELSE [] END"
    return rf"""cleaned AS (SELECT query_id, {clean_sql('text')} AS c FROM {source}),
shaped AS (SELECT query_id, {drop_sql('c')} AS c, len(w) > 3 AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-zA-Z]+'))) / len(w) < 0.7 AS latin FROM (SELECT *, string_split_regex(c, '[ \t]+') AS w FROM cleaned)),
lat AS (SELECT query_id, true AS latin, unnest(range(0, len(t))) AS grp, unnest(t) AS name, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM (SELECT query_id, {tokens.format('c')} AS t FROM shaped WHERE latin)),
pieces AS (SELECT query_id, unnest(range(0, len(p))) AS "at", unnest(p) AS piece FROM (SELECT query_id, list_filter(string_split_regex(c, '[ \t]+'), lambda x: x <> '') AS p FROM shaped WHERE NOT latin)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY "at") - 1 AS grp FROM (SELECT *, CASE WHEN regexp_matches(piece, '[a-zA-Z]$') AND coalesce(regexp_matches(lag(piece) OVER (PARTITION BY query_id ORDER BY "at"), '[a-zA-Z]$'), false) THEN 0 ELSE 1 END AS new FROM pieces)),
nam AS (SELECT *, string_agg(piece, ' ' ORDER BY "at") OVER (PARTITION BY query_id, grp ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS name FROM isl WHERE grp < 256),
oth AS (SELECT query_id, false AS latin, grp, name, row_number() OVER (PARTITION BY query_id ORDER BY "at", i) - 1 AS pos, term FROM (SELECT *, unnest(range(0, len(t))) AS i, unnest(t) AS term FROM (SELECT *, {tokens.format('piece')} AS t FROM nam))),
grouped AS (SELECT *, CASE WHEN latin THEN -1 ELSE grp END AS part FROM (SELECT * FROM lat UNION ALL BY NAME SELECT * FROM oth)),
gw AS (SELECT g.*, weight FROM grouped g JOIN ({weigh('grouped', 'query_id, part')}) x ON x.query_id = g.query_id AND x.pos = g.pos),
lw AS (SELECT *, lead(term) OVER o AS next, lead(weight) OVER o AS nw FROM gw WHERE latin AND NOT regexp_full_match(term, '[a-z0-9]') WINDOW o AS (PARTITION BY query_id ORDER BY pos)),
cw AS (SELECT *, 1 + len(fine) + n_own + CASE WHEN row_number() OVER (PARTITION BY query_id, grp ORDER BY round(weight, 9) DESC, pos) = 1 THEN 1 + n_group ELSE 0 END AS cost, CASE WHEN n_group > 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS times, lead(term) OVER (PARTITION BY query_id, grp ORDER BY pos) AS next
 FROM (SELECT *, {fine} AS fine, (SELECT count(*) FROM syn WHERE syn.term = gw.name) AS n_group, (SELECT count(*) FROM syn WHERE syn.term = gw.term) AS n_own FROM gw WHERE NOT latin)),
kept AS (SELECT *, times * weight AS b FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY grp, round(weight, 9) DESC, pos) AS used FROM cw) WHERE used < 32),
every AS (SELECT query_id, latin, grp, 'token' AS kind, term, weight AS boost FROM lw
 UNION ALL SELECT query_id, latin, grp, 'synonym', synonym, weight / 4 FROM lw JOIN syn USING (term)
 UNION ALL SELECT query_id, latin, grp, 'phrase', term || ' ' || next, 2 * greatest(weight, nw) FROM lw WHERE next IS NOT NULL
 UNION ALL SELECT query_id, latin, grp, 'token', term, b FROM kept
 UNION ALL SELECT query_id, latin, grp, 'fine', unnest(fine), b / 2 FROM kept WHERE len(fine) > 1
 UNION ALL SELECT query_id, latin, grp, 'fine', unnest(list_transform(range(1, len(fine)), lambda i: fine[i] || ' ' || fine[i + 1])), b FROM kept WHERE len(fine) > 1
 UNION ALL SELECT query_id, latin, grp, 'synonym', synonym, b / 5 FROM kept JOIN syn USING (term)
 UNION ALL SELECT query_id, latin, grp, 'phrase', term || ' ' || next, 1.5 * times FROM cw WHERE next IS NOT NULL
 UNION ALL SELECT query_id, false, grp, 'group_synonym', synonym, 0.7 FROM (SELECT query_id, grp, name FROM kept UNION SELECT query_id, grp, name FROM cw WHERE next IS NOT NULL) g JOIN syn ON syn.term = g.name),
terms AS (SELECT query_id, latin, grp::INT AS grp, kind, term, sum(boost) AS boost FROM every GROUP BY ALL)"""


SYN = f"syn(term, synonym) AS (VALUES {values(OTHER_SYNONYMS)})"
TEXTS = f"texts AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN {picked_sql('item_id', OTHER_QUESTIONS)} ELSE text END AS text FROM benchmark)"


@query("w05_query_terms", f"WITH {BASE}, {SYN}, {TEXTS}, {question_sql('texts')} SELECT query_id, latin, grp, kind, term, round(boost, 6) AS boost FROM terms")
def w05(t):
    tokens = W.question_tokens(asked_texts(t))
    by = W.build_index(chunks(t), tokens)
    pairs = t.spark.createDataFrame(OTHER_SYNONYMS, "term string, synonym string")
    return W.query_terms(W.question_weights(tokens, by.stats()), pairs).select("query_id", "latin", "grp", "kind", "term", r6("boost"))


def keywords(t):
    return W.paragraph_keywords(W.paragraph_weights(W.postings(chunks(t)), W.term_stats(chunks(t))))


KEYWORDS = BASE + ", ctok AS (SELECT chunk_id, unnest(tokens) AS term, unnest(range(0, len(tokens))) AS pos FROM tok), cw AS (" + weigh("ctok", "chunk_id") + """),
kw AS (SELECT * FROM (SELECT chunk_id, term, weight, row_number() OVER (PARTITION BY chunk_id ORDER BY round(weight, 9) DESC, term) AS rank FROM (SELECT chunk_id, term, max(weight) AS weight FROM cw GROUP BY ALL)) WHERE rank <= 30)"""


@query("w06_paragraph_keywords", f"WITH {KEYWORDS} SELECT chunk_id, term, round(weight, 6) AS weight, least(3, floor(count(*) OVER (PARTITION BY chunk_id) / 10))::INT AS min_match FROM kw")
def w06(t):
    return keywords(t).select("chunk_id", "term", r6("weight"), "min_match")


def similarities(t: Tables) -> DataFrame:
    by = index(t)
    return W.token_similarity(weights(t, by), by.posts)


@query("w07_token_similarity", f"WITH {WEIGHTS} SELECT query_id, chunk_id, round(sum(boost) / any_value(total), 6) AS similarity FROM asked JOIN post USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1) USING (query_id) GROUP BY query_id, chunk_id")
def w07(t):
    return similarities(t).select("query_id", "chunk_id", r6("similarity"))


COSINE = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))))"


@query("w08_hybrid_similarity", f"""WITH {WEIGHTS}, sim AS (SELECT query_id, chunk_id, sum(boost) / any_value(total) AS s FROM asked JOIN post USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1) USING (query_id) GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(0.7 * {COSINE} + 0.3 * s, 6) AS similarity FROM sim JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id""")
def w08(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("b"))
    asked_vectors = vectors.select(F.col("chunk_id").alias("query_id"), F.col("b").alias("a")).join(t.benchmark.select(F.col("item_id").alias("query_id")).distinct(), "query_id", "left_semi")
    # Chunks without a vector leave before they are matched; a chunk's vector comes to its pairs, which stay where the chunk is.
    by = index(t)
    posts = by.posts.join(vectors.select("chunk_id").distinct().hint("shuffle_hash"), "chunk_id", "left_semi")
    sim = W.token_similarity(weights(t, by), posts)
    joined = sim.join(small(asked_vectors), "query_id").join(vectors.hint("shuffle_hash"), "chunk_id")
    return joined.select("query_id", "chunk_id", F.round(0.7 * R.cosine(F.col("a"), F.col("b")) + 0.3 * F.col("similarity"), 6).alias("similarity"))


@query("w09_alias_expansions", f"""WITH al(canonical, alias, ord, narrower) AS (VALUES {values(ALIASES)})
SELECT query_id, alias, row_number() OVER (PARTITION BY query_id ORDER BY ord, alias)::INT AS rank FROM (
 SELECT item_id AS query_id, alias, min(ord) AS ord FROM benchmark, al WHERE contains(lower(text), canonical) AND NOT contains(lower(text), alias) AND NOT coalesce(contains(lower(text), narrower), false) GROUP BY ALL) QUALIFY rank <= 8""")
def w09(t):
    aliases = t.spark.createDataFrame(ALIASES, "canonical string, alias string, ord int, narrower string")
    return W.alias_expansions(t.benchmark.withColumnRenamed("item_id", "query_id"), aliases).select("query_id", "alias", "rank")


TAGS = "tags AS (SELECT doc_id AS chunk_id, unnest([lang, source]) AS tag FROM documents)"


@query("w10_all_tags", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def w10(t):
    return W.all_tags(chunks(t))


@query("w11_tag_portion", f"WITH {TAGS} SELECT tag, n, round((n + 1) / (sum(n) OVER () + 1000), 6) AS portion FROM (SELECT tag, count(*) AS n FROM tags GROUP BY tag)")
def w11(t):
    return W.tag_portion(chunks(t)).select("tag", "n", r6("portion"))


def lift_sql(terms: str, key: str, matched: int, floor: int) -> str:
    value = "round(0.1 * (c + 1) / (sum_c + 1000) / greatest(portion, 1e-6))::BIGINT"
    value = f"greatest({value}, {floor})" if floor else value
    return f"""{TAGS}, portion AS (SELECT tag, (n + 1) / (sum(n) OVER () + 1000) AS portion FROM (SELECT tag, count(*) AS n FROM tags GROUP BY tag)),
hit AS (SELECT k.{key}, p.chunk_id FROM ({terms}) k JOIN post p USING (term) GROUP BY ALL HAVING count(*) >= {matched}),
tagged AS (SELECT {key}, tag, count(*) AS c FROM hit JOIN tags USING (chunk_id) GROUP BY ALL)
SELECT {key}, tag, lift, row_number() OVER (PARTITION BY {key} ORDER BY lift DESC, tag)::INT AS rank FROM (
 SELECT {key}, tag, {value} AS lift FROM (SELECT *, sum(c) OVER (PARTITION BY {key}) AS sum_c FROM tagged) JOIN portion USING (tag)) WHERE lift > 0 QUALIFY rank <= 3"""


@query("w12_tag_content", f"WITH {KEYWORDS}, {lift_sql('SELECT chunk_id AS target, term FROM kw WHERE chunk_id % 50 = 0', 'target', 3, 0)}")
def w12(t):
    """Query set: chunks whose id is divisible by 50, against all chunks."""
    terms = settled(W.keywords_of(chunks(t), F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("target"), "term"), [])
    return W.tag_lift(terms, chunks(t), "target", 3)


@query("w13_tag_query", f"WITH {WEIGHTS}, {lift_sql('SELECT query_id, term FROM asked', 'query_id', 3, 1)}")
def w13(t):
    return W.tag_lift(question_tokens(t).select("query_id", "term"), chunks(t), "query_id", 3, floor=1)


@query("w14_rank_feature_score", """WITH ct AS (SELECT doc_id AS chunk_id, unnest([lang, source]) AS tag, unnest([1.0, 2.0]) AS weight FROM documents),
qt AS (SELECT * FROM (VALUES (1, 'en', 1.0), (1, 'src1', 3.0), (2, 'fr', 2.0)) v(query_id, tag, weight)),
dot AS (SELECT query_id, chunk_id, sum(qt.weight * ct.weight) AS dot FROM qt JOIN ct USING (tag) GROUP BY ALL)
SELECT query_id, chunk_id, round(10 * dot / (qn * cn) + coalesce(quality, 0), 6) AS score FROM dot
JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM qt GROUP BY 1) USING (query_id)
JOIN (SELECT chunk_id, sqrt(sum(weight * weight)) AS cn FROM ct GROUP BY 1) USING (chunk_id)
LEFT JOIN labels ON labels.doc_id = chunk_id""")
def w14(t):
    tagged = t.documents.select(F.col("doc_id").alias("chunk_id"), F.explode(F.arrays_zip(F.array("lang", "source").alias("tag"), F.array(F.lit(1.0), F.lit(2.0)).alias("weight"))).alias("x")).select("chunk_id", F.col("x.tag"), F.col("x.weight"))
    asked_tags = t.spark.createDataFrame([(1, "en", 1.0), (1, "src1", 3.0), (2, "fr", 2.0)], "query_id int, tag string, weight double")
    rank = t.labels.select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("pagerank"))
    return W.rank_feature_score(asked_tags, tagged, rank).select("query_id", "chunk_id", r6("score"))


def labelled(t: Tables) -> DataFrame:
    available = t.labels.select(F.col("doc_id").alias("chunk_id"), (1 - F.col("toxic")).alias("available_int"))
    return chunks(t).join(available, "chunk_id", "left")


@query("r01_apply_filters", "SELECT d.doc_id AS chunk_id, source AS kb_id, 1 - toxic AS available_int FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source IN ('src1', 'src2') AND NOT coalesce(1 - toxic < 1, false)")
def r01(t):
    return R.apply_filters(labelled(t), available=1, kb_id=["src1", "src2"], doc_id=[]).select("chunk_id", "kb_id", "available_int")


@query("r02_bm25", f"WITH {HITS} SELECT query_id, chunk_id, round(score, 6) AS score, n_terms FROM hits")
def r02(t):
    return hits(t).select("query_id", "chunk_id", r6("score"), "n_terms")


@query("r03_binary_idf_score", f"WITH {HITS} SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)), 6) AS score FROM asked JOIN post USING (term) JOIN stats USING (term), size GROUP BY ALL")
def r03(t):
    by = index(t)
    return R.binary_idf_score(asked(t, by), by).select("query_id", "chunk_id", r6("score"))


@query("r04_min_should_match", f"""WITH {HITS}, a AS (SELECT query_id, count(*) AS asked FROM asked GROUP BY 1), s AS (SELECT * FROM hits JOIN a USING (query_id)),
strict AS (SELECT * FROM s WHERE n_terms >= floor(0.9 * asked))
SELECT query_id, chunk_id, n_terms FROM strict UNION ALL SELECT query_id, chunk_id, n_terms FROM s WHERE query_id NOT IN (SELECT query_id FROM strict) AND n_terms >= floor(0.5 * asked)""")
def r04(t):
    return R.min_should_match(hits(t), asked(t), 0.9, 0.5).select("query_id", "chunk_id", "n_terms")


def vector_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Query set: vectors whose id is divisible by 50, against all vectors."""
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("kb_id"))
    return v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec")), v


KNN = f"knn AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE score >= 0.1) WHERE rank <= 100)"


@query("r05_knn", f"WITH {KNN} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM knn WHERE rank <= 20")
def r05(t):
    q, v = vector_sets(t)
    return R.knn(q, v, 20).select("query_id", "chunk_id", r6("score"), "rank")


@query("r06_top_per_query", f"WITH {top_sql(100)} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM top")
def r06(t):
    return R.top_per_query(hits(t)).select("query_id", "chunk_id", r6("score"), "rank")


def expanded(t: Tables) -> DataFrame:
    """Queries with an expansion: even ones add a word, odd ones only spaces."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" der"))).otherwise(F.concat(F.lit("  "), "text")).alias("expanded"))


BRANCHES = """br AS (SELECT item_id AS query_id, unnest(['vector_original', 'keyword_original', 'keyword_expanded']) AS branch, unnest(['vector', 'keyword', 'keyword']) AS family,
 unnest(CASE WHEN item_id % 2 = 0 THEN [0.6, 0.2, 0.2] ELSE [0.6, 0.4, 0.0] END)::DOUBLE AS weight FROM benchmark)"""


@query("r07_branch_weights", f"WITH {BRANCHES} SELECT query_id, branch, round(weight, 6) AS weight FROM br WHERE weight > 0")
def r07(t):
    return R.branch_weights(expanded(t)).select("query_id", "branch", r6("weight"))


@query("r08_redistribute_weights", f"""WITH {BRANCHES}, h AS (SELECT *, CASE WHEN branch = 'keyword_original' OR (branch = 'vector_original' AND query_id % 3 = 0) THEN 1 ELSE 0 END AS hit FROM br WHERE weight > 0),
f AS (SELECT *, sum(hit) OVER (PARTITION BY query_id, family) AS fh, sum(weight) OVER (PARTITION BY query_id, family) AS fw FROM h),
l AS (SELECT *, sum(CASE WHEN fh > 0 THEN weight ELSE 0 END) OVER (PARTITION BY query_id) AS live FROM f)
SELECT query_id, branch, round(CASE WHEN hit = 1 THEN fw / live / fh ELSE 0 END, 6) AS weight FROM l""")
def r08(t):
    w = R.branch_weights(expanded(t))
    hits = w.filter("branch = 'keyword_original' or (branch = 'vector_original' and query_id % 3 = 0)")
    return R.redistribute_weights(w, hits).select("query_id", "branch", r6("weight"))


def rankings(t: Tables) -> DataFrame:
    """Keyword and vector hits of the vector query set, by their own ranks."""
    keyword = R.top_per_query(hits(t), 100).select("query_id", F.lit("keyword").alias("branch"), "chunk_id", "rank", "score")
    q, v = vector_sets(t)
    vector = R.knn(q, v, 100).select("query_id", F.lit("vector").alias("branch"), "chunk_id", "rank", "score")
    return keyword.unionByName(vector)


def even_weights(t: Tables) -> DataFrame:
    """Weights of both branches for all queries that may have hits there; nothing is searched for them."""
    row = lambda ids, branch, weight: ids.distinct().select("query_id", F.lit(branch).alias("branch"), F.lit(weight).alias("weight"))
    return row(t.benchmark.select(F.col("item_id").alias("query_id")), "keyword", 0.4).unionByName(row(vector_sets(t)[0].select("query_id"), "vector", 0.6))


RANKINGS = top_sql(100) + ", " + KNN + """,
rk AS (SELECT query_id, 'keyword' AS branch, chunk_id, rank, score, 0.4::DOUBLE AS weight FROM top UNION ALL SELECT query_id, 'vector', chunk_id, rank, score, 0.6 FROM knn),
fused AS (SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS score, min(rank) AS best_rank FROM rk GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, chunk_id) AS rank FROM fused)"""


@query("r09_rrf", f"WITH {RANKINGS} SELECT query_id, chunk_id, round(score, 9) AS score, best_rank::INT AS best_rank, rank::INT AS rank FROM ranked")
def r09(t):
    return R.rrf(rankings(t), even_weights(t)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "best_rank", "rank")


@query("r10_merge_branch_fields", f"WITH {RANKINGS} SELECT query_id, chunk_id, coalesce(max(CASE WHEN branch = 'vector' THEN rank END), max(CASE WHEN branch = 'keyword' THEN rank END))::INT AS rank, count(*)::INT AS n_branches FROM rk GROUP BY ALL")
def r10(t):
    return R.merge_branch_fields(rankings(t), ["rank"], ["vector", "keyword"]).select("query_id", "chunk_id", "rank", F.size("branch_scores").alias("n_branches"))


@query("r11_limit_identities", f"""WITH {RANKINGS}, i AS (SELECT query_id, chunk_id, rank, chunk_id % 7 AS identity FROM ranked), s AS (SELECT *, min(rank) OVER (PARTITION BY query_id, identity) AS fr FROM i),
n AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY fr) AS number FROM s), c AS (SELECT *, max(CASE WHEN number = 5 THEN fr END) OVER (PARTITION BY query_id) AS cut FROM n)
SELECT query_id, chunk_id, rank::INT AS rank FROM c WHERE (cut IS NULL OR rank <= cut) AND number > 2""")
def r11(t):
    ranked = R.rrf(rankings(t), even_weights(t)).withColumn("identity", F.col("chunk_id") % 7)
    return R.limit_identities(ranked, 3, 2).select("query_id", "chunk_id", "rank")


@query("r12_rerank_join", f"""WITH {top_sql(20)} SELECT query_id, chunk_id, chunk_id % 5 <> 0 AS valid, CASE WHEN chunk_id % 5 <> 0 THEN round(1 / (1 + exp(-((chunk_id % 11) / 5.0 - 1))), 6) END AS semantic FROM top""")
def r12(t):
    top = R.top_per_query(hits(t), 20)
    scores = top.filter("chunk_id % 5 <> 0").select("query_id", "chunk_id", ((F.col("chunk_id") % 11) / 5.0 - 1).alias("raw"))
    return R.rerank_join(top, scores, "logit").select("query_id", "chunk_id", "valid", r6("semantic"))


@query("r13_rerank_text", "SELECT doc_id AS chunk_id, source || chr(10) || CASE WHEN lang <> 'en' THEN lang || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE text END AS rerank_text FROM documents")
def r13(t):
    c = chunks(t).select("chunk_id", "content", F.col("kb_id").alias("document_name"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("caption"), F.when(F.col("chunk_id") % 3 == 0, "table").alias("table_text"))
    return R.rerank_text(c).select("chunk_id", "rerank_text")


@query("r14_constraint_compatibility")
def r14(t):
    """Assistant turns against the question before them."""
    from sievelight.operators.constraints import constraint_compatibility

    before = Window.partitionBy("conv_id").orderBy("turn", "role")
    pairs = t.conversations.withColumn("query", F.lag("text").over(before)).filter("role = 'assistant' and query is not null").withColumnRenamed("text", "candidate")
    return constraint_compatibility(pairs.select("conv_id", "turn", "query", "candidate")).select("conv_id", "turn", "time", "status", "locator", "dimension", "n_conflicts", "n_compatible")


#: (question, candidate): verdicts of time, status, locator, dimension, organisation and subject, conflicts and agreements.
CONSTRAINTS = {
    ("2024年第三季度净利率是多少", "2024年第三季度净利率为12%"): ("compatible", "unknown", "unknown", "compatible", "unknown", "compatible", 0, 3),
    ("2024年第三季度净利率", "2023年第三季度净利率1%"): ("conflict", "unknown", "unknown", "compatible", "unknown", "compatible", 1, 2),
    ("2024年收入", "2024年第二季度收入5亿元"): ("compatible", "unknown", "unknown", "unknown", "unknown", "unknown", 0, 1),
    ("2024年第三季度", "2024年报告"): ("unknown", "unknown", "unknown", "unknown", "unknown", "unknown", 0, 0),
    ("预测的表2", "实际见表3"): ("unknown", "conflict", "conflict", "unknown", "unknown", "unknown", 2, 0),
    ("国电电力的图1", "图1：国电电力"): ("unknown", "unknown", "compatible", "unknown", "compatible", "unknown", 0, 2),
}
VERDICTS = ("time", "status", "locator", "dimension", "entity", "subject", "n_conflicts", "n_compatible")


@query("r14_constraint_cases", "SELECT c_custkey, " + ", ".join(f"{picked_sql('c_custkey', [v[i] for v in CONSTRAINTS.values()])} AS {n}" for i, n in enumerate(VERDICTS)) + " FROM customer")
def r14_cases(t):
    from sievelight.operators.constraints import constraint_compatibility

    pairs = spread(t.customer.select("c_custkey")).select("c_custkey", *[picked("c_custkey", [k[i] for k in CONSTRAINTS]).alias(n) for i, n in enumerate(("query", "candidate"))])
    return constraint_compatibility(pairs).select("c_custkey", *VERDICTS)


def candidates(t: Tables) -> DataFrame:
    top = R.top_per_query(hits(t), 20)
    return top.withColumn("semantic", F.when(F.col("chunk_id") % 5 != 0, (F.col("chunk_id") % 11) / 11.0)).withColumn("conflicts", (F.col("chunk_id") % 17 == 0).cast("int"))


FINAL = top_sql(20) + """,
cand AS (SELECT *, CASE WHEN chunk_id % 5 <> 0 THEN (chunk_id % 11) / 11.0::DOUBLE END AS semantic, CASE WHEN chunk_id % 17 = 0 THEN 1 ELSE 0 END AS conflicts FROM top),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC NULLS LAST, round(score, 12) DESC, chunk_id) AS sr, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS cr FROM cand),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conflicts, round(0.7::DOUBLE / (10 + sr) + 0.3::DOUBLE / (10 + cr), 12) DESC, semantic DESC NULLS LAST, round(score, 12) DESC, chunk_id) AS final_rank FROM rr)"""


@query("r15_final_rank", f"WITH {FINAL} SELECT query_id, chunk_id, final_rank::INT AS final_rank FROM fin WHERE final_rank <= 5")
def r15(t):
    return R.final_rank(candidates(t)).select("query_id", "chunk_id", "final_rank")


@query("r16_doc_aggs", f"WITH {top_sql(100)} SELECT query_id, doc_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id)::INT AS rank FROM (SELECT query_id, source AS doc_id, count(*) AS n FROM top JOIN documents ON documents.doc_id = chunk_id GROUP BY query_id, source)")
def r16(t):
    top = R.top_per_query(hits(t))
    return R.doc_aggs(top.join(chunks(t).select("chunk_id", F.col("kb_id").alias("doc_id")), "chunk_id"))


#: Where the years of the hybrid queries' chunks begin.
FIRST_YEAR = 2020
#: Of many groups only the year is found, so all of its hits are relaxed ones.
RELAXED = "2023年 光伏组件 价格走势 风电机组 储能电站 输电线路 碳排放权 交易价格"


def hybrid_chunks(t: Tables) -> DataFrame:
    """Documents under titles with a year; every fourth one is a row of a table, which its rows share a place for."""
    n = F.col("doc_id")
    title = F.concat("kb_id", F.lit(" "), (FIRST_YEAR + n % 5).cast("string"), F.lit("年"))
    table = F.when(n % 4 == 0, F.concat(F.lit("table "), "kb_id", F.lit(" "), F.floor(n / 40).cast("string")))
    return labelled(t).withColumn("document_name", title).withColumn("title_tokens", T.tokenize(title)).withColumn("identity", table)


def hybrid_questions(t: Tables) -> DataFrame:
    """Passages as questions: one third asks for a year too, one third are questions that are not Latin; with a vector where there is one of that id."""
    n = F.col("item_id")
    text = F.when(n % 3 == 0, picked("item_id", (*OTHER_QUESTIONS, RELAXED))).when(n % 3 == 1, F.concat("text", F.lit(" 2022年"))).otherwise(F.col("text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return t.benchmark.select(n.alias("query_id"), text.alias("text")).join(vectors, "query_id", "left")


def facts_sql(text: str, source: str, key: str) -> str:
    """(key, time, status, dims) of a table's texts: the constraints that need no Chinese words but a year, per text."""
    year, short = "(?:19|20)[0-9]{2}", "(?:19|20)[0-9]{2}|[0-9]{2}"
    long = "CASE WHEN length(y) = 4 THEN y WHEN y::INT <= 69 THEN (y::INT + 2000)::VARCHAR ELSE (y::INT + 1900)::VARCHAR END"

    def bound(pattern: str, y: int, part: str) -> str:
        values = f"regexp_extract_all(sq, '{pattern}', {y})"
        parts = part if part.startswith("'") else f"regexp_extract_all(sq, '{pattern}', {part[1]})[i]"
        return f"list_transform({values}, lambda y, i: {long} || '-' || " + (part if part.startswith("'") else f"'{part[0]}' || {parts}") + ")"

    found = [
        bound(f"(?i)(?:^|[^0-9])({short})年?Q([1-4])", 1, "Q2"),
        bound(f"(?i)Q([1-4])({short})(?:[^0-9]|$)", 2, "Q1"),
        bound(f"(?i)(?:^|[^0-9])({short})年?H([12])", 1, "H2"),
        bound(f"(?i)(?:^|[^0-9])({short})E(?:[^A-Za-z]|$)", 1, "'FY'"),
    ]
    free = "list_concat(list_transform(regexp_extract_all(sq, '(?i)Q([1-4])', 1), lambda p: '-Q' || p), list_transform(regexp_extract_all(sq, '(?i)H([12])', 1), lambda p: '-H' || p))"
    dims = {"rate": "率|比例|占比|比重|百分比|百分点|[%％]", "per_share": "(?i)(?:^|[^A-Za-z])EPS(?:$|[^A-Za-z])", "power": "(?i)(?:^|[^A-Za-z])(?:kW|MW|GW)(?:$|[^A-Za-z])", "energy": "(?i)(?:^|[^A-Za-z])(?:kWh|MWh|GWh)(?:$|[^A-Za-z])"}
    kinds = ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for n, p in dims.items())
    return f"""(SELECT {key}, CASE WHEN len(years) = 1 THEN CASE WHEN len(bd) + len(fr) > 0 THEN list_concat(bd, list_transform(fr, lambda p: years[1] || p)) ELSE [years[1] || '-YEAR'] END
  WHEN len(years) = 0 AND len(bd) = 0 THEN list_transform(fr, lambda p: 'ANY' || p) ELSE bd END AS time,
 CASE WHEN regexp_matches(x, '(?i)(?:^|[^0-9])(?:{short})E(?:$|[^A-Za-z])') THEN ['forecast'] ELSE [] END AS status, list_filter([{kinds}], lambda d: d IS NOT NULL) AS dims
 FROM (SELECT *, list_distinct(regexp_extract_all(regexp_replace(x, '[^0-9]+', '  ', 'g'), '(?:^| )({year})(?: |$)', 1)) AS years, flatten([{', '.join(found)}]) AS bd, {free} AS fr
 FROM (SELECT {key}, x, regexp_replace(x, '\\s+', '', 'g') AS sq FROM (SELECT {key}, {half_sql(f"coalesce({text}, '')")} AS x FROM {source}))))"""


FITS = "len(list_filter(f.time, lambda a: len(list_filter(h.time, lambda b: (split_part(a, '-', 1) = split_part(b, '-', 1) OR a LIKE 'ANY-%' OR b LIKE 'ANY-%') AND (split_part(a, '-', 2) = split_part(b, '-', 2) OR a LIKE '%-YEAR'))) > 0)) > 0"
BARE = "len(list_filter(f.time, lambda a: len(list_filter(h.time, lambda b: split_part(a, '-', 1) = split_part(b, '-', 1) AND b LIKE '%-YEAR')) > 0)) > 0"


def against(name: str) -> str:
    return f"CASE WHEN len(f.{name}) > 0 AND len(h.{name}) > 0 AND NOT list_has_any(f.{name}, h.{name}) THEN 1 ELSE 0 END"


def field_sql(name: str, tokens: str) -> str:
    """Scores ``s_<name>`` of one token field of the chunks ``ck``: words and neighbouring pairs."""
    return f"""f_{name} AS (SELECT chunk_id, {tokens} AS t FROM ck),
p_{name} AS (SELECT chunk_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM f_{name}) GROUP BY chunk_id, term),
d_{name} AS (SELECT term, sum(tf)::BIGINT AS freq, count(*) AS df FROM p_{name} GROUP BY term),
z_{name} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM f_{name})"""


def score_sql(name: str, boost: float) -> str:
    return f"""s_{name} AS (SELECT query_id, chunk_id, {boost}::DOUBLE * sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score, list(grp) AS grps FROM terms JOIN p_{name} USING (term) JOIN d_{name} USING (term), z_{name} GROUP BY query_id, chunk_id)"""


#: A query is named by its question and branch, as 2 q for the question itself and 2 q + 1 for its expansion.
HYBRID = rf"""ck AS (SELECT doc_id AS chunk_id, doc_id, source AS kb_id, text, source || ' ' || ({FIRST_YEAR} + doc_id % 5) || '年' AS title, CASE WHEN doc_id % 4 = 0 THEN 'table ' || source || ' ' || doc_id // 40 ELSE 'chunk ' || doc_id END AS identity
 FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(1 - toxic < 1, false)),
qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN {picked_sql('item_id', (*OTHER_QUESTIONS, RELAXED))} WHEN item_id % 3 = 1 THEN text || ' 2022年' ELSE text END AS text FROM benchmark),
al(canonical, alias, ord, narrower) AS (VALUES {values(ALIASES)}),
ex AS (SELECT query_id, string_agg(alias, ' ' ORDER BY ord, alias) AS names FROM (SELECT query_id, alias, ord FROM (SELECT query_id, alias, min(ord) AS ord FROM qs, al WHERE contains(lower(text), canonical) AND NOT contains(lower(text), alias) AND NOT coalesce(contains(lower(text), narrower), false) GROUP BY query_id, alias) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord, alias) <= 8) GROUP BY query_id),
both_texts AS (SELECT 2 * query_id AS query_id, text FROM qs UNION ALL SELECT 2 * query_id + 1, text || ' ' || names FROM qs JOIN ex USING (query_id)),
{SYN}, {field_sql('tokens', TOKENS)}, stats AS (SELECT * FROM d_tokens), {field_sql('title', TOKENS.replace('text', 'title'))},
{question_sql('both_texts')},
{score_sql('tokens', 2.0)}, {score_sql('title', 10.0)},
hit AS (SELECT query_id, chunk_id, max(score) AS score, len(list_distinct(flatten(list(grps)))) AS held FROM (SELECT * FROM s_tokens UNION ALL SELECT * FROM s_title) GROUP BY ALL),
need AS (SELECT query_id, count(DISTINCT grp) AS groups FROM terms WHERE NOT latin GROUP BY query_id),
sized AS (SELECT h.*, coalesce(groups, 0) AS groups FROM hit h LEFT JOIN need USING (query_id)),
strict AS (SELECT * FROM sized WHERE held >= floor(0.3 * groups)),
matched AS (SELECT * FROM strict UNION ALL SELECT * FROM sized WHERE query_id NOT IN (SELECT query_id FROM strict) AND held >= floor(0.1 * groups)),
kwd AS (SELECT query_id // 2 AS query_id, CASE WHEN query_id % 2 = 0 THEN 'keyword_original' ELSE 'keyword_expanded' END AS branch, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM matched QUALIFY rank <= 100),
vec AS (SELECT query_id, 'vector_original' AS branch, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
 FROM (SELECT query_id, chunk_id, {COSINE} AS score FROM qs JOIN embeddings a ON a.vec_id = query_id, ck JOIN embeddings b ON b.vec_id = chunk_id) WHERE score >= 0.1 QUALIFY rank <= 100),
lists AS (SELECT * FROM kwd UNION ALL SELECT * FROM vec),
live AS (SELECT query_id, count(DISTINCT branch) FILTER (branch LIKE 'key%') AS k, count(DISTINCT branch) FILTER (branch LIKE 'vec%') AS v FROM lists GROUP BY query_id),
fz AS (SELECT query_id, chunk_id, sum(CASE WHEN branch LIKE 'vec%' THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.6 END ELSE CASE WHEN v = 0 THEN 1.0 ELSE 0.4 END / k END::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank, max(CASE WHEN branch LIKE 'key%' THEN l.score END) AS keyword, max(CASE WHEN branch LIKE 'vec%' THEN l.score END) AS vector
 FROM lists l JOIN live USING (query_id) GROUP BY query_id, chunk_id),
ranked AS (SELECT fz.*, identity, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, fz.chunk_id) AS rank FROM fz JOIN ck ON ck.chunk_id = fz.chunk_id),
i1 AS (SELECT *, min(rank) OVER (PARTITION BY query_id, identity) AS fr FROM ranked), i2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY fr) AS number FROM i1),
cut AS (SELECT *, max(CASE WHEN number = 20 THEN fr END) OVER (PARTITION BY query_id) AS last FROM i2 QUALIFY last IS NULL OR rank <= last),
own AS (SELECT query_id // 2 AS query_id, term, sum(weight) AS weight FROM gw WHERE query_id % 2 = 0 GROUP BY ALL),
sim AS (SELECT o.query_id, p.chunk_id, round(sum(weight) / any_value(total), 9) AS semantic FROM own o JOIN p_tokens p USING (term) JOIN (SELECT query_id, sum(weight) AS total FROM own GROUP BY 1) USING (query_id) GROUP BY o.query_id, p.chunk_id),
fq AS (SELECT * FROM {facts_sql('text', 'qs', 'query_id')}), fc AS (SELECT * FROM {facts_sql("concat_ws(chr(10), title, text)", '(SELECT * FROM ck WHERE chunk_id IN (SELECT chunk_id FROM cut))', 'chunk_id')}),
cs AS (SELECT cut.*, semantic, CASE WHEN len(f.time) > 0 AND len(h.time) > 0 AND NOT ({FITS}) AND NOT ({BARE}) THEN 1 ELSE 0 END + {against('status')} + {against('dims')} AS conflicts
 FROM cut LEFT JOIN sim ON sim.query_id = cut.query_id AND sim.chunk_id = cut.chunk_id JOIN fq f ON f.query_id = cut.query_id JOIN fc h ON h.chunk_id = cut.chunk_id),
rs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC NULLS LAST, round(score, 12) DESC, chunk_id) AS sr, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS cr FROM cs),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conflicts, round(0.7::DOUBLE / (10 + sr) + 0.3::DOUBLE / (10 + cr), 12) DESC, semantic DESC NULLS LAST, round(score, 12) DESC, chunk_id) AS final_rank FROM rs),
j1 AS (SELECT *, min(final_rank) OVER (PARTITION BY query_id, identity) AS ff FROM fr), j2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY ff) AS place FROM j1),
page AS (SELECT *, max(CASE WHEN place = 5 THEN ff END) OVER (PARTITION BY query_id) AS stop FROM j2 QUALIFY stop IS NULL OR final_rank <= stop)
SELECT query_id, p.chunk_id, final_rank::INT AS final_rank, round(semantic, 6) AS semantic, conflicts::INT AS conflicts, round(keyword, 6) AS keyword, round(vector, 6) AS vector, count(*) OVER (PARTITION BY query_id, p.chunk_id) AS doc_hits FROM page p"""


def hybrid_search(t: Tables, **changes) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    options = hybrid.Options(available=1, fields={"tokens": 2.0, "title_tokens": 10.0}, **changes)
    aliases = t.spark.createDataFrame(ALIASES, "canonical string, alias string, ord int, narrower string")
    pairs = t.spark.createDataFrame(OTHER_SYNONYMS, "term string, synonym string")
    return hybrid.search(hybrid_questions(t), hybrid_chunks(t), vectors, options, aliases=aliases, synonyms=pairs)


@query("r17_hybrid_search", f"WITH {HYBRID}")
def r17(t):
    found = hybrid_search(t)
    keyword = F.greatest(F.try_element_at("branch_scores", F.lit("keyword_original")), F.try_element_at("branch_scores", F.lit("keyword_expanded")))
    shown = {"keyword": F.round(keyword, 6), "vector": F.round(F.try_element_at("branch_scores", F.lit("vector_original")), 6)}
    return found.withColumns(shown).select("query_id", "chunk_id", "final_rank", r6("semantic"), "conflicts", "keyword", "vector", "doc_hits")


@query("r18_shape_results", f"""WITH {FINAL} SELECT query_id, final_rank::INT AS rank, '{{"chunk_id":' || chunk_id || ',"conflicts":' || conflicts || '}}' AS record FROM fin WHERE final_rank <= 5""")
def r18(t):
    return R.shape_results(R.final_rank(candidates(t)).select("query_id", F.col("final_rank").alias("rank"), "chunk_id", "conflicts"))


@query("r19_multi_index", "SELECT kb_id, count(*) AS n, count(label) AS n_vectors FROM (SELECT source AS kb_id, NULL AS label FROM documents UNION ALL SELECT 'vectors', label FROM embeddings) GROUP BY kb_id")
def r19(t):
    both = R.multi_index([t.documents.select(F.col("source").alias("kb_id")), t.embeddings.select(F.lit("vectors").alias("kb_id"), "label")])
    return both.groupBy("kb_id").agg(F.count("*").alias("n"), F.count("label").alias("n_vectors"))


@query("r20_dedupe_requests", "SELECT role, count(*) AS n_requests, count(DISTINCT text) AS n_runs FROM conversations GROUP BY role")
def r20(t):
    once, keyed = R.dedupe_requests(t.conversations, ["role", "text"])
    return keyed.join(once.withColumn("run", F.lit(1)).select("request_key", "run"), "request_key").groupBy("role").agg(F.sum("run").alias("n_requests"), F.countDistinct("request_key").alias("n_runs"))


@query("r21_validate_bindings", "SELECT doc_id AS binding_id, length(trim(left(text, 20))) BETWEEN 1 AND 80 AND doc_id % 4 <> 0 AS valid FROM documents")
def r21(t):
    value = F.when(F.col("doc_id") % 4 == 0, F.lit("absent value 0x")).otherwise(F.left("text", F.lit(20)))
    b = t.documents.select(F.col("doc_id").alias("binding_id"), F.col("doc_id").alias("chunk_id"), value.alias("value"), F.left("text", F.lit(60)).alias("quote"))
    return R.validate_bindings(b, chunks(t)).select("binding_id", "valid")


@query("r22_fill_templates", "SELECT n_nationkey AS task_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'news of ' || n_name END AS query, n_nationkey % 5 = 0 AS blocked, n_regionkey AS doc_scope FROM nation")
def r22(t):
    tasks = t.nation.select(F.col("n_nationkey").alias("task_id"), F.when(F.col("n_nationkey") % 5 == 0, "{other} of {name}").otherwise("news of {name}").alias("template"))
    return R.fill_templates(tasks, t.nation.select(F.col("n_nationkey").alias("task_id"), F.lit("name").alias("slot"), F.col("n_name").alias("value"), F.col("n_regionkey").alias("doc_id")))


def hops(t: Tables) -> DataFrame:
    """Orders of a customer as the hits of hops, one hop per priority."""
    ranked = t.orders.withColumn("hop_rank", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return ranked.select(F.col("o_custkey").alias("question_id"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("hop"), "hop_rank", (F.col("o_orderkey") % 97).alias("chunk_id"), F.col("o_totalprice").cast("double").alias("score"), (F.col("o_orderkey") % 13 == 0).cast("int").alias("conflicts"), (F.col("o_orderstatus") == "F").alias("is_bridge"))


HOPS = "hops AS (SELECT o_custkey AS question_id, left(o_orderpriority, 1)::INT AS hop, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS hop_rank, o_orderkey % 97 AS chunk_id, o_totalprice::DOUBLE AS score, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS conflicts, o_orderstatus = 'F' AS is_bridge FROM orders)"


@query("r23_merge_hops", f"""WITH {HOPS}, m AS (SELECT *, row_number() OVER (PARTITION BY question_id, hop ORDER BY is_bridge DESC, hop_rank, chunk_id) = 1 AS reserved FROM hops),
g AS (SELECT question_id, chunk_id, max(score) AS score, min(conflicts) AS conflicts, max(reserved::INT) AS reserved FROM m GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY reserved DESC, conflicts, score DESC, chunk_id) AS claim FROM g)
SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN claim <= 5 THEN 0 ELSE 1 END, conflicts, score DESC, chunk_id)::INT AS rank, reserved = 1 AND claim <= 5 AS reserved FROM c""")
def r23(t):
    return R.merge_hops(hops(t)).select("question_id", "chunk_id", "rank", "reserved")


@query("r24_hop_fallback_rank", f"""WITH {HOPS}, f AS (SELECT question_id, hop, chunk_id, min(hop_rank) AS r FROM hops GROUP BY ALL), s AS (SELECT question_id AS query_id, chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score, min(r) AS best_rank FROM f GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, chunk_id)::INT AS rank FROM s""")
def r24(t):
    return R.hop_fallback_rank(hops(t)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")
