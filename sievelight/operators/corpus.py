"""Corpus preparation: pages, Markdown, JSON and rows to sections and token-budgeted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import fine_tokens, token_count, tokenize

DELIMITERS = "\n!?;。；！？"
#: Numbering schemes of outlines by level (fixed values).
SCHEMES = [
    [r"第[零一二三四五六七八九十百0-9]+(分?编|部分)", r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"第[零一二三四五六七八九十百0-9]+条", r"[\(（][零一二三四五六七八九十百]+[\)）]"],
    [r"第[0-9]+章", r"第[0-9]+节", r"[0-9]{0,2}[\. 、]", r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}", r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}"],
    [r"第[零一二三四五六七八九十百0-9]+章", r"第[零一二三四五六七八九十百0-9]+节", r"[零一二三四五六七八九十百]+[ 、]", r"[\(（][零一二三四五六七八九十百]+[\)）]", r"[\(（][0-9]{0,2}[\)）]"],
    [r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)", r"Chapter (I+V?|VI*|XI|IX|X)", r"Section [0-9]+", r"Article [0-9]+"],
]
#: Beginnings that are no outline number (fixed values).
NOT_OUTLINE = (
    r"0",
    r"[0-9]+ +[0-9~个只-]",
    r"[0-9]+\.{2,}",
)
#: Cell types by pattern, first match wins (fixed values).
CELL_TYPES = (
    ("Dt", r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$"),
    ("Dt", r"^(20|19)[0-9]{2}年$"),
    ("Dt", r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}月*$"),
    ("Dt", r"^[0-9]{1,2}[月/-][0-9]{1,2}日*$"),
    ("Dt", r"^第*[一二三四1-4]季度$"),
    ("Dt", r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$"),
    ("DT", r"^(20|19)[0-9]{2}[ABCDE]$"),
    ("Nu", r"^[0-9.,+%/ -]+$"),
    ("Ca", r"^[0-9A-Z/\._~-]+$"),
    ("En", r"^[A-Z]*[a-z' -]+$"),
    ("NE", r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$"),
    ("Sg", r"^.{1}$"),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Main text of a page: title, then article, main or body without scripts, navigation and markup; a line per block."""
    page = F.coalesce(html, F.lit(""))
    title = F.regexp_extract(page, r"(?is)<title[^>]*>([^<]*)</title>", 1)
    body = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</\1>|<head\b.*?</head>", "")
    main = F.regexp_extract(body, r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", 2)
    text = F.regexp_replace(F.when(main != "", main).otherwise(body), r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?section|/?article|/?blockquote)\b[^>]*>", "\n")
    text = F.concat(title, F.lit("\n"), F.regexp_replace(text, r"<[^>]*>", ""))
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, text): the non-empty lines of the main text."""
    lines = F.filter(F.transform(F.split(html_text(F.col("html")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select(key, F.posexplode(lines).alias("pos", "text"))


def segments(text: Column, delimiters: str = DELIMITERS) -> Column:
    """Pieces of a text in order, delimiters as pieces of their own."""
    chars = "".join("\\" + c if c in r"\.[]{}()*+?^$|-&" else c for c in delimiters)
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"([{chars}])", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def split_segments(df: DataFrame, key: str = "doc_id", delimiters: str = DELIMITERS) -> DataFrame:
    return df.select(key, F.posexplode(segments(F.col("text"), delimiters)).alias("pos", "segment"))


def packed(pieces: Column, size, budget: int, cut) -> Column:
    """Pieces joined into blocks: ``cut(held, own)`` says when a piece of size ``own`` opens a new block after ``held``."""
    state = "struct<done:array<string>,open:string,held:bigint>"

    def step(a, p):
        own = size(p).cast("bigint")
        fresh = F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), p.alias("open"), own.alias("held"))
        joined = F.struct(a["done"].alias("done"), F.concat(a["open"], p).alias("open"), (a["held"] + own).alias("held"))
        return F.when(cut(a["held"], own) & (a["open"] != ""), fresh).otherwise(joined).cast(state)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("bigint").alias("held")).cast(state)
    return F.filter(F.aggregate(pieces, start, step, lambda a: F.concat(a["done"], F.array(a["open"]))), lambda x: F.trim(x) != "")


def chunk_by_budget(df: DataFrame, budget: int = 128, key: str = "doc_id", delimiters: str = DELIMITERS) -> DataFrame:
    """(key, seq, content): greedy chunks; a new one starts only when the current one already exceeds the budget."""
    blocks = packed(segments(F.col("text"), delimiters), token_count, budget, lambda held, own: held > budget)
    return df.select(key, F.posexplode(blocks).alias("seq", "content"))


def json_sections(df: DataFrame, column: str = "json", key: str = "doc_id", size: int = 200) -> DataFrame:
    """(key, pos, section): leaf paths packed into sections of at most about ``size`` characters; list elements are keyed by index."""
    nodes = df.select(F.col(key), F.parse_json(column).alias("v"), F.lit("").alias("path"))
    leaves = None
    while True:  # once per level of nesting
        opened = nodes.sparkSession.sql(f"SELECT n.{key}, e.value AS v, concat(n.path, '/', coalesce(e.key, CAST(e.pos AS STRING))) AS path FROM {{nodes}} n, LATERAL variant_explode(n.v) e", nodes=nodes)
        kind = F.schema_of_variant("v")
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        flat = opened.filter(~nested)
        leaves = flat if leaves is None else leaves.unionByName(flat)
        nodes = opened.filter(nested)
        if nodes.isEmpty():
            break
    line = F.concat("path", F.lit("="), F.to_json("v"), F.lit("\n"))
    ordered = leaves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("rows"))
    floor = max(size - 200, 50)
    blocks = packed(F.transform("rows", lambda r: r["line"]), lambda p: F.length(p), size, lambda held, own: (held + own > 2 * size) | (held >= floor))
    return ordered.select(key, F.posexplode(blocks).alias("pos", "section"))


def markdown_blocks(df: DataFrame, key: str = "doc_id", budget: int = 128) -> DataFrame:
    """(key, pos, block): lines, a heading glued to the next line, lines over three budgets halved."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = df.select(key, F.posexplode(lines).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    glued = F.coalesce(F.lag("line").over(order).startswith("#"), F.lit(False))
    blocks = rows.withColumn("new", (~glued).cast("int")).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = blocks.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    half = F.ceil(F.length("text") / 2).cast("int")
    parts = F.when(token_count(F.col("text")) > 3 * budget, F.array(F.left("text", half), F.substring("text", half + 1, F.length("text")))).otherwise(F.array("text"))
    return joined.select(key, "block", F.posexplode(parts).alias("part", "text"))


TABLE = r"(?m)(?:^\|.*\|[ \t]*$\n?){2,}|^[^|\n]+\|[^\n]*\n[ \t]*:?-{2,}:?[ \t]*\|[-:| \t]*\n(?:[^|\n]+\|[^\n]*\n?)*"


def markdown_tables(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tables, rest): bordered and borderless pipe tables, and the text without them."""
    return df.select(key, F.regexp_extract_all("text", F.lit(TABLE), F.lit(0)).alias("tables"), F.regexp_replace("text", TABLE, "").alias("rest"))


def rows_to_text(df: DataFrame, key: str, sheet: str | None = None) -> DataFrame:
    """(key, text): header：value pairs of the filled cells; the sheet's name follows unless it is a default one."""
    cells = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}："), F.col(c).cast("string"))) for c in df.columns if c != key]
    text = F.concat_ws("; ", *cells)
    if sheet and "sheet" not in sheet.lower():
        text = F.concat(text, F.lit(f" ——{sheet}"))
    return df.select(key, text.alias("text"))


def cell_type(c: Column) -> Column:
    words = F.size(F.filter(tokenize(c), lambda t: F.length(t) > 1))
    out = F.when(words > 3, F.when(words < 12, "Tx").otherwise("Lx")).otherwise("Ot")
    for name, pattern in reversed(CELL_TYPES):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def infer_header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row, type, header): ``cells(table_id, row, col, text)``; row 0 is a header, and in numeric tables each row of another majority type."""
    typed = cells.withColumn("type", cell_type(F.col("text")))
    major = typed.filter("row > 0").groupBy("table_id").agg(F.mode("type", True).alias("table_type"))
    rows = typed.groupBy("table_id", "row").agg(F.mode("type", True).alias("type"))
    return rows.join(major, "table_id", "left").select("table_id", "row", "type", ((F.col("row") == 0) | ((F.col("table_type") == "Nu") & (F.col("type") != "Nu"))).alias("header"))


def header_labels(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, row, col, text, label): data cells with the texts of the nearest contiguous header rows above."""
    order = Window.partitionBy("table_id").orderBy("row")
    marked = headers.withColumn("gap", F.col("header") & ~F.coalesce(F.lag("header").over(order), F.lit(False))).withColumn("block", F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = cells.join(marked.filter("header").select("table_id", "row", "block"), ["table_id", "row"])
    labels = texts.groupBy("table_id", "block", "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: F.trim(x["text"]))), ",").alias("label"))
    data = cells.join(marked.filter(~F.col("header")).select("table_id", "row", "block"), ["table_id", "row"])
    return data.join(labels, ["table_id", "block", "col"], "left").select("table_id", "row", "col", "text", "label")


def content_ids(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``doc_id`` from the name, ``chunk_id`` as a digest of name, place and content."""
    ident = F.to_json(F.struct(F.col(name).alias("name"), F.col("seq").alias("seq"), F.col(content).alias("content")))
    return df.withColumn("doc_hash", F.xxhash64(name)).withColumn("chunk_sha", F.sha2(ident, 256))


#: Tags of tables that are no words of a chunk (fixed value).
TABLE_TAGS = r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>"


def build_chunk_record(chunks: DataFrame, name: str = "name") -> DataFrame:
    """Chunks with coarse and finer tokens of their content, read without table tags, and of the file's stem; the content stays as it is."""
    words = tokenize(F.regexp_replace("content", TABLE_TAGS, " "))
    title = tokenize(F.regexp_replace(name, r"\.[A-Za-z]+$", ""))
    out = chunks.withColumn("tokens", words).withColumn("title_tokens", title)
    return out.withColumn("fine_tokens", fine_tokens(F.col("tokens"))).withColumn("title_fine_tokens", fine_tokens(F.col("title_tokens")))


def _starts(text: Column, pattern: str) -> Column:
    return text.rlike("^(?:" + pattern + ")") & ~text.rlike("^(?:" + "|".join(NOT_OUTLINE) + ")")


def outline_scheme(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scheme): the numbering scheme that most lines follow, the first of equals, -1 for none."""
    hits = [F.count_if(F.greatest(*[_starts(F.col("text"), p) for p in s])).alias(f"s{i}") for i, s in enumerate(SCHEMES)]
    counted = sections.groupBy(key).agg(*hits)
    most = F.greatest(*[F.col(f"s{i}") for i in range(len(SCHEMES))])
    scheme = F.lit(-1)
    for i in reversed(range(len(SCHEMES))):
        scheme = F.when((most > 0) & (F.col(f"s{i}") == most), i).otherwise(scheme)
    return counted.select(key, scheme.alias("scheme"))


def outline_levels(sections: DataFrame, schemes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, level): the first pattern of the document's scheme that a line starts with; one over the last for none."""
    joined = sections.join(schemes, key)
    level = F.lit(None).cast("int")
    for i, patterns in enumerate(SCHEMES):
        own = F.lit(len(patterns) + 1)
        for j in reversed(range(len(patterns))):
            own = F.when(_starts(F.trim("text"), patterns[j]), j).otherwise(own)
        level = F.when(F.col("scheme") == i, own).otherwise(level)
    return joined.withColumn("level", level).filter("scheme >= 0").select(key, "pos", "level")


def language_share(text: Column) -> Column:
    """(english, non_latin): over 80 % of the lines start with Latin letters; at least 70 % of the tokens are not Latin, or there are three at most."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    english = F.size(F.filter(lines, lambda x: x.rlike(r"^[ `a-zA-Z0-9,.:;'\"?<>!()\-]+$"))) > 0.8 * F.size(lines)
    tokens = F.split(F.coalesce(text, F.lit("")), "[ \t]+")
    other = F.size(F.filter(tokens, lambda x: ~x.rlike("^[a-zA-Z]+$")))
    return F.struct(english.alias("english"), ((F.size(tokens) <= 3) | (other >= 0.7 * F.size(tokens))).alias("non_latin"))


def session_chunks(df: DataFrame, key: str = "doc_id", cap: int = 4000, piece: int = 2000) -> DataFrame:
    """(key, seq, content): the first ``cap`` characters, whole if short, else packed paragraphs, long ones cut."""
    text = F.left("text", F.lit(cap))
    paragraphs = F.filter(F.split(text, r"\n"), lambda p: F.trim(p) != "")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / piece) - 1, F.lit(0))), lambda i: F.substring(F.concat(p, F.lit("\n")), i * piece + 1, F.when(i == F.ceil(F.length(p) / piece) - 1, F.lit(piece + 1)).otherwise(F.lit(piece))))))
    blocks = packed(cut, lambda p: F.length(p), piece, lambda held, own: held + own > piece)
    return df.select(key, F.posexplode(F.when(F.length(text) <= piece, F.array(text)).otherwise(blocks)).alias("seq", "content"))


def check_vectors(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``df`` with a ``problem`` (dimension, not finite, zero, not unit) and the normalised vector."""
    v = F.col(column)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull() | (F.size(v) != dim), "dimension").when(bad, "not_finite").when(norm == 0, "zero").when(F.abs(norm - 1) > 1e-3, "not_unit")
    return df.withColumn("norm", norm).withColumn("problem", problem).withColumn("unit", F.when(~bad & (norm > 0), F.transform(v, lambda x: (x / norm).cast("float"))))
