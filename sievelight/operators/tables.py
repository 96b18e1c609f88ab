"""The table model: HTML grids, bound rows, row chunks, and rows around search hits."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import token_count

GRID = "table_id long, caption string, row_index int, col_index int, text string, is_header boolean, full_width boolean"
ROW = "array<struct<row_index:int,context:string,preamble:string,headers:array<string>,cells:array<string>>>"
MAX_SPAN = 256
#: First headings that make a two-column table a table of rows (fixed values).
ROW_HEADINGS = ("指标", "项目", "类别", "名称", "年度", "年份", "时间", "季度", "产品", "业务", "地区", "序号", "公司", "企业", "股东", "参数", "item", "metric", "name", "year", "date", "category", "parameter")
GROWTH = r"^(?:[（(]?\+/?[-−]%[）)]?|同比|同比增速|增速|增长率)$"
NUMERIC = r"^[(（]?[+-]?[0-9][0-9,]*(?:\.[0-9]+)?[)）]?(?:%|倍|x|元|万元|亿元)?$"
YEAR_LABEL = r"^(?:19|20)[0-9]{2}(?:年|[AE])?$"


def _cells(source: str):
    """(caption, rows of (text, header, rowspan, colspan)); None for nested tables or unusable spans."""
    if len(re.findall(r"(?i)<table\b", source)) != 1:
        return None
    caption = re.search(r"(?is)<caption[^>]*>(.*?)</caption>", source)
    clean = lambda s: " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", " ", s))).split())
    rows = []
    for body in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|$)", source):
        row = []
        for tag, attrs, text in re.findall(r"(?is)<(t[hd])\b([^>]*)>(.*?)(?=</t[hd]>|<t[hd]\b|$)", body):
            spans = [int(m.group(1)) if (m := re.search(rf'(?i){n}\s*=\s*"?(\d+)', attrs)) else 1 for n in ("rowspan", "colspan")]
            if not all(1 <= s <= MAX_SPAN for s in spans):
                return None
            row.append((clean(text), tag.lower() == "th", *spans))
        if row:
            rows.append(row)
    return clean(caption.group(1)) if caption else "", rows


def html_table_grid(tables: DataFrame) -> DataFrame:
    """Cells of ``tables(table_id, html)`` with spans expanded to a rectangle; a table with nested, overlapping or oversized spans gives none."""

    def expand(parts):
        for pdf in parts:
            out = []
            for table_id, source in zip(pdf["table_id"], pdf["html"], strict=True):
                parsed = _cells(source or "")
                if not parsed:
                    continue
                caption, rows = parsed
                taken: dict[tuple[int, int], tuple] = {}
                valid = True
                for r, row in enumerate(rows):
                    c = 0
                    for text, header, down, right in row:
                        while (r, c) in taken:
                            c += 1
                        places = [(r + i, c + j) for i in range(down) for j in range(right)]
                        valid = valid and r + down <= len(rows) and c + right <= MAX_SPAN and not any(p in taken for p in places)
                        taken.update(dict.fromkeys(places, (text, header, len(row) == 1)))
                        c += right
                if valid and taken:
                    width = max(c for _, c in taken) + 1
                    blank = ("", False, False)
                    out += [(table_id, caption, r, c, *(taken.get((r, c)) or blank)) for r in range(len(rows)) for c in range(width)]
            yield pd.DataFrame(out, columns=["table_id", "caption", "row_index", "col_index", "text", "is_header", "full_width"])

    return tables.select("table_id", "html").mapInPandas(expand, GRID)


def bind_table_rows(grid: DataFrame) -> DataFrame:
    """(table_id, caption, row_index, context, preamble, headers, cells): data rows bound to their header paths.

    Rows of headings open a header block (``a / b`` over several levels); a
    full-width row is context; a growth row carries the label of the row before.
    Tables without headings bind nothing.
    """
    one = grid.groupBy("table_id", "row_index").agg(
        F.first("caption").alias("caption"), F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"]).alias("cells"), F.bool_and("is_header").alias("th"), F.bool_or("full_width").alias("full")
    )
    width = F.size("cells")
    first = F.get("cells", F.lit(0))
    has_values = F.exists("cells", lambda x: F.replace(x, F.lit(" "), F.lit("")).rlike(NUMERIC) & ~x.rlike(YEAR_LABEL))
    order = Window.partitionBy("table_id").orderBy("row_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = one.withColumn("section", F.col("full") & (width > 1)).withColumn("plain_head", ~F.col("section") & F.col("th") & ~has_values)
    rows = rows.withColumn("opening", ~F.col("section") & ~has_values & ~F.coalesce(F.max(F.col("plain_head") | (~F.col("section") & has_values)).over(before), F.lit(False)) & ~F.coalesce(F.max(~F.col("section") & ~F.col("plain_head")).over(before), F.lit(False)))
    rows = rows.withColumn("head", F.col("plain_head") | F.col("opening"))
    rows = rows.withColumn("starts", (F.col("head") & ~F.coalesce(F.lag("head").over(order), F.lit(False))).cast("int")).withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paths = rows.filter("head").groupBy("table_id", "block").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("levels"))
    rows = rows.withColumn("unit", F.last(F.when(F.col("section"), first), True).over(before)).withColumn("label", F.when(~F.col("section") & ~F.col("head") & ~first.rlike(GROWTH), first)).withColumn("previous", F.last("label", True).over(before))
    narrow = rows.filter("head and starts = 1").groupBy("table_id").agg(F.min_by(F.size("cells"), "row_index").alias("w"), F.min_by(F.lower(F.regexp_replace(first, r"[\s：:]", "")), "row_index").alias("heading"))
    bad = narrow.filter((F.col("w") == 2) & ~F.col("heading").isin(*ROW_HEADINGS)).select("table_id")
    data = rows.filter("not head and not section").join(paths, ["table_id", "block"]).join(bad, "table_id", "left_anti").filter(F.exists("cells", lambda x: x != ""))

    def path(c: Column, i: Column) -> Column:
        texts = F.filter(F.transform(F.col("levels"), lambda lv: F.get(lv["cells"], i)), lambda x: x != "")
        label = F.array_join(F.filter(texts, lambda x, k: (k == 0) | (x != F.get(texts, k - 1))), " / ")
        return F.when(label == "", F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列（无表头）"))).otherwise(label)

    headers = F.transform("cells", path)
    preamble = F.when(first.rlike(GROWTH) & F.col("previous").isNotNull(), F.concat(F.lit("上一数据行指标："), "previous")).otherwise("")
    return data.select("table_id", "caption", (F.col("row_index") + 1).alias("row_index"), F.coalesce("unit", F.lit("")).alias("context"), preamble.alias("preamble"), headers.alias("headers"), "cells")


def _title(*parts: str) -> Column:
    return F.concat_ws("；", *[F.when(F.col(p) != "", F.col(p)) for p in parts])


def table_row_chunks(rows: DataFrame) -> DataFrame:
    """(table_id, row_index, semantic_text): title, preamble and header：cell pairs of every bound row."""
    pairs = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(h, F.lit("："), F.when(c == "", F.lit("（空白）")).otherwise(c))), "；")
    good = rows.filter((F.size("headers") > 0) & (F.size("headers") == F.size("cells"))).withColumn("title", _title("caption", "context"))
    return good.select("table_id", "row_index", F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.when(F.col("preamble") != "", F.col("preamble")), pairs).alias("semantic_text"))


def _line(cells: Column) -> Column:
    cell = lambda v: F.when(F.coalesce(v, F.lit("")) == "", F.lit("（空白）")).otherwise(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def table_markdown(rows: DataFrame) -> DataFrame:
    """(table_id, markdown): rows in order; a new heading wherever headers or context change."""
    order = Window.partitionBy("table_id").orderBy("row_index")
    changed = F.coalesce((F.col("headers") != F.lag("headers").over(order)) | (F.col("context") != F.lag("context").over(order)), F.lit(True))
    first = F.row_number().over(order) == 1
    marked = rows.withColumn("changed", changed).withColumn("first", first)
    head = F.concat_ws("\n", F.when(~F.col("first"), F.lit("")), F.when(F.col("context") != "", F.concat(F.lit("#### "), "context")), _line(F.col("headers")), F.concat(F.lit("| "), F.array_join(F.transform("headers", lambda h: F.lit("---")), " | "), F.lit(" |")))
    lines = marked.withColumn("line", F.concat_ws("\n", F.when(F.col("changed"), head), _line(F.col("cells"))))
    joined = lines.groupBy("table_id").agg(F.first("caption").alias("caption"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return joined.select("table_id", F.concat_ws("\n", F.when(F.col("caption") != "", F.concat(F.lit("### "), "caption")), "body").alias("markdown"))


def table_summary(rows: DataFrame, shown: int = 40) -> DataFrame:
    """(table_id, summary): caption, number of rows, and the first different headers."""
    grouped = rows.groupBy("table_id").agg(F.first("caption").alias("caption"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "headers"))), lambda x: x["headers"]))).alias("fields"))
    fields = F.slice(F.filter("fields", lambda h: h != ""), 1, shown)
    return grouped.select("table_id", F.concat_ws("；", F.concat(F.lit("表格："), F.when(F.col("caption") != "", F.col("caption")).otherwise("未命名表格")), F.concat(F.lit("共"), F.col("n").cast("string"), F.lit("个数据行")), F.when(F.size(fields) > 0, F.concat(F.lit("字段："), F.array_join(fields, "、")))).alias("summary"))


# Rows around hits: hits(query_id, table_id, row_index, rank, scored, selected), tables' rows(table_id, row_index, context, headers, cells).


def group_table_rows(ranked: DataFrame) -> DataFrame:
    """(query_id, group_id, rank, members, omitted): selected rows of one table as one candidate, at its best rank."""
    rows = F.array_sort(F.collect_set(F.when(F.col("selected"), F.col("row_index"))))
    scored = F.array_sort(F.collect_set(F.when(F.col("scored"), F.col("row_index"))))
    grouped = ranked.groupBy("query_id", "table_id").agg(F.min(F.when(F.col("selected"), F.col("rank"))).alias("rank"), rows.alias("members"), scored.alias("scored_rows")).filter(F.size("members") > 0)
    ident = F.sha2(F.concat_ws(":", F.col("table_id").cast("string"), F.array_join(F.col("members").cast("array<string>"), ",")), 256)
    return grouped.select("query_id", "table_id", ident.alias("group_id"), "rank", "members", F.array_except("scored_rows", "members").alias("omitted"))


def table_row_window(hits: DataFrame, rows: DataFrame, small: int = 5, radius: int = 2) -> DataFrame:
    """(query_id, table_id, row_index, distance): the whole of a small table, else the hit's section, else ``radius`` rows around; scored rows that were not selected stay out."""
    per = Window.partitionBy("table_id")
    placed = rows.withColumn("pos", F.row_number().over(per.orderBy("row_index"))).withColumn("n", F.count("*").over(per)).select("table_id", F.col("row_index").alias("r"), "pos", "n", F.coalesce("context", F.lit("")).alias("ctx"))
    hit = hits.filter("selected").join(placed, (hits["table_id"] == placed["table_id"]) & (hits["row_index"] == F.col("r"))).select("query_id", hits["table_id"], F.col("pos").alias("hit_pos"), F.col("ctx").alias("hit_ctx"))
    around = hit.join(placed, "table_id").filter((F.col("n") <= small) | F.when(F.col("hit_ctx") != "", F.col("ctx") == F.col("hit_ctx")).otherwise(F.abs(F.col("pos") - F.col("hit_pos")) <= radius))
    near = around.groupBy("query_id", "table_id", F.col("r").alias("row_index")).agg(F.min(F.abs(F.col("pos") - F.col("hit_pos"))).alias("distance"))
    dropped = hits.filter("scored and not selected").select("query_id", "table_id", "row_index").distinct()
    return near.join(dropped, ["query_id", "table_id", "row_index"], "left_anti")


def table_column_window(rows: DataFrame, questions: DataFrame, most: int = 8) -> DataFrame:
    """``rows(query_id, …, headers, cells)`` with column 0 and a window around the first header that the question names."""
    joined = rows.join(questions.select("query_id", F.col("text").alias("_q")), "query_id")
    named = F.filter(F.transform("headers", lambda h, i: F.when((i > 0) & (h != "") & F.contains(F.lower("_q"), F.lower(h)), i)), lambda x: x.isNotNull())
    centre = F.coalesce(F.get(named, F.lit(0)), F.lit(1))
    n, room = F.size("headers"), most - 1
    left = F.greatest(F.lit(1), F.least(centre - room // 2, n - room))
    cut = lambda c: F.when(n <= most, F.col(c)).otherwise(F.concat(F.slice(c, F.lit(1), F.lit(1)), F.slice(c, left + 1, F.lit(room))))
    return joined.withColumn("_h", cut("headers")).withColumn("cells", cut("cells")).withColumn("headers", F.col("_h")).drop("_h", "_q")


def fit_rows_to_budget(rows: DataFrame, budget: int = 512) -> DataFrame:
    """Rows of ``rows(query_id, table_id, row_index, distance, rank, text)`` that fit: hits by rank, then the nearest neighbours; the best hit always stays."""
    order = Window.partitionBy("query_id", "table_id").orderBy(F.when(F.col("distance") == 0, 0).otherwise(1), F.asc_nulls_last("rank"), "distance", "row_index")
    used = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = rows.withColumn("n_tokens", token_count(F.col("text"))).withColumn("used", used).withColumn("priority", F.row_number().over(order))
    return sized.filter((F.col("used") <= budget) | (F.col("priority") == 1)).drop("used", "priority")


def expand_tables(hits: DataFrame, rows: DataFrame, questions: DataFrame, budget: int = 512) -> tuple[DataFrame, DataFrame]:
    """(rows shown per query and table, hits that the budget left out): window, columns and budget together."""
    near = table_row_window(hits, rows).join(rows, ["table_id", "row_index"])
    cut = table_column_window(near, questions)
    text = F.array_join(F.zip_with("headers", "cells", lambda h, c: F.concat(h, F.lit("："), c)), "；")
    ranked = cut.withColumn("text", text).join(hits.filter("selected").groupBy("query_id", "table_id", "row_index").agg(F.min("rank").alias("rank")), ["query_id", "table_id", "row_index"], "left")
    shown = fit_rows_to_budget(ranked, budget)
    lost = hits.filter("selected").join(shown.select("query_id", "table_id", "row_index"), ["query_id", "table_id", "row_index"], "left_anti")
    return shown, lost


def recover_rows(refs: DataFrame, recovery: DataFrame, most: int = 4096) -> DataFrame:
    """(ref, text): the one grounded row of a reference; ambiguous versions give none, long rows are cut."""
    one = recovery.groupBy("ref").agg(F.countDistinct("version").alias("versions"), F.min("text").alias("text")).filter("versions = 1")
    return refs.join(one, "ref", "left").select("ref", F.left("text", F.lit(most * 4)).alias("text"))
