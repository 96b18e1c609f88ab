"""Evidence set algebra: merging, selecting, numbering and assessing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.sources.tables import by_key

from sievelight.functions.text import mixed_terms


def content_fingerprint(df: DataFrame, columns=("text", "source_kind", "document_id")) -> DataFrame:
    """``fp``: a digest of what the evidence says and where, not of rank or query."""
    return df.withColumn("fp", F.sha2(F.to_json(F.struct(*columns)), 256))


def merge_evidence(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, conflicts, traces) of ``parts(evidence_id, ord, fp, query, …)``: the first version of an id stays; another fingerprint is a conflict."""
    order = Window.partitionBy("evidence_id").orderBy("ord")
    items = parts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    versions = parts.groupBy("evidence_id").agg(F.array_sort(F.collect_set("fp")).alias("versions")).filter(F.size("versions") > 1)
    traces = parts.select("evidence_id", "query").distinct()
    return items, versions, traces


def select_by_ids(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """Items in the order asked for: ``requests(request_id, ids array)``; a repeated id counts once."""
    asked = requests.select("request_id", F.posexplode(F.array_distinct("ids")).alias("pos", "evidence_id"))
    return asked.join(evidence, "evidence_id")


def record_to_evidence(df: DataFrame) -> DataFrame:
    """Normalised columns; a missing id is derived from the content."""
    text = F.coalesce("content_with_weight", "text")
    ident = F.coalesce("chunk_id", F.concat(F.lit("ev-"), F.left(F.sha2(F.to_json(F.struct(F.col("doc_id").alias("d"), text.alias("t"))), 256), F.lit(16))))
    return df.select(ident.alias("evidence_id"), text.alias("text"), F.coalesce("evidence_type_kwd", F.lit("text")).alias("source_kind"), F.col("doc_id").alias("document_id"))


def evidence_to_record(df: DataFrame) -> DataFrame:
    return df.select(F.col("evidence_id").alias("chunk_id"), F.col("text").alias("content_with_weight"), F.col("source_kind").alias("evidence_type_kwd"), F.col("document_id").alias("doc_id"))


def grounded_rows(rows: DataFrame) -> DataFrame:
    """``rows(…, headers, cells, column_indices, original)`` with ``grounded``: equal lengths, unique indices in range, cells as in the original."""
    n = F.size("cells")
    indices = (F.size("column_indices") == n) & (F.size(F.array_distinct("column_indices")) == n) & F.forall("column_indices", lambda i: (i >= 0) & (i < F.size("original")))
    equal = F.forall(F.zip_with("cells", "column_indices", lambda c, i: c == F.get("original", i)), lambda x: F.coalesce(x, F.lit(False)))
    return rows.withColumn("grounded", F.coalesce((F.size("headers") == n) & indices & equal, F.lit(False)))


def source_notes(tables: DataFrame) -> DataFrame:
    """(table_id, notes): lines of the semantic text that rendering the caption and rows does not give."""
    return tables.select("table_id", F.array_except(F.filter(F.transform(F.split("semantic_text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "rendered").alias("notes"))


def _joined(df: DataFrame, *columns: str) -> Column:
    """Text of the columns that ``df`` has, arrays included, parted by blanks."""
    return F.concat_ws(" ", *[F.col(c) for c in columns if c in df.columns])


def _claims(rows: pa.Table) -> pa.Table:
    """Turns of one question: goal after goal takes its best item that none has taken."""
    queues: dict[int, list] = {}
    for goal, item in zip(rows["goal_no"].to_pylist(), rows["evidence_id"].to_pylist(), strict=True):
        queues.setdefault(goal, []).append(item)
    turns, taken = [iter(queues[goal]) for goal in sorted(queues)], {}
    items = set(rows["evidence_id"].to_pylist())
    while len(taken) < len(items):
        for queue in turns:
            if (item := next((x for x in queue if x not in taken), None)) is not None:
                taken[item] = len(taken)
    ids = pa.array(list(taken), rows["evidence_id"].type)
    question = rows["question_id"].combine_chunks().take(pa.array([0] * len(taken), pa.int64()))
    return pa.table({"question_id": question, "pos": pa.array(list(taken.values()), pa.int32()), "evidence_id": ids})


def goal_round_robin(goals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, pos, evidence_id): in every round each goal takes its best item that no goal has taken yet.

    ``goals(question_id, goal_no, text[, constraints])`` rank
    ``evidence(question_id, evidence_id, ord, text[, source_name, locator,
    queries])`` by common terms of all these columns, ties by ``ord``.  Questions
    without goals keep the order.  A turn depends on all earlier ones, so the
    ranks of one question, its retrieved candidates, meet in one task.
    """
    g = goals.select("question_id", "goal_no", mixed_terms(_joined(goals, "text", "constraints")).alias("gt"))
    e = evidence.select("question_id", "evidence_id", "ord", mixed_terms(_joined(evidence, "text", "source_name", "locator", "queries")).alias("et"))
    e = e.groupBy("question_id", "evidence_id").agg(F.min_by(F.struct("ord", "et"), "ord").alias("e")).select("question_id", "evidence_id", "e.*")
    ranked = g.join(e, "question_id").select("question_id", "goal_no", "evidence_id", "ord", F.size(F.array_intersect("gt", "et")).alias("overlap"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "goal_no").orderBy(F.desc("overlap"), "ord", "evidence_id")))
    types = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = f"question_id {types['question_id']}, pos int, evidence_id {types['evidence_id']}"
    claimed = ranked.select("question_id", "goal_no", "evidence_id", "rank").groupBy("question_id").applyInArrow(lambda t: _claims(t.sort_by([("goal_no", "ascending"), ("rank", "ascending")])), schema)
    rest = e.join(goals.select("question_id").distinct(), "question_id", "left_anti")
    kept = rest.select("question_id", (F.row_number().over(Window.partitionBy("question_id").orderBy("ord", "evidence_id")) - 1).alias("pos"), "evidence_id")
    return claimed.unionByName(kept)


def budget_select(ordered: DataFrame, budget: int) -> DataFrame:
    """(question_id, chosen, omitted): items in order while they fit; one that does not is skipped and smaller ones still tried.

    ``ordered(question_id, pos, evidence_id, size)``.
    """
    state = "struct<used:bigint,ids:array<string>>"
    rows = ordered.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("evidence_id").cast("string").alias("id"), F.col("size").cast("bigint").alias("size")))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids")).cast(state)
    fold = F.aggregate("rows", start, lambda a, r: F.when(a["used"] + r["size"] <= budget, F.struct((a["used"] + r["size"]).alias("used"), F.concat(a["ids"], F.array(r["id"])).alias("ids"))).otherwise(a).cast(state), lambda a: a["ids"])
    chosen = rows.withColumn("chosen", fold)
    return chosen.select("question_id", "chosen", F.array_except(F.transform("rows", lambda r: r["id"]), "chosen").alias("omitted"))


def char_budget_prefix(chunks: DataFrame, budget: int = 8000, key: str = "question_id") -> DataFrame:
    """The first chunks by ``pos`` within the budget, the last one cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("room", F.lit(budget) - before).filter("room > 0").withColumn("text", F.left("text", F.col("room").cast("int"))).drop("room")


def dictionary_encode_rows(rows: DataFrame) -> DataFrame:
    """``rows(table_id, pos, headers, cells)`` with ``row_ref`` (r1…) and ``header_ref`` (h1…): equal values share the number of their first appearance."""
    out = rows
    for name, column, letter in (("row_ref", "cells", "r"), ("header_ref", "headers", "h")):
        fp = F.sha2(F.to_json(F.struct(column)), 256)
        out = out.withColumn("_fp", fp).withColumn("_first", F.min("pos").over(Window.partitionBy("table_id", "_fp")))
        out = out.withColumn(name, F.concat(F.lit(letter), F.dense_rank().over(Window.partitionBy("table_id").orderBy("_first")).cast("string")))
    return out.drop("_fp", "_first")


def validate_assessments(assessments: DataFrame, goals: DataFrame, most_missing: int = 8) -> DataFrame:
    """(question_id, rule): goals not assessed exactly once, support without sources, a verdict that contradicts what is missing, too much missing."""
    # One pass: goals and assessments are counted together per goal, then per question; nothing is joined.
    asked = goals.select("question_id", "goal_id", F.lit(1).alias("asked"), *[F.lit(None).cast(x).alias(n) for n, x in (("held", "int"), ("unsourced", "int"), ("missing", "int"), ("s", "boolean"))])
    marks = {"asked": F.lit(None).cast("int"), "held": F.lit(1), "unsourced": ((F.col("status") == "supported") & (F.size("supporting_ids") <= 0)).cast("int"), "missing": (F.col("status") == "missing").cast("int"), "s": F.col("sufficient")}
    rows = asked.unionByName(assessments.select("question_id", "goal_id", *[c.alias(n) for n, c in marks.items()]))
    per_goal = by_key(rows, "question_id").groupBy("question_id", "goal_id").agg(F.max("asked").alias("asked"), F.count("held").alias("n"), F.max("unsourced").alias("unsourced"), F.coalesce(F.sum("missing"), F.lit(0)).alias("m"), F.any_value("s", True).alias("s"))
    once = (F.col("asked") == 1) & ((F.col("n") != 1) | F.col("question_id").isNull() | F.col("goal_id").isNull())
    per = per_goal.groupBy("question_id").agg(F.bool_or(once).alias("once"), F.max("unsourced").alias("unsourced"), F.sum("m").alias("m"), F.any_value("s", True).alias("s"))
    rules = {"goal_not_once": F.col("once"), "support_without_source": F.col("unsourced") == 1, "verdict_contradicts_missing": F.col("s") != (F.col("m") == 0), "too_many_missing": F.col("m") > most_missing}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return per.select("question_id", F.explode(found).alias("rule"))


def merge_gap(previous: DataFrame, partial: DataFrame) -> DataFrame:
    """(question_id, goal_id, status, sufficient): supported goals stay, re-checked ones are replaced; sufficient when all are supported."""
    p = previous.select("question_id", "goal_id", F.col("status").alias("old"))
    n = partial.select("question_id", "goal_id", F.col("status").alias("new"))
    merged = p.join(n, ["question_id", "goal_id"], "full_outer")
    status = F.when(F.col("old") == "supported", F.col("old")).otherwise(F.coalesce("new", "old"))
    merged = merged.select("question_id", "goal_id", status.alias("status"))
    return merged.withColumn("sufficient", F.min((F.col("status") == "supported").cast("int")).over(Window.partitionBy("question_id")) == 1)


def incremental_scope(evidence: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Evidence without what was reviewed and not used: ``reviewed(question_id, evidence_id, used)``."""
    return evidence.join(reviewed.filter("not used").select("question_id", "evidence_id"), ["question_id", "evidence_id"], "left_anti")


def report_reusable(report: DataFrame, versions: DataFrame) -> DataFrame:
    """(question_id, reusable): query, evidence and policy versions are all the same."""
    v = versions.select("question_id", *[F.col(c).alias(f"_{c}") for c in ("query_version", "evidence_version", "policy_version")])
    same = F.lit(True)
    for c in ("query_version", "evidence_version", "policy_version"):
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return report.join(v, "question_id", "left").select("question_id", same.alias("reusable"))


def rule_verdicts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, verdict): empty question, no evidence, identity conflict, a visual question with unread figures only, or undecided."""
    e = evidence.groupBy("question_id").agg(F.count("*").alias("n"), F.bool_or("conflict").alias("conflict"), F.bool_and((F.col("source_kind") == "figure") & ~F.col("extracted")).alias("unread"))
    q = questions.join(e, "question_id", "left")
    verdict = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_question").when(F.col("n").isNull(), "no_evidence").when(F.col("conflict"), "identity_conflict").when(F.col("visual") & F.col("unread"), "figures_unread").otherwise("undecided")
    return q.select("question_id", verdict.alias("verdict"))


def answer_context(evidence: DataFrame, support: DataFrame) -> DataFrame:
    """(question_id, evidence_id, citation): supporting items (global or of a goal) numbered 1..n in evidence order; ``support(question_id, goal_id, evidence_id)``."""
    used = evidence.join(support.select("question_id", "evidence_id").distinct(), ["question_id", "evidence_id"], "left_semi")
    return used.withColumn("citation", F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "evidence_id")))


def goal_citations(numbered: DataFrame, support: DataFrame) -> DataFrame:
    """(question_id, goal_id, citations) of the supporting items."""
    return support.join(numbered.select("question_id", "evidence_id", "citation"), ["question_id", "evidence_id"]).groupBy("question_id", "goal_id").agg(F.array_sort(F.collect_set("citation")).alias("citations"))


def row_roles(rows: DataFrame) -> DataFrame:
    """``rows(…, row_index, matched array, shown array)`` with ``role``: matched, context or unknown."""
    return rows.withColumn("role", F.when(F.array_contains("matched", F.col("row_index")), "matched").when(F.array_contains("shown", F.col("row_index")), "context").otherwise("unknown"))


def reference_text(context: DataFrame) -> DataFrame:
    """(question_id, reference): [n] and the item's JSON, by source kind, then number."""
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.to_json(F.struct(F.col("source_kind").alias("kind"), "text")))
    rows = F.array_sort(F.collect_list(F.struct("source_kind", "citation", line.alias("line"))))
    return context.groupBy("question_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("reference"))


def kb_refusals(results: DataFrame) -> DataFrame:
    """(turn_id, refuse): a knowledge-base search succeeded without a hit and no tool returned evidence; ``results(turn_id, tool, ok, n_evidence)``."""
    empty = (F.col("tool") == "knowledge_base") & F.col("ok") & (F.col("n_evidence") == 0)
    return results.groupBy("turn_id").agg((F.bool_or(empty) & ~F.bool_or(F.col("n_evidence") > 0)).alias("refuse"))
