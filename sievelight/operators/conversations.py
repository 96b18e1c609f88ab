"""Conversation and relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import truncate_middle

# Fixed value: what stands where a message of the history is cut.
HISTORY_MARKER = "\n...(历史消息已截断)...\n"


def recent_history(turns: DataFrame, sessions: DataFrame, requests: DataFrame, limit: int = 8, budget: int = 12_000) -> DataFrame:
    """(session_id, user_id, pos, role, content): the newest turns of ``requests(session_id, user_id)`` as messages, oldest first.

    ``turns(session_id, turn, question, answer)`` of sessions that the user owns
    in ``sessions(session_id, user_id)``.  Of the newest ``limit`` turns empty
    ones are passed over; the first older turn that does not fit the budget ends
    the history, an oversized newest turn is cut to it.
    """
    owned = turns.join(sessions.select("session_id", "user_id").join(requests.distinct(), ["session_id", "user_id"]), "session_id")
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    newest = Window.partitionBy("session_id", "user_id").orderBy(F.desc("turn"))
    ranked = owned.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= limit).withColumn("question", bare("question")).withColumn("answer", bare("answer"))
    said = ranked.withColumn("size", F.length("question") + F.length("answer")).filter("size > 0")
    used = F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    fitting = said.withColumn("used", used).withColumn("age", F.row_number().over(newest)).filter((F.col("used") <= budget) | (F.col("age") == 1))
    q, a = fit_turn(F.col("question"), F.col("answer"), budget)
    cut = F.col("size") > budget
    roles = F.array(F.struct(F.lit("user").alias("role"), F.when(cut, q).otherwise(F.col("question")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.when(cut, a).otherwise(F.col("answer")).alias("content")))
    messages = fitting.select("session_id", "user_id", "age", F.posexplode(roles).alias("side", "m")).select("session_id", "user_id", "age", "side", "m.*").filter("content <> ''")
    order = Window.partitionBy("session_id", "user_id").orderBy(F.desc("age"), "side")
    return messages.withColumn("pos", F.row_number().over(order)).drop("age", "side")


def fit_turn(question: Column, answer: Column, budget: int) -> tuple[Column, Column]:
    """Question and answer cut to a common budget: each has a half, and what one does not need goes to the other."""
    nq, na = F.length(question), F.length(answer)
    q = F.least(nq, F.lit(budget // 2))
    a = F.least(na, budget - q)
    more = F.least(nq - q, budget - q - a)
    q = F.when(na == 0, budget).otherwise(q + more)
    a = F.when(nq == 0, budget).otherwise(F.least(na, budget - F.least(nq, F.lit(budget // 2)) - more))
    return truncate_middle(question, q, HISTORY_MARKER), truncate_middle(answer, a, HISTORY_MARKER)


def bounded_context(messages: DataFrame, max_turns: int = 16, max_chars: int = 8000) -> DataFrame:
    """The newest user and assistant messages within the limits; the one that crosses the budget is cut."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"), "role", "text")
    said = messages.filter(F.col("role").isin("user", "assistant")).withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= max_turns)
    before = F.coalesce(F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = said.withColumn("room", max_chars - before).filter("room > 0")
    return room.withColumn("text", F.left("text", F.col("room").cast("int"))).drop("room")


def owned_rows(rows: DataFrame, sessions: DataFrame, user) -> DataFrame:
    """Rows of the sessions that a user owns."""
    return rows.join(sessions.filter(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")


def latest_upload(uploads: DataFrame) -> DataFrame:
    """(session_id, n_uploads, latest): number of uploads and the newest file's name."""
    return uploads.groupBy("session_id").agg(F.count("*").alias("n_uploads"), F.max_by("name", F.struct("created_at", "name")).alias("latest"))


def has_knowledge_base(users: DataFrame, bases: DataFrame) -> DataFrame:
    owners = bases.select("user_id").distinct().withColumn("has_kb", F.lit(True))
    return users.join(owners, "user_id", "left").withColumn("has_kb", F.coalesce("has_kb", F.lit(False)))


def fk_violations(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column, value, n): orphan values per declared key (child, column, parent, parent column); nulls are no violation."""
    out = None
    for child, column, parent, parent_column in keys:
        ref = tables[parent].select(F.col(parent_column).alias("value")).distinct()
        orphans = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).join(ref, "value", "left_anti")
        found = orphans.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "n")
        out = found if out is None else out.unionByName(found)
    return out


def cascade_delete(tables: dict[str, DataFrame], root: str, key: str, ids: DataFrame, edges: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the root rows of ``ids`` and all that depends on them; edges (child, column, parent, parent column) in order."""
    gone = {root: tables[root].join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")}
    out = dict(tables)
    out[root] = tables[root].join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")
    for child, column, parent, parent_column in edges:
        if parent in gone:
            ref = gone[parent].select(F.col(parent_column).alias(column)).distinct()
            gone[child] = tables[child].join(ref, column, "left_semi")
            out[child] = out[child].join(ref, column, "left_anti")
    return out


def live_session_docs(docs: DataFrame, now: Column, ttl: int = 7200) -> DataFrame:
    """The newest document per session while it has not expired, with the seconds left."""
    newest = docs.groupBy("session_id").agg(F.max_by("name", F.struct("ts", "name")).alias("name"), F.max("ts").alias("ts"))
    left = F.lit(ttl) - (F.unix_seconds(now) - F.unix_seconds(F.col("ts").cast("timestamp")))
    return newest.withColumn("seconds_left", left).filter("seconds_left > 0")


def call_budget(calls: DataFrame, limits: dict[str, int], seconds: float = 120.0) -> DataFrame:
    """``calls(trace_id, call_id, kind, ts)`` with ``admitted``: within the limit of their kind and the trace's deadline."""
    per = Window.partitionBy("trace_id", "kind").orderBy("ts", "call_id")
    limit = F.lit(None).cast("int")
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("trace_id"))
    ok = (F.coalesce(F.row_number().over(per) <= limit, F.lit(True))) & (elapsed <= seconds * 1e6)
    return calls.withColumn("admitted", ok)
