"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources they belong
to) and size; the flow routes each pattern's words, at most ``max_copies`` times,
to the sources' quotas with a cost per repetition that rises with every copy;
seeded documents are then selected until each pattern's flow is filled.

Patterns, sources and quotas stay in Spark at any number.  A source that shares
no document with another needs no network: its one pattern fills its quota.
Sources that overlap, directly or through others, form a component, and each
component's network is solved in a task of its own.

Defined cases: a null text has size 0 and is taken 0 times its 0 words, a very
long one counts whole; a null source is a source of its own and comes last; a
null or empty membership belongs to no source: the row stays with taken 0 and
null source_size and target; with several sources these two are those of the
first one; repeated rows count as separate documents, and which of two rows with
equal doc_id and size is taken first does not matter; a null doc_id is treated
like any other; an empty table gives an empty result; extra columns are kept,
whatever their names, unless they are named like a result column, which wins.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.graphs import connected_components
from sievelight.llm.store import fresh, materialize

#: Rows of plan per pattern up to which the plan is broadcast.
BROADCAST_PATTERNS = 50_000
#: Seeded ranks are cut into so many bins per pattern before exact ranks are needed in one of them.
BINS = 4096


def sources_of(patterns: DataFrame, max_copies: int) -> DataFrame:
    """(id, source, source_size, target) per source of ``patterns(pattern, words)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target is its
    share of all words by weight, at most ``max_copies`` times the source's size;
    what is cut off there is reshared among the others until none is above.
    """
    sizes = patterns.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    # The order is global, so rows are numbered by sorted partition and place in it.
    numbered = materialize(sizes.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row per shuffle partition
    ranked = numbered.join(F.broadcast(before), part == F.col("part")).withColumn("id", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    ranked = materialize(ranked.select("id", "source", "source_size", (F.col("id") % 3 + 1).alias("weight")))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    most, share, full = max_copies * F.col("source_size"), 0.0, -1
    while True:
        above = F.lit(share) * F.col("weight") > most
        row = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most)).alias("cut"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if row["n"] == full or not row["w"]:
            break
        share, full = (whole - (row["cut"] or 0)) / row["w"], row["n"]
    target = F.when(F.lit(share) * F.col("weight") > most, most.cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return ranked.select("id", "source", "source_size", target.alias("target"))


def route(patterns: dict[tuple, int], targets: dict, max_copies: int = 3) -> dict[tuple, float]:
    """Words to draw from each pattern: successive shortest paths from patterns to source quotas.

    Copy c of a pattern's words costs c, so repetition is spread before it is
    deepened; flow already routed to another source of the same pattern can be
    rerouted, which is what makes overlapping memberships optimal.
    """
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    used = dict.fromkeys(patterns, 0.0)
    need = dict(targets)
    by_source: dict = {}
    for p in patterns:
        for s in p:
            by_source.setdefault(s, []).append(p)

    def spare(p: tuple) -> tuple[int, float]:
        """Next copy of p and the words left in it."""
        size = patterns[p]
        copy = int(used[p] // size) if size else max_copies
        while size and copy < max_copies and (copy + 1) * size - used[p] <= 1e-9 * size:
            copy += 1
        return copy, (copy + 1) * size - used[p] if copy < max_copies else 0.0

    for start in sorted(need, key=lambda s: (s is None, s or "")):
        while need[start] > 1e-6:
            # Cheapest way back from the source to spare words, through patterns that can hand words over.
            best, came, done, heap, n = {start: 0.0}, {}, None, [(0.0, 0, start)], 0
            while heap and done is None:
                cost, _, s = heapq.heappop(heap)
                if isinstance(s, tuple) and s and s[0] == "spare":
                    done = s
                    break
                if cost > best.get(s, float("inf")):
                    continue
                for p in by_source.get(s, ()):
                    copy, room = spare(p)
                    if room > 0:
                        key, total = ("spare", p), cost + copy
                        if total < best.get(key, float("inf")):
                            best[key], came[key] = total, (s, p)
                            heapq.heappush(heap, (total, n := n + 1, key))
                    for other, amount in flow[p].items():
                        if other != s and amount > 1e-9 and cost < best.get(other, float("inf")):
                            best[other], came[other] = cost, (s, p)
                            heapq.heappush(heap, (cost, n := n + 1, other))
            if done is None:
                break
            path, node = [], done
            while node != start:
                s, p = came[node]
                path.append((node, s, p))
                node = s
            amount = min([need[start], spare(done[1])[1], *(flow[p][node] for node, _, p in path[1:])])
            used[done[1]] += amount
            for node, s, p in path:
                flow[p][s] = flow[p].get(s, 0.0) + amount
                if not (isinstance(node, tuple) and node and node[0] == "spare"):
                    flow[p][node] -= amount
            need[start] -= amount
    return {p: sum(f.values()) for p, f in flow.items()}


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the words of ``text``."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long"))


def drawn_words(patterns: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """(pattern, words, source_size, target, drawn): what the flow draws of each pattern, and the first source's figures."""
    whole = patterns.agg(F.sum("words")).first()[0] or 0
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    if wanted > whole:  # overlapping sources share the words there are
        sources = sources.withColumn("target", F.col("target") * (whole / wanted))
    members = patterns.select("pattern", "words", F.posexplode("pattern").alias("at", "member"))
    members = materialize(members.join(sources, F.col("member").eqNullSafe(F.col("source"))).select("pattern", "words", "at", "id", "source", "source_size", "target"))
    gathered = members.groupBy("pattern").agg(
        F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("at", "id", "source", "target", "source_size"))).alias("m")
    )
    first = F.col("m")[0]
    gathered = gathered.select("pattern", "words", first["source_size"].alias("source_size"), first["target"].alias("target"), first["id"].alias("id"), "m")
    edges = gathered.filter(F.size("m") > 1).select(F.col("id").alias("a"), F.explode("m.id").alias("b"))
    parts = connected_components(edges).withColumnRenamed("node", "id")
    alone = gathered.join(parts, "id", "left_anti").withColumn("drawn", F.least("target", (max_copies * F.col("words")).cast("double")))
    linked = gathered.join(parts, "id").select("root", "pattern", "words", "source_size", "target", F.col("m.source").alias("names"), F.col("m.target").alias("targets"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        keys = [tuple(names) for names in group["names"]]
        targets = {s: t for names, ts in zip(keys, group["targets"], strict=True) for s, t in zip(names, ts, strict=True)}
        routed = route(dict(zip(keys, group["words"].tolist(), strict=True)), targets, max_copies)
        return group[["pattern", "words", "source_size", "target"]].assign(drawn=[routed[k] for k in keys])

    solved = linked.groupBy("root").applyInPandas(solve, "pattern array<string>, words long, source_size long, target double, drawn double")
    return alone.select(*solved.columns).unionByName(solved)


def _with(rows: DataFrame, plan: DataFrame, few: bool, key: str) -> DataFrame:
    return rows.join(F.broadcast(plan) if few else plan, key, "left")


def mix_sources(docs: DataFrame, seed: int = 17, max_copies: int = 3, membership: str | None = None) -> DataFrame:
    """Rows of ``docs(doc_id, source, size)`` with source_size, target and taken words.

    ``membership`` names an array column of sources for overlapping sources;
    without it a document belongs to its ``source`` alone.
    """
    docs = docs.drop("source_size", "target", "taken")
    pattern, rank, bin_, copies, rest, edge, before, extra = fresh(docs, "pattern", "rank", "bin", "copies", "rest", "edge", "before", "extra")
    member = F.array_sort(F.array_distinct(F.coalesce(F.col(membership), F.array().cast("array<string>")))) if membership else F.array(F.col("source").cast("string"))
    ranked = docs.withColumn(pattern, member).withColumn(rank, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    ranked = ranked.withColumn(bin_, F.shiftrightunsigned(rank, 52).cast("int"))
    bins = materialize(ranked.groupBy(pattern, bin_).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")))
    patterns = materialize(bins.filter(F.size(pattern) > 0).groupBy(F.col(pattern).alias("pattern")).agg(F.sum("words").alias("words")))
    drawn = materialize(drawn_words(patterns, sources_of(patterns, max_copies), max_copies))
    turns = F.when(F.col("words") > 0, F.floor(F.col("drawn") / F.col("words"))).otherwise(0).cast("int")
    plan = drawn.withColumn(copies, turns).select(F.col("pattern").alias(pattern), "source_size", "target", copies, (F.col("drawn") - F.col("words") * F.col(copies)).alias(rest))
    few = drawn.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    # Of each pattern, whole bins below the one where the rest runs out; exact ranks inside that bin only.
    run = Window.partitionBy(pattern).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        _with(bins.withColumn(before, F.coalesce(F.sum("words").over(run), F.lit(0))), plan, few, pattern)
        .filter((F.col(before) < F.col(rest)) & (F.col(before) + F.col("words") >= F.col(rest)))
        .select(pattern, F.col(bin_).alias(edge), before)
    )
    joined = _with(ranked, plan.join(edges, pattern, "left"), few, pattern)
    inside = F.coalesce(F.col(bin_) == F.col(edge), F.lit(False))
    exact = Window.partitionBy(pattern).orderBy(rank, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = joined.filter(inside).withColumn(extra, (F.col(before) + F.coalesce(F.sum("size").over(exact), F.lit(0)) < F.col(rest)).cast("int"))
    others = joined.filter(~inside).withColumn(extra, F.coalesce((F.col(bin_) < F.col(edge)).cast("int"), F.lit(0)))
    taken = F.least((F.col(copies) + F.col(extra)) * F.col("size"), F.col("size") * max_copies)
    # No plan: a row of no source, of which nothing is taken.
    out = part.unionByName(others).withColumn("taken", F.when(F.col(copies).isNull(), 0).otherwise(F.coalesce(taken, F.lit(0))).cast("long"))
    return out.select(*docs.columns, "source_size", "target", "taken")
