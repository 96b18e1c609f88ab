"""Evaluation analytics: gold matching, ranked metrics, gates, citations, faithfulness and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.sources.tables import by_key

REQUIREMENTS = "array<struct<id:string,alternatives:array<array<struct<id:string,type:string,document_name:string,text:string,row_cells:array<string>>>>>>"
ATOM_TYPES = ("text", "table_row", "figure")
#: Outcomes that are no judgement of evidence (fixed values).
NON_EVIDENCE_OUTCOMES = ("clarification_required", "query_understanding_failed", "system_failure", "budget_exhausted")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for every rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def validate_samples(samples: DataFrame) -> DataFrame:
    """Structure, id, type and answerability rules of ``samples(id, question, answerable, requirements, claims)``."""
    counted = samples.withColumn("copies", F.count("*").over(Window.partitionBy("id")))
    atoms = F.flatten(F.flatten(F.transform("requirements", lambda r: r["alternatives"])))
    ids = F.transform("requirements", lambda r: r["id"])
    rules = {
        "missing_id": F.coalesce(F.trim("id") == "", F.lit(True)),
        "missing_question": F.coalesce(F.trim("question") == "", F.lit(True)),
        "duplicate_id": F.col("copies") > 1,
        "answerable_without_requirement": F.col("answerable") & (F.coalesce(F.size("requirements"), F.lit(0)) <= 0),
        "unanswerable_with_requirement": ~F.col("answerable") & (F.size("requirements") > 0),
        "empty_alternative": F.exists("requirements", lambda r: (F.size(r["alternatives"]) <= 0) | F.exists(r["alternatives"], lambda a: F.size(a) <= 0)),
        "unknown_type": F.exists(atoms, lambda a: ~F.coalesce(a["type"], F.lit("text")).isin(*ATOM_TYPES)),
        "duplicate_requirement": F.size(F.array_distinct(ids)) < F.size(ids),
        "dangling_evidence": F.exists("claims", lambda c: F.size(F.array_except(c["required_evidence_ids"], ids)) > 0),
    }
    return violations(counted, "id", rules)


def explode_atoms(samples: DataFrame) -> DataFrame:
    """(id, req, alt, atom, type, document_name, text, row_cells): a row per evidence atom."""
    r = samples.select("id", F.posexplode("requirements").alias("req", "r"))
    a = r.select("id", "req", F.posexplode("r.alternatives").alias("alt", "a"))
    return a.select("id", "req", "alt", F.posexplode("a").alias("atom", "x")).select("id", "req", "alt", "atom", "x.type", "x.document_name", "x.text", "x.row_cells")


def match_text(atoms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(…atom, rank, chunk_id, score): trigram coverage against the case's chunks of the same document.

    Texts are normalised and cut into trigrams once per row, before rows meet.
    """
    a = atoms.withColumn("name", T.normalize_document_name(F.col("document_name"))).withColumn("asked", T.normalize_text(F.col("text")))
    a = a.withColumn("grams", T.trigrams(F.col("asked"), F.least(F.lit(3), F.length("asked"))))
    c = chunks.select(F.col("case_id").alias("id"), T.normalize_document_name(F.col("document_name")).alias("name"), "rank", "chunk_id", T.normalize_text(F.col("content")).alias("held"))
    c = c.withColumn("held_grams", T.trigrams(F.col("held"), F.lit(3)))
    short = F.length("asked") < 3
    shared = F.size(F.array_intersect("grams", F.when(short, T.trigrams(F.col("held"), F.length("asked"))).otherwise(F.col("held_grams"))))
    score = (
        F.when((F.col("asked") == "") | (F.col("held") == ""), 0.0)
        .when(F.contains("held", "asked"), 1.0)
        .when(F.contains("asked", "held"), F.length("held") / F.length("asked"))
        .otherwise(shared / F.size("grams"))
    )
    return a.join(c, ["id", "name"]).select("id", "req", "alt", "atom", "rank", "chunk_id", score.alias("score"))


def match_table_row(atoms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Row cells against a chunk's cells: 1 for an equal row or a contiguous run of it, else 0; without cells the text decides."""
    keys = lambda cells: F.transform(cells, T.cell_key)
    # Cells are normalised once per row, before rows meet.
    a = atoms.withColumn("name", T.normalize_document_name(F.col("document_name"))).withColumn("asked", keys("row_cells"))
    c = chunks.select(F.col("case_id").alias("id"), T.normalize_document_name(F.col("document_name")).alias("name"), "rank", "chunk_id", "content", keys("cells").alias("held"))
    joined = a.join(c, ["id", "name"])
    n, m = F.size("asked"), F.size("held")
    run = lambda i: F.forall(F.zip_with("asked", F.slice("held", i, n), T.cell_keys_equal), lambda x: x)
    score = F.when((n > 0) & (m > 0), F.when((m >= n) & F.exists(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), run), 1.0).otherwise(0.0)).otherwise(T.trigram_coverage(F.col("text"), F.col("content")))
    return joined.select("id", "req", "alt", "atom", "rank", "chunk_id", score.alias("score"))


def match_figure(atoms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Figures by locator where both have one, else by text."""
    c = chunks.select(F.col("case_id").alias("id"), "rank", "chunk_id", "content", F.col("locator").alias("_l"))
    joined = atoms.join(c, "id")
    score = F.when((F.col("locator") != "") & (F.col("_l") != ""), (T.normalize_text(F.col("locator")) == T.normalize_text(F.col("_l"))).cast("double")).otherwise(T.trigram_coverage(F.col("text"), F.col("content")))
    return joined.select("id", "req", "alt", "atom", "rank", "chunk_id", score.alias("score"))


def evaluate_requirements(atoms: DataFrame, matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, req, matched, matched_rank, alternative, coverage): every atom of any one alternative; completed by the last atom's first rank."""
    first = matches.filter(F.col("score") >= threshold).groupBy("id", "req", "alt", "atom").agg(F.min("rank").alias("first_rank"))
    alts = atoms.join(first, ["id", "req", "alt", "atom"], "left").groupBy("id", "req", "alt").agg(F.count("*").alias("n"), F.count("first_rank").alias("m"), F.max("first_rank").alias("last"))
    done = F.col("n") == F.col("m")
    return alts.groupBy("id", "req").agg(
        F.bool_or(done).alias("matched"), F.min(F.when(done, F.col("last"))).alias("matched_rank"),
        F.min_by("alt", F.when(done, F.struct("last", "alt"))).alias("alternative"), F.round(F.max(F.col("m") / F.col("n")), 6).alias("coverage"),
    )


def retrieval_metrics(samples: DataFrame, atoms: DataFrame, matches: DataFrame, ks: list[int], threshold: float = 0.8) -> DataFrame:
    """(id, k, hit, recall, precision, mrr) per case and cutoff; null for unanswerable cases.

    Precision divides by k; the rank is that of the last requirement's completion.
    """
    cutoffs = samples.select("id", "answerable", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    req = evaluate_requirements(atoms, matches, threshold)
    # Completion within k ranks looks at the same first ranks, so one evaluation serves all cutoffs.
    within = cutoffs.join(req, "id", "left").groupBy("id", "answerable", "k").agg(
        F.count("req").alias("gold"), F.count_if(F.col("matched_rank") <= F.col("k")).alias("found"), F.max(F.when(F.col("matched_rank") <= F.col("k"), F.col("matched_rank"))).alias("last")
    )
    relevant = matches.filter(F.col("score") >= threshold).select("id", "rank").distinct()
    hits = cutoffs.join(relevant, "id").filter("rank <= k").groupBy("id", "k").agg(F.count("*").alias("relevant"))
    full = (F.col("gold") > 0) & (F.col("found") == F.col("gold"))
    ok = F.col("answerable")
    return within.join(hits, ["id", "k"], "left").select(
        "id", "k", F.when(ok, full).alias("hit"), F.when(ok & (F.col("gold") > 0), F.round(F.col("found") / F.col("gold"), 6)).alias("recall"),
        F.when(ok, F.round(F.coalesce("relevant", F.lit(0)) / F.col("k"), 6)).alias("precision"), F.when(ok, F.round(F.when(full, 1 / F.col("last")).otherwise(0.0), 6)).alias("mrr"),
    )


def duplicate_rate(chunks: DataFrame, ks: list[int]) -> DataFrame:
    """(case_id, k, duplicate_rate): share of repeated contents of the same document among the first k."""
    print_ = F.struct(T.normalize_document_name(F.col("document_name")).alias("d"), F.when(T.normalize_text(F.col("content")) != "", F.sha2(T.normalize_text(F.col("content")), 256)).otherwise(F.col("chunk_id").cast("string")).alias("c"))
    rows = chunks.filter(F.col("rank") <= max(ks)).select("case_id", "rank", F.to_json(print_).alias("fp"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter("rank <= k")
    return rows.groupBy("case_id", "k").agg(F.round(1 - F.countDistinct("fp") / F.count("*"), 6).alias("duplicate_rate"))


def evidence_set_metrics(samples: DataFrame, atoms: DataFrame, matches: DataFrame, chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, hit, recall, precision, n): coverage of a whole set without ranks."""
    req = evaluate_requirements(atoms, matches, threshold).groupBy("id").agg(F.count("*").alias("gold"), F.count_if("matched").alias("found"))
    size = chunks.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("n"))
    relevant = matches.filter(F.col("score") >= threshold).groupBy("id").agg(F.countDistinct("rank").alias("relevant"))
    joined = samples.select("id", "answerable").join(req, "id", "left").join(size, "id", "left").join(relevant, "id", "left")
    ok = F.col("answerable")
    return joined.select(
        "id", F.when(ok, F.coalesce(F.col("found") == F.col("gold"), F.lit(False))).alias("hit"), F.when(ok, F.round(F.col("found") / F.col("gold"), 6)).alias("recall"),
        F.when(ok, F.round(F.coalesce("relevant", F.lit(0)) / F.col("n"), 6)).alias("precision"), F.coalesce("n", F.lit(0)).alias("n"),
    )


# Three-valued folds: no value at all is unknown.


def all3(c: Column) -> Column:
    return F.when(F.count_if(~c) > 0, False).when((F.count("*") > 0) & (F.count_if(c) == F.count("*")), True)


def any3(c: Column) -> Column:
    return F.when(F.count_if(c) > 0, True).when((F.count("*") > 0) & (F.count_if(~c) == F.count("*")), False)


def modality_usability(modality: Column, visual_status: Column, table_binding: Column) -> Column:
    """Figures need extracted facts, tables a bound structure; other statuses are unknown."""
    figure = F.when(visual_status == "extracted", True).when(visual_status.isin("unextracted", "disabled", "unavailable", "failed", "empty"), False)
    table = F.when(table_binding == "bound", True).when(table_binding == "unbound", False)
    return F.when(modality == "figure", figure).when(modality.isin("table", "table_row"), table).otherwise(True)


def expected_sufficiency(annotation: Column, snapshot: Column, answerable: Column, gold: Column) -> Column:
    """Annotation before missing snapshot before unanswerable before gold evidence."""
    return F.when(annotation.isNotNull(), annotation).when(~snapshot, F.lit(None).cast("boolean")).when(~answerable, False).when(answerable, gold)


def gate_outcomes(cases: DataFrame) -> DataFrame:
    """``cases(…, enabled, source, sufficient, outcome, answerable, pre_sufficient)`` with rejected, fallback and attribution."""
    disabled = F.coalesce(~F.col("enabled"), F.lit(False)) | F.coalesce(F.col("source") == "disabled", F.lit(False))
    available = ~disabled & F.coalesce(F.col("source").isin("model", "rule", "fallback"), F.lit(False)) & F.col("sufficient").isNotNull()
    no_evidence = F.coalesce(F.col("outcome").isin(*NON_EVIDENCE_OUTCOMES), F.lit(False))
    rejected = F.when(available & ~no_evidence, ~F.col("sufficient"))
    wrong = F.when(F.coalesce(~F.col("answerable"), F.lit(False)), "correct_unanswerable_rejection").otherwise("correct_rejection_after_insufficient_evidence")
    why = F.when(no_evidence, F.col("outcome")).when(rejected, F.when(F.col("pre_sufficient"), "false_rejection_with_sufficient_evidence").when(~F.col("pre_sufficient"), wrong))
    return cases.withColumn("rejected", rejected).withColumn("fallback", F.when(available, F.col("source") == "fallback")).withColumn("attribution", why)


def rate(part: Column, whole: Column) -> Column:
    """Rounded share; null where nothing counts."""
    return F.round(F.when(whole > 0, part / whole), 6)


def aggregate_stage(cases: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Query, evaluated and error counts, empty rate, and macro means with their denominators; failed cases count in none."""
    ok = F.col("error").isNull()
    aggs = [F.count("*").alias("queries"), F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("errors"), rate(F.count_if(ok & (F.col("n_chunks") == 0)), F.count_if(ok)).alias("empty_rate")]
    for m in metrics:
        value = F.when(ok, F.col(m).cast("double"))
        aggs += [F.round(F.avg(value), 6).alias(f"mean_{m}"), F.count(value).alias(f"n_{m}")]
    return cases.groupBy(*(by or [])).agg(*aggs)


def latency_summary(cases: DataFrame, column: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Mean and interpolated percentiles of non-negative latencies of cases without error.

    No task holds a group's latencies: equal ones are counted, the counts of
    logarithmic bins say which bins hold the wanted ranks, and only the values of
    these are put in order.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    keys = [f"key{i}" for i in range(len(by or []) + 1)]
    value = F.when(F.col("error").isNull() & (F.col(column) >= 0), F.col(column).cast("double"))
    keyed = cases.select(F.lit(0).alias(keys[0]), *[F.col(c).alias(k) for c, k in zip(by or [], keys[1:], strict=True)], value.alias("v"))
    whole = keyed.groupBy(*keys).agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    counted = keyed.filter("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c")).withColumn("bin", F.floor(F.log1p("v") * 200).cast("int"))
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    bins = counted.groupBy(*keys, "bin").agg(F.sum("c").alias("bc"))
    bins = bins.withColumn("before", F.sum("bc").over(order) - F.col("bc")).withColumn("last", F.sum("bc").over(group) - 1)
    spots = {p: F.col("last") * q for p, q in shares.items()}
    ranks = {f"{p}_{end}": f(at).cast("long") for p, at in spots.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    asked = F.exists(F.array(*ranks.values()), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("bc")))
    wanted = bins.filter(asked).select(*[F.col(c).alias(f"w_{c}") for c in (*keys, "bin")], "before", "last")
    same = F.lit(True)
    for c in (*keys, "bin"):
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    placed = counted.join(wanted, same)
    inside = Window.partitionBy(*keys, "bin").orderBy("v")
    placed = placed.withColumn("end", F.col("before") + F.sum("c").over(inside)).withColumn("start", F.col("end") - F.col("c"))
    found = placed.groupBy(*[F.col(k).alias(f"f_{k}") for k in keys]).agg(F.max("last").alias("last"), *[F.max(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("v"))).alias(name) for name, r in ranks.items()])
    percentiles = [F.round(F.col(f"{p}_low") + (at - F.floor(at)) * (F.col(f"{p}_high") - F.col(f"{p}_low")), 6).alias(p) for p, at in spots.items()]
    found = found.select(*[f"f_{k}" for k in keys], *percentiles)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"f_{k}"))
    return whole.join(found, match, "left").select(*[F.col(k).alias(c) for c, k in zip(by or [], keys[1:], strict=True)], "n", "mean", *shares)


def aggregate_gate(gated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rejection, fallback and attribution rates over cases with a decision."""
    decided = F.count("rejected")
    return gated.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), decided.alias("decided"), rate(F.count_if("rejected"), decided).alias("rejection_rate"), rate(F.count_if("fallback"), F.count("fallback")).alias("fallback_rate"),
        rate(F.count_if(F.col("attribution") == "false_rejection_with_sufficient_evidence"), F.count_if(F.col("pre_sufficient") & F.col("rejected").isNotNull())).alias("false_rejection_rate"),
        F.count_if(F.startswith("attribution", F.lit("correct"))).alias("correct_rejections"),
    )


def aggregate_calls(calls: DataFrame) -> DataFrame:
    """Ranked metrics of single retrieval calls, grouped by the k each asked for."""
    return calls.groupBy("k").agg(F.count("*").alias("calls"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(f"mean_{m}") for m in ("hit", "recall", "mrr")])


def query_run_metrics(runs: DataFrame, goals: DataFrame) -> DataFrame:
    """Mean calls, fallback rates, route agreement, and the share of runs whose every goal is supported, each goal counted once."""
    once = goals.groupBy("id", "goal_id").agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "supported").alias("ok"))
    supported = once.groupBy("id").agg((F.max("n") == 1).alias("valid"), F.bool_and("ok").alias("supported"))
    joined = runs.join(supported, "id", "left")
    return joined.agg(
        F.count("*").alias("runs"), F.round(F.avg("calls"), 6).alias("mean_calls"), rate(F.count_if("plan_fallback"), F.count("plan_fallback")).alias("plan_fallback_rate"),
        rate(F.count_if(F.col("route") == F.col("expected_route")), F.count_if(F.col("route").isNotNull() & F.col("expected_route").isNotNull())).alias("route_agreement"),
        rate(F.count_if(F.col("valid") & F.col("supported")), F.count_if("valid")).alias("goal_support_rate"),
    )


def repair_metrics(cases: DataFrame) -> DataFrame:
    """Repairs attempted, satisfied and rightly refused, by answerability."""
    tried = F.col("repair_attempted")
    return cases.groupBy("answerable").agg(
        F.count("*").alias("cases"), F.count_if(tried).alias("attempted"), rate(F.count_if(tried & F.col("satisfied")), F.count_if(tried)).alias("satisfied_rate"),
        rate(F.count_if(tried & ~F.col("answerable") & F.col("refused")), F.count_if(tried & ~F.col("answerable"))).alias("correct_refusal_rate"),
    )


def failing_samples(cases: DataFrame, ideals: dict[str, float], key: str = "id") -> DataFrame:
    """(metric, key): cases that miss a metric's ideal value."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("ideal")) for m, v in ideals.items()])
    missed = cases.select(key, F.explode(rows).alias("m")).filter("m.value is not null and m.value <> m.ideal")
    return missed.select(F.col("m.metric").alias("metric"), key).distinct()


def build_summary(cases: DataFrame, metrics: list[str], slices: list[str]) -> DataFrame:
    """Overall and per slice value in one pass over grouping sets."""
    aggs = [F.count("*").alias("queries"), F.count_if(F.col("error").isNotNull()).alias("errors")]
    aggs += [F.round(F.avg(F.when(F.col("error").isNull(), F.col(m).cast("double"))), 6).alias(f"mean_{m}") for m in metrics]
    sets = [[], *[[F.col(s)] for s in slices]]
    grouped = cases.groupingSets(sets, *[F.col(s) for s in slices]).agg(*aggs, F.grouping_id().alias("_g"))
    name, full = F.lit("overall"), 2 ** len(slices) - 1
    value = F.lit(None).cast("string")
    for i, s in enumerate(slices):
        mine = F.col("_g") == full - 2 ** (len(slices) - 1 - i)
        name, value = F.when(mine, F.lit(s)).otherwise(name), F.when(mine, F.col(s).cast("string")).otherwise(value)
    return grouped.select(name.alias("slice"), value.alias("value"), "queries", "errors", *[f"mean_{m}" for m in metrics])


def source_modality(samples: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, modality): the annotated one, else the sorted different evidence types joined by +."""
    kinds = atoms.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == "table_row", "table").otherwise(F.col("type")))), "+").alias("kinds"))
    return samples.join(kinds, "id", "left").select("id", F.coalesce("modality", "kinds", F.lit("none")).alias("modality"))


def citation_validity(answers: DataFrame) -> DataFrame:
    """``answers(…, answer, n_documents)`` with markers, valid markers (1..n) and their share."""
    ids = T.citation_ids(F.col("answer"))
    good = F.filter(ids, lambda i: (i >= 1) & (i <= F.col("n_documents")))
    return answers.withColumn("n_citations", F.size(ids).cast("long")).withColumn("n_valid", F.size(good).cast("long")).withColumn("validity", rate(F.col("n_valid"), F.col("n_citations")))


def citation_scores(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """(case_id, complete, completeness, precision, recall) of ``claims(case_id, claim_index, citation_ids)`` and ``judgments(case_id, claim_index, requires, supported, citation_ids)``.

    A claim with other than one valid judgment leaves the case incomplete, without scores.
    """
    bad = F.col("supported") & F.col("requires") & (F.size("citation_ids") <= 0)
    none = lambda kind: F.lit(None).cast(kind)
    # Claims and judgments are counted together per claim, then per case; nothing is joined.
    c = claims.select("case_id", "claim_index", F.lit(1).alias("claim"), (F.size("citation_ids") > 0).cast("int").alias("cites"), none("int").alias("judged"), none("boolean").alias("valid"), none("boolean").alias("requires"), none("boolean").alias("supported"))
    j = judgments.select("case_id", "claim_index", none("int").alias("claim"), none("int").alias("cites"), F.lit(1).alias("judged"), (~F.coalesce(bad, F.lit(True))).alias("valid"), "requires", "supported")
    one = by_key(c.unionByName(j), "case_id").groupBy("case_id", "claim_index").agg(
        F.count("claim").alias("claims"), F.coalesce(F.sum("cites"), F.lit(0)).alias("cites"), F.count("judged").alias("n"), F.bool_and("valid").alias("valid"), F.max("requires").alias("requires"), F.max("supported").alias("supported")
    )
    fine = F.coalesce((F.col("n") == 1) & F.col("valid") & F.col("case_id").isNotNull() & F.col("claim_index").isNotNull(), F.lit(False))
    times = lambda count, *given: F.coalesce(F.sum(F.when(reduce(lambda a, b: a & b, given), F.col(count))), F.lit(0))
    need, good = (fine, F.col("requires")), (fine, F.col("requires"), F.col("supported"))
    out = one.filter("claims > 0").groupBy("case_id").agg(F.bool_and(fine).alias("complete"), times("claims", *need).alias("need"), times("claims", *good).alias("good"), times("cites", *need).alias("cited"), times("cites", *good).alias("cited_good"))
    scored = lambda part, whole: F.when(F.col("complete"), rate(F.col(part), F.col(whole)))
    return out.select("case_id", "complete", scored("cited", "need").alias("completeness"), scored("cited_good", "cited").alias("precision"), scored("good", "need").alias("recall"))


def faithfulness(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """(case_id, n_claims, n_supported, faithfulness, coverage, unsupported) per answer."""
    joined = claims.join(judgments.select("case_id", "claim_index", "supported"), ["case_id", "claim_index"], "left")
    judged = F.count("supported")
    return joined.groupBy("case_id").agg(
        F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"), rate(F.count_if("supported"), judged).alias("faithfulness"), rate(judged, F.count("*")).alias("coverage"),
        F.array_sort(F.collect_list(F.when(~F.col("supported"), F.col("claim_index")))).alias("unsupported"),
    )


def faithfulness_rollup(scores: DataFrame) -> DataFrame:
    """Macro mean over answers, and micro share over claims."""
    return scores.agg(F.count("faithfulness").alias("answers"), F.round(F.avg("faithfulness"), 6).alias("macro"), rate(F.sum("n_supported"), F.sum(F.round(F.col("n_claims") * F.col("coverage")))).alias("micro"))


def answer_quality(scores: DataFrame, columns=("correctness", "completeness"), by: list[str] | None = None) -> DataFrame:
    """Means of judge scores in [0, 1]; others count as judge failures."""
    aggs = []
    for c in columns:
        value = F.col(c).cast("double")
        ok = (value >= 0) & (value <= 1) & ~F.isnan(value)
        aggs += [F.round(F.avg(F.when(ok, value)), 6).alias(f"mean_{c}"), F.count_if(value.isNotNull() & ~F.coalesce(ok, F.lit(False))).alias(f"failed_{c}")]
    return scores.groupBy(*(by or [])).agg(*aggs)


def refusal_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected (answer, refuse, clarify) against actual behaviour."""
    want, did = F.col("expected_behavior"), F.col("behavior")
    both = want.isNotNull() & did.isNotNull()
    refuse_want, refuse_did = both & (want == "refuse"), both & (did == "refuse")
    return cases.groupBy(*(by or [])).agg(
        F.count_if(both).alias("cases"), rate(F.count_if(refuse_want & refuse_did), F.count_if(refuse_did)).alias("refusal_precision"), rate(F.count_if(refuse_want & refuse_did), F.count_if(refuse_want)).alias("refusal_recall"),
        rate(F.count_if(refuse_want & (did == "answer")), F.count_if(refuse_want)).alias("unsafe_answer_rate"), rate(F.count_if(both & (want == "answer") & (did == "refuse")), F.count_if(both & (want == "answer"))).alias("over_refusal_rate"),
        rate(F.count_if(both & (want == "clarify") & (did == "clarify")), F.count_if(both & (want == "clarify"))).alias("clarification_accuracy"),
    )


def sufficiency_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Actual against expected sufficiency; unknown on either side is counted apart."""
    want, did = F.col("expected_sufficient"), F.col("sufficient")
    both = want.isNotNull() & did.isNotNull()
    return cases.groupBy(*(by or [])).agg(
        F.count_if(both).alias("cases"), rate(F.count_if(both & (want == did)), F.count_if(both)).alias("accuracy"), rate(F.count_if(both & ~want & did), F.count_if(both & ~want)).alias("unsafe_accept_rate"),
        rate(F.count_if(both & want & ~did), F.count_if(both & want)).alias("false_rejection_rate"), F.count_if(want.isNull()).alias("unknown_expected"), F.count_if(did.isNull()).alias("unknown_actual"),
    )


def score_coverage(cases: DataFrame, scores: list[str]) -> DataFrame:
    """(score, applicable, evaluated, judge_failed, not_applicable): a case with an error is not applicable."""
    rows = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores])
    long = cases.select(F.col("error").isNull().alias("ok"), F.explode(rows).alias("s")).select("ok", "s.score", "s.value")
    good = F.coalesce(F.col("value").between(0, 1), F.lit(False))
    return long.groupBy("score").agg(F.count_if("ok").alias("applicable"), F.count_if(F.col("ok") & good).alias("evaluated"), F.count_if(F.col("ok") & ~good).alias("judge_failed"), F.count_if(~F.col("ok")).alias("not_applicable"))


def sample_issues(cases: DataFrame, ideals: dict[str, float], key: str = "id") -> DataFrame:
    """(key, issues): every failing path of a sample, execution errors included."""
    found = [F.when(F.col("error").isNotNull(), F.lit("execution_failed"))]
    found += [F.when(F.col("error").isNull() & F.col(m).isNotNull() & (F.col(m).cast("double") != v), F.lit(m)) for m, v in ideals.items()]
    issues = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return cases.select(key, F.array_join(issues, ",").alias("issues")).filter("issues <> ''")


def e2e_summary(cases: DataFrame) -> DataFrame:
    """Answer quality, refusal and sufficiency overall and by question type."""
    parts = []
    for by in ([], ["question_type"]):
        named = (lambda df: df) if by else (lambda df: df.withColumn("question_type", F.lit("overall")))
        q, r, s = (named(f(cases, by=by)) for f in (answer_quality, refusal_metrics, sufficiency_metrics))
        r, s = r.withColumnRenamed("cases", "behavior_cases"), s.withColumnRenamed("cases", "sufficiency_cases")
        for other in (r, s):  # null-safe: cases without a type are a type of their own
            other = other.withColumnRenamed("question_type", "other_type")
            q = q.join(other, q["question_type"].eqNullSafe(other["other_type"])).drop("other_type")
        parts.append(q)
    return reduce(DataFrame.unionByName, parts)


def migrate_samples(v1: DataFrame) -> DataFrame:
    """Samples of the first schema (``id, question, answer, answerable, evidence array<struct<document_name,text>>``) in the second.

    Each evidence becomes a requirement r1.. with one alternative of one text
    atom; the reference answer becomes one claim that needs all of them.
    """
    req = F.transform("evidence", lambda e, i: F.struct(
        F.concat(F.lit("r"), (i + 1).cast("string")).alias("id"),
        F.array(F.array(F.struct(F.concat(F.lit("r"), (i + 1).cast("string"), F.lit("-a1")).alias("id"), F.lit("text").alias("type"), e["document_name"].alias("document_name"), e["text"].alias("text"), F.lit(None).cast("array<string>").alias("row_cells")))).alias("alternatives"),
    ))
    out = v1.withColumn("requirements", F.when(F.col("answerable"), req).otherwise(F.array().cast(REQUIREMENTS)))
    ids = F.transform("requirements", lambda r: r["id"])
    claims = F.when(F.col("answerable"), F.array(F.struct(F.lit("c1").alias("id"), F.col("answer").alias("text"), ids.alias("required_evidence_ids")))).otherwise(F.array().cast("array<struct<id:string,text:string,required_evidence_ids:array<string>>>"))
    return out.withColumn("claims", claims).withColumn("expected_behavior", F.when(F.col("answerable"), "answer").otherwise("refuse")).withColumn("schema_version", F.lit("2.0")).drop("evidence", "answer")


def busy_time(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, busy): length of the union of possibly overlapping intervals."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(end).over(order)
    new = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(reached, F.col(start))))
    return intervals.withColumn("_new", new).groupBy(key).agg(F.round(F.sum("_new"), 6).alias("busy"))


def run_status(cases: DataFrame) -> DataFrame:
    return cases.groupBy("scoring_status").agg(F.count("*").alias("n"))


def dataset_profile(samples: DataFrame) -> DataFrame:
    """(split, n, types, versions) of a sample set."""
    return samples.groupBy("split").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("question_type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("dataset_version")), ",").alias("versions"))
