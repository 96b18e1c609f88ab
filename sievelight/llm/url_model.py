"""URL verdicts: host and path rules, then a ratio of two character language models.

URLs that the rules decide train two smoothed variable-order Markov models, one
for accepted and one for rejected URLs.  Other URLs are judged by the difference
of their log-likelihoods per character against a threshold calibrated on
rule-decided URLs that were held out of training.  Everything is DataFrame work:
context counts by ``groupBy``, interpolation and scoring by joins.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule and the verdict block; repeated rows are judged alike; very long URLs are
scored whole; ties between thresholds go to the one nearest to 0; without
rule-decided URLs the score is 0 and the threshold 0 (allow); an empty table gives
an empty result; extra columns, whatever their names, are ignored; a null page_id
is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.store import materialize, shuffle_width

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Longest context, in characters.
ORDER = 4
#: Characters that a model must be able to continue with, for the uniform end of the interpolation.
ALPHABET = 256
#: Padding before a URL's first character.
START = "\u0002"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    tail = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.withColumn("_tail", F.coalesce(tail, F.lit("")))
        .withColumn("host", lower_ascii(F.regexp_extract("_tail", r"(?s)^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("_tail", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("_tail")
    )


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(host, path)`` with the longest fitting rule and its verdict."""
    hit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer rules are asked first
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        hit, verdict = F.when(fits, F.lit(rule)).otherwise(hit), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", hit).withColumn("rule_verdict", verdict)


def grams(urls: DataFrame, key: str = "url") -> DataFrame:
    """(key columns, gram, n): the ORDER preceding characters and the character, counted per URL."""
    padded = F.concat(F.lit(START * ORDER), lower_ascii(F.col(key)))
    at = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    return urls.filter(F.length(key) > 0).withColumn("gram", F.explode(F.transform(at, lambda i: padded.substr(i, F.lit(ORDER + 1)))))


def gram_scores(distinct: DataFrame, counted: DataFrame) -> DataFrame:
    """(gram, llr) for every distinct gram: log2 p(last char | context) accepted minus rejected.

    Witten-Bell interpolation from the uniform distribution up to ORDER:
    p_k = (n(ctx, c) + t(ctx) p_{k-1}) / (n(ctx) + t(ctx)), where t counts the
    context's different continuations; an unseen context passes p_{k-1} on.
    """
    out = distinct.select("gram").withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pb", F.lit(1.0 / ALPHABET))
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counted.groupBy(tail.alias("tail")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        seen = seen.withColumn("ctx", F.substring("tail", 1, k))
        ctx = seen.groupBy("ctx").agg(
            F.sum("na").alias("ca"), F.sum("nb").alias("cb"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nb") > 0).alias("tb")
        )
        out = out.withColumn("tail", tail).withColumn("ctx", F.substring("gram", ORDER + 1 - k, k))
        out = out.join(seen.drop("ctx"), "tail", "left").join(ctx, "ctx", "left").na.fill(0, ["na", "nb", "ca", "cb", "ta", "tb"])
        for p, n, c, t in (("pa", "na", "ca", "ta"), ("pb", "nb", "cb", "tb")):
            out = out.withColumn(p, F.when(F.col(c) > 0, (F.col(n) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p)))
        out = out.select("gram", "pa", "pb")
    return out.select("gram", (F.log2("pa") - F.log2("pb")).alias("llr"))


def judge_urls(pages: DataFrame, rules=RULES, held_out: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages(page_id, url)``.

    One in ``held_out`` rule-decided URLs (by hash) calibrates the threshold: it
    is the score that maximises true acceptance plus true rejection there.
    """
    judged = apply_rules(url_parts(pages.select("page_id", "url")), rules)
    # URLs repeat, and so do their characters' contexts: score each distinct URL once.
    urls = materialize(judged.groupBy("url").agg(F.first("rule_verdict").alias("says"), F.count("*").alias("weight")))
    fold = F.pmod(F.xxhash64("url"), F.lit(held_out)) == 0
    # The URLs are one small file, but every one becomes a row per character: deal them over all tasks first.
    dealt = urls.repartition(shuffle_width(pages.sparkSession), "url")
    spread = materialize(
        grams(dealt.withColumn("train", F.when(~fold, F.col("says"))))
        .groupBy("url", "gram")
        .agg(F.count("*").alias("n"), F.first("train").alias("train"))
    )
    counted = spread.groupBy("gram").agg(
        F.sum(F.when(F.col("train") == "allow", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("train") == "block", F.col("n")).otherwise(0)).alias("nb"),
    )
    counted = materialize(counted)
    table = gram_scores(counted, counted.filter((F.col("na") > 0) | (F.col("nb") > 0)))
    scored = spread.join(table, "gram").groupBy("url").agg((F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("score"))
    scored = materialize(urls.join(scored, "url", "left").na.fill(0.0, ["score"]))
    cut = threshold(scored.filter(fold)).first()["cut"]
    out = judged.join(scored.select("url", "score"), "url", "left")
    has_url = (F.col("host") != "") | (F.col("path") != "")
    verdict = F.coalesce("rule_verdict", F.when(has_url & (F.coalesce("score", F.lit(0.0)) >= F.lit(cut)), F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def threshold(held: DataFrame, bins: int = 400, top: float = 4.0) -> DataFrame:
    """One row (cut): the best threshold over ``bins`` equal bins of the scores, 0.0 where a class is missing."""
    at = F.least(F.greatest(F.floor((F.col("score") + top) * (bins / (2 * top))), F.lit(0)), F.lit(bins - 1)).cast("int")
    hist = held.filter(F.col("says").isNotNull()).groupBy(at.alias("bin")).agg(
        F.sum(F.when(F.col("says") == "allow", F.col("weight")).otherwise(0)).alias("a"), F.sum(F.when(F.col("says") == "block", F.col("weight")).otherwise(0)).alias("b")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``bins`` rows
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = hist.select(
        "bin", F.sum("a").over(whole).alias("ta"), F.sum("b").over(whole).alias("tb"), F.coalesce(F.sum("a").over(below), F.lit(0)).alias("la"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("lb")
    ).filter((F.col("ta") > 0) & (F.col("tb") > 0))
    value = F.lit(1) - F.col("la") / F.col("ta") + F.col("lb") / F.col("tb")
    return gain.agg(F.coalesce(F.max_by(F.col("bin") * (2 * top / bins) - top, F.struct(value, -F.abs(F.col("bin") - bins / 2))), F.lit(0.0)).alias("cut"))
