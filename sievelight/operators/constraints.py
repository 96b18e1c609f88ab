"""Do a candidate's time, status, locator, dimension, subject and organisations agree with the query's?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions.preserve import organizations

# Fixed value: what is no part of a measured subject.
SUBJECT_NOISE = (
    rf"(?i)(?:{T.YEAR})e?|\d+(?:\.\d+)?|"
    r"上半年|下半年|全年|年度|季度|月份?|年|"
    r"第一|第二|第三|第四|"
    r"是多少|多少|什么|哪个|哪一个|分别|具体|数据|指标|"
    r"公司|报告|研报|预计|预测|实际|实现|达到|约|左右|"
    r"金额|人民币|百万元|千万元|亿元|万元|千元|"
    r"百分比|百分点|比例|占比|比重|率|[%％]|"
    r"每股|元股|"
    r"千瓦时|兆瓦时|吉瓦时|kwh|mwh|gwh|"
    r"千瓦|兆瓦|吉瓦|kw|mw|gw|"
    r"更高|相差|口径|单位"
)


def _verdict(asked: Column, held: Column) -> Column:
    """Nothing asked or nothing known is unknown; a common value is compatible, none a conflict."""
    return F.when((F.size(asked) == 0) | (F.size(held) == 0), "unknown").when(F.size(F.array_intersect(asked, held)) > 0, "compatible").otherwise("conflict")


def _time(asked: Column, held: Column) -> Column:
    """A year asked for takes any of its periods; a bare year does not prove one of its periods, nor speak against it."""
    year, period = (lambda s: F.substring_index(s, "-", 1)), (lambda s: F.substring_index(s, "-", -1))
    same = lambda a, h: (year(a) == year(h)) | (year(a) == "ANY") | (year(h) == "ANY")
    fits = F.exists(asked, lambda a: F.exists(held, lambda h: same(a, h) & ((period(a) == period(h)) | (period(a) == "YEAR"))))
    bare = F.exists(asked, lambda a: F.exists(held, lambda h: (year(a) == year(h)) & (period(h) == "YEAR")))
    return F.when((F.size(asked) == 0) | (F.size(held) == 0), "unknown").when(fits, "compatible").when(bare, "unknown").otherwise("conflict")


def measured_subject(text: Column, names: Column) -> Column:
    """What is left of the normalised text without its organisations ``names`` and general constraints."""
    bare = F.aggregate(names, T.normalize_text(text), lambda s, n: F.replace(s, n, F.lit("")))
    return F.regexp_replace(bare, SUBJECT_NOISE, "")


def constraint_facts(text: Column, asking: bool = False) -> Column:
    """What one side states: time, status, locator, dimension, organisations, and pieces of what it measures; computed once per text."""
    def stated(names: Column) -> Column:
        subject = T.let(measured_subject(text, names), lambda s: F.when(F.length(s) >= 2, F.array_distinct(T.bigrams(s))).otherwise(F.array().cast("array<string>")))
        return F.struct(
            T.time_scopes(text).alias("time"),
            T.fact_statuses(text, asking).alias("status"),
            T.locators(text).alias("locator"),
            T.measurement_dimensions(text).alias("dimension"),
            names.alias("entity"),
            subject.alias("subject"),
            (F.lit(None).cast("string") if asking else T.normalize_text(text)).alias("whole"),
        )

    return T.let(F.transform(organizations(text), lambda n: T.normalize_text(n)), stated)


VERDICTS = ("time", "status", "locator", "dimension", "entity", "subject")


def compare_facts(pairs: DataFrame, asked: str = "asked", held: str = "held") -> DataFrame:
    """Pairs of ``constraint_facts`` with a verdict per constraint and the numbers of conflicts and agreements.

    Unknown metadata is neutral.  Subjects are compared for queries with a
    measurement only, by any two characters in a row that the whole texts share;
    neither a missing subject nor a missing organisation is a conflict.
    """
    q, c = (lambda n: F.col(f"{asked}.{n}")), (lambda n: F.col(f"{held}.{n}"))
    verdicts = {"time": _time(q("time"), c("time"))} | {n: _verdict(q(n), c(n)) for n in ("status", "locator", "dimension")}
    verdicts["entity"] = F.when(F.exists(q("entity"), lambda n: F.contains(c("whole"), n)), "compatible").otherwise("unknown")
    verdicts["subject"] = F.when((F.size(q("dimension")) > 0) & (F.size(F.array_intersect(q("subject"), c("subject"))) > 0), "compatible").otherwise("unknown")
    out = pairs.withColumns(verdicts)
    count = lambda v: sum((F.col(n) == v).cast("int") for n in VERDICTS)
    return out.withColumn("n_conflicts", count("conflict")).withColumn("n_compatible", count("compatible"))


def constraint_compatibility(pairs: DataFrame) -> DataFrame:
    """``pairs(query, candidate)`` with the verdicts of ``compare_facts``."""
    sides = pairs.withColumn("_q", constraint_facts(F.col("query"), asking=True)).withColumn("_c", constraint_facts(F.col("candidate")))
    return compare_facts(sides, "_q", "_c").drop("_q", "_c")
