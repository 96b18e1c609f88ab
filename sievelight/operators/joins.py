"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 200_000


def listed(df: DataFrame, rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of ``df`` where they are few, for tasks that look them up; None where not."""
    found = df.limit(rows + 1).toArrow()
    return found if found.num_rows <= rows else None


def _local(df: DataFrame, rows: int) -> DataFrame | None:
    """The rows of ``df`` as a local table where they are few: computed once, whatever reads them."""
    found = listed(df, rows)
    return None if found is None else df.sparkSession.createDataFrame(found, df.schema)


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` for broadcasting where it turns out small, as it is where not."""
    local = _local(side, rows)
    return side if local is None else F.broadcast(local)


def settled(df: DataFrame, cached: list, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once for many readers: a local table where it is small, else kept in memory or on disk and put into ``cached``."""
    local = _local(df, rows)
    if local is None:
        cached.append(df.persist())
    return df if local is None else local


def _grams(text: Column) -> Column:
    """What a text can be found by: its ASCII words, and its non-ASCII characters alone and with their successor."""
    parts = [F.regexp_extract_all(text, F.lit(p), F.lit(i)) for p, i in ((r"[a-z0-9]+", 0), (r"[^\x00-\x7F]", 0), (r"(?s)(?=([^\x00-\x7F].))", 1))]
    return F.array_distinct(F.concat(*parts, F.array(F.lit(""))))


def _gram(alias: Column) -> Column:
    """The gram of ``_grams`` that every text with the alias as whole words has."""
    ascii_ = alias.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, F.regexp_extract(alias, r"[a-z0-9]+", 0)).otherwise(F.regexp_extract(alias, r"(?s)[^\x00-\x7F].?", 0))


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def candidates(texts: DataFrame, key: str, column: str, names: DataFrame, name: str) -> DataFrame:
    """(key, the columns of ``names``): dictionary entries whose first gram stands in the text; an equi join, still to be compared."""
    spread = texts.select(key, F.explode(_grams(_folded(F.col(column)))).alias("gram"))
    keyed = names.withColumn("gram", _gram(_folded(F.col(name))))
    return spread.join(small(keyed), "gram").drop("gram").distinct()
