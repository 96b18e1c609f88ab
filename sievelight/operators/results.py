"""Shaping of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def web_sources(results: DataFrame, response: str, order: str, limit: int = 10) -> DataFrame:
    """Results with an http(s) URL and a title, with a stable source_id; the first ``limit`` of each response."""
    good = results.filter(F.col("url").rlike("^https?://[^/?#]+") & (F.trim("title") != ""))
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(response).orderBy(order))).filter(F.col("rank") <= limit)
    return ranked.withColumn("source_id", F.concat(F.lit("web-"), F.left(F.sha2("url", 256), F.lit(16))))
