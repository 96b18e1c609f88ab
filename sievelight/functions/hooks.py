"""Places where a user's model enters: embedding, pair scoring, judging and slot binding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.corpus import check_vectors


def embed_with(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 32, column: str = "text") -> DataFrame:
    """``embedding`` of a text column, checked; ``load`` runs once per Python worker and returns the model."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    return check_vectors(df.withColumn("embedding", run(F.col(column))), dim)


def score_pairs_with(df: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8, query: str = "query", text: str = "text") -> DataFrame:
    """``raw`` score of (query, text) pairs."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
            yield pd.Series([v for i in range(0, len(pairs), batch) for v in model(pairs[i : i + batch])], dtype=float)

    return df.withColumn("raw", run(F.col(query), F.col(text)))


def judge_with(claims: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Judgments (case_id, claim_index, requires, supported, citation_ids) of a callable over batches of claims."""
    return claims.mapInPandas(lambda parts: (judge(p) for p in parts), "case_id long, claim_index int, requires boolean, supported boolean, citation_ids array<int>")


def bind_with(evidence: DataFrame, bind: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Slot values (task_id, slot, chunk_id, value, quote) of a callable per task and slot."""
    return evidence.groupBy("task_id", "slot").applyInPandas(bind, "task_id long, slot string, chunk_id long, value string, quote string")
