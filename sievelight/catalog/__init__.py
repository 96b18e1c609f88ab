"""Registered queries: one per operator, each over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from sievelight.catalog.registry import QUERIES, SQL


def load() -> tuple[dict, dict[str, str]]:
    from sievelight.catalog import conversations, corpus, evaluation, evidence, retrieval, texts  # noqa: F401

    return dict(QUERIES), dict(SQL)
