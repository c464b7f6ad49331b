"""Registered queries: operators applied to the given tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from . import context_queries, decide_queries, feedback_queries, model_queries, sample_queries, source_queries, stream_queries, text_queries

    return text_queries, model_queries, decide_queries, context_queries, feedback_queries, sample_queries, source_queries, stream_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
