"""All queries of the library and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.plans import catalogue_plans, chat_plans, export_plans, result_plans, source_plans, text_plans

_ALL = text_plans.QUERIES | chat_plans.QUERIES | catalogue_plans.QUERIES | result_plans.QUERIES | export_plans.QUERIES | source_plans.QUERIES
_ALL["sentence_loops"] = (_ALL["sentence_loops"][0], result_plans.SENTENCE_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
