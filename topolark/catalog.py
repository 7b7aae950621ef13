"""Registry of the library's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from topolark.plans import q_grid, q_mutate, q_network, q_route, q_select, q_validate


@lru_cache(maxsize=1)
def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for module in (q_validate, q_mutate, q_route, q_select, q_grid, q_network):
        found.update(module.build())
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
