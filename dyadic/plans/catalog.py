"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import model_queries, table_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

FLAGSHIP = "factor_score"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
