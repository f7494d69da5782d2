"""All registered queries and their SQL."""

from __future__ import annotations

from tallyproof.plans import claims, layout, lines, store  # noqa: F401  (they register)
from tallyproof.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
