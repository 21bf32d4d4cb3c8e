"""All core queries and their SQL, by name."""

from __future__ import annotations

from foliospark.plans import nested, pages, records, refine

MODULES = [nested, refine, records, pages]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
