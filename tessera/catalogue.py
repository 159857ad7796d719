"""All queries of the library's own operators and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import MODULES


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
