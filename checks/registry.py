"""All registered queries and their oracles."""

from __future__ import annotations

from checks import pages, refusals, relational, runs, scalars, stores, streams, upkeep

_MODULES = (relational, scalars, pages, stores, runs, refusals, streams, upkeep)


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
