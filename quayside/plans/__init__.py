"""Portal tables derived from the driver tables, the registered queries and their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ("profiles", "ingest", "slices", "scalars", "catalog", "usage", "export", "replace", "streams", "index_jobs")


def catalogue_of_queries():
    """``(queries, oracle SQL)`` of every module in this package."""
    for name in _MODULES:
        importlib.import_module(f"quayside.plans.{name}")
    from quayside.plans import registry

    return registry.QUERIES, registry.ORACLES
