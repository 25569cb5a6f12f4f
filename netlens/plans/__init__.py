"""Named queries over the driver tables, each next to the SQL it must agree with."""

import importlib

MODULES = ("traffic", "flows", "protocols", "detection", "search", "catalog", "graph", "anomaly", "live", "files", "streams")


def load():
    """All registered queries and oracle SQL: (queries, oracles)."""
    for m in MODULES:
        importlib.import_module(f"netlens.plans.{m}")
    from netlens.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
