"""All registered queries and their SQL twins."""

import importlib

_MODULES = ["ingest", "enrichment", "marts", "categorize", "stores"]


def _load():
    for name in _MODULES:
        importlib.import_module(f"ledgerloom.catalog.{name}")
    return importlib.import_module("ledgerloom.catalog.base")


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
