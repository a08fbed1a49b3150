"""The queries of this subpackage and their SQL twins, gathered from the operators' modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("secrets", "units", "langid", "packing", "hosts", "decontam", "imatch", "wavelet", "counts", "simhash",
           "merkle", "negatives", "suffixes")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
