"""Collects the query modules of this folder: each has QUERIES and ORACLES by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "analytics", "frames", "roundtrips", "models", "topics", "corpus")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"millrace.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict:
    """Name to callable ``(spark, sf_dir) -> DataFrame``."""
    return _merged("QUERIES")


def oracle_sql() -> dict:
    """Name to DuckDB SQL; queries that SQL cannot express are absent."""
    return _merged("ORACLES")
