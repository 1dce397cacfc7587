"""Queries over the driver's tables, each with the SQL that must give the same result."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _group in (
    "schema_queries", "scalar_queries", "row_queries", "sheet_queries", "enrichment_queries",
    "table_queries", "layout_queries", "source_queries",
):
    import_module(f"{__name__}.{_group}")

__all__ = ["ORACLES", "QUERIES"]
