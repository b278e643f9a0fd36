"""Column names that a table doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(*tables: DataFrame | list[str]) -> str:
    """A prefix that no column of the tables begins with, whatever its case: what is named with it can't clash."""
    taken = [c.lower() for t in tables for c in (t.columns if isinstance(t, DataFrame) else t)]
    prefix = "__own"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix + "_"
