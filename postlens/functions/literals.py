"""Literal arrays and maps as one SQL expression (one call, not one per value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_string(value: str) -> str:
    """A Spark SQL string literal (backslash and quote escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    """A Spark SQL double literal that round-trips exactly."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def string_array_sql(values) -> str:
    return "array(" + ", ".join(sql_string(v) for v in values) + ")"


def string_array(values) -> Column:
    """``array('a', 'b', ...)`` built by the SQL parser in one call."""
    return F.expr(string_array_sql(values))


def string_map(keys, values) -> Column:
    """``map_from_arrays`` of two string arrays (constant-folded)."""
    return F.expr(f"map_from_arrays({string_array_sql(keys)}, {string_array_sql(values)})")
