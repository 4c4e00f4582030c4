"""Constants as SQL text: a whole table of strings becomes one expression to parse, where a
literal call per string would cost thousands of round trips to the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY = "cast(array() AS array<string>)"


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def sql_array(items) -> str:
    items = list(items)
    return f"array({', '.join(map(sql_string, items))})" if items else EMPTY


def string_array(items) -> Column:
    return F.expr(sql_array(items))


def no_strings() -> Column:
    return F.expr(EMPTY)


def each(array: str) -> Column:
    """Explode a column that is costly to compute.  Exploding a bare column makes Spark infer a
    filter on its size and push it down to where the column is computed, computing it twice."""
    return F.explode(F.array_compact(array))
