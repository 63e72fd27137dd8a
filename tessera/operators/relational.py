"""Joins, groups, sorts and limits with the engine's rules for NULL and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError

AGGREGATES = ("count", "sum", "avg", "min", "max")


def order(column: Column, descending: bool = False) -> Column:
    """NULL counts as the largest value: last ascending, first descending."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", name: str = "right") -> DataFrame:
    """Equi-join that keeps both keys; a column of ``right`` whose name is taken becomes ``name.column``."""
    if how not in ("inner", "left", "right", "full"):
        raise EngineError(f"unknown join: {how}")
    taken = set(left.columns)
    renamed = right.select(*[right[f"`{c}`"].alias(f"{name}.{c}" if c in taken else c) for c in right.columns])
    key = f"{name}.{right_key}" if right_key in taken else right_key
    return left.join(renamed, left[f"`{left_key}`"] == renamed[f"`{key}`"], how)


def aggregate(function: str, column: str | None, alias: str | None = None) -> Column:
    """An aggregate under its default name; a sum over nothing is 0."""
    f = function.lower()
    if f not in AGGREGATES:
        raise EngineError(f"unknown aggregate: {function}")
    if column in (None, "*"):
        if f != "count":
            raise EngineError(f"{function}(*) is not defined")
        return F.count(F.lit(1)).alias(alias or "count_all")
    c = F.col(f"`{column}`")
    made = {"count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0))}[f](c)
    return made.alias(alias or f"{f}_{column.split('.')[-1]}")


def grouped(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Groups (NULL keys together); without aggregates the distinct keys; without keys one row."""
    cols = [F.col(f"`{k}`") for k in keys]
    if not keys:
        return df.agg(*aggregates)
    return df.groupBy(*cols).agg(*aggregates) if aggregates else df.select(*cols).distinct()


def top(df: DataFrame, keys: list[Column], limit: int | None = None) -> DataFrame:
    """Sorted, and cut to ``limit`` rows by per-partition heaps where one is given."""
    if limit is not None and limit < 0:
        raise EngineError("LIMIT must not be negative")
    out = df.orderBy(*keys) if keys else df
    return out if limit is None else out.limit(limit)


def union_of_lookups(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows equal to any value, each once: an IN list that Parquet filters see."""
    return df.filter(F.col(f"`{column}`").isin(*values))
