"""Reading a table: projections, filters, single aggregates, duplicates, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.identity import ROW_ID, ROW_ORDER
from ..functions.names import col, free
from ..functions.predicates import predicate
from .quantiles import quantiles


def _checked(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns or len(set(columns)) != len(columns):
        raise Refused("invalid_column_selection")
    if missing := [c for c in columns if c not in df.columns]:
        raise Refused("unknown_column", ", ".join(missing))
    return columns


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(ROW_ORDER).select([col(c) for c in _checked(df, columns)])


def filtered_projection(df: DataFrame, columns: list[str], filters: list[tuple]) -> DataFrame:
    """All filters (column, operator[, value]) must hold."""
    keep = reduce(Column.__and__, (predicate(*f) for f in filters)) if filters else F.lit(True)
    return select_columns(df.where(keep), columns)


def ordered_export(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return select_columns(df, columns or df.columns)


def aggregate_value(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One row, value: count, min, max, sum (integers without overflow), mean or median of the values that aren't null."""
    c = col(column)
    if kind == "median":
        return df.sparkSession.createDataFrame([tuple(quantiles(df, [column], [0.5])[column])], "value double")
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    makes = {"count": F.count, "min": F.min, "max": F.max, "sum": lambda x: F.sum(x.cast("decimal(38,0)") if whole else x), "mean": F.avg}
    if kind not in makes:
        raise Refused("unknown_aggregate", kind)
    return df.agg(makes[kind](c).alias("value"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every row whose key occurs more than once. Keys are counted before the shuffle; rows join the repeated ones."""
    names = [free(df.columns, f"_k{i}") for i in range(len(_checked(df, columns)))]
    keys = df.groupBy(*(col(c).alias(k) for c, k in zip(columns, names, strict=True))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(names)
    same = reduce(Column.__and__, (col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, names, strict=True)))
    return df.join(keys, same, "left_semi").orderBy(ROW_ORDER)


def sample_changes(df: DataFrame, changed: Column, n: int = 100) -> DataFrame:
    """The first rows that a change touches, by row order."""
    return df.where(changed).orderBy(ROW_ORDER).limit(n).select(ROW_ID, ROW_ORDER)


def sample_offset(df: DataFrame, offset: int, n: int = 100) -> DataFrame:
    return sample_changes(df, F.col(ROW_ORDER) >= offset, n)


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(ROW_ORDER).limit(n)


def removed_duplicates(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """A sample of the rows that remove_duplicates takes out."""
    least = free(df.columns, "_first")
    first = df.groupBy(*(col(c) for c in _checked(df, columns))).agg(F.min(ROW_ORDER).alias(least)).select(least)
    return df.join(first, F.col(ROW_ORDER) == F.col(least), "left_anti").orderBy(ROW_ORDER).limit(n).select(ROW_ID, ROW_ORDER)
