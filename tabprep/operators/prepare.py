"""Preparation steps. Each takes a table with the system columns and gives the changed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.identity import ROW_ID, ROW_ORDER, SYSTEM, number_rows, user_columns
from ..functions.names import col, free
from ..functions.predicates import check_literal, family, predicate
from .quantiles import quantiles

TARGETS = {"numeric": "double", "string": "string", "categorical": "string", "boolean": "boolean", "datetime": "timestamp_ntz"}
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI]nf(inity)?|[nN]a[nN])\s*$"


def _user(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns or len(set(columns)) != len(columns):
        raise Refused("invalid_column_selection")
    for c in columns:
        if c in SYSTEM:
            raise Refused("system_column", c)
        if c not in df.columns:
            raise Refused("unknown_column", c)
    return columns


def filter_rows(df: DataFrame, column: str, operator: str, value: object = None) -> DataFrame:
    if operator != "contains_literal":
        check_literal(df, column, value)
    return df.where(predicate(column, operator, value))


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in _user(df, columns):
        df = df.where(col(c).isNotNull())
    return df


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if len(_user(df, columns)) == len(user_columns(df)):
        raise Refused("cannot_drop_all_columns")
    return df.drop(*columns)


def rename_column(df: DataFrame, column: str, name: str) -> DataFrame:
    _user(df, [column])
    if not (name := name.strip()):
        raise Refused("empty_column_name")
    if name in df.columns and name != column:
        raise Refused("duplicate_column_name", name)
    return df.withColumnRenamed(column, name)


def lenient_cast(df: DataFrame, column: str, target: str):
    """The cast value, null where it isn't one. Pairs of types that have no conversion give null."""
    if target not in TARGETS:
        raise Refused("unknown_cast_target", target)
    c, have, want = col(column), family(df.schema[column].dataType), TARGETS[target]
    if want == "timestamp_ntz" and have in ("numeric", "boolean") or want in ("double", "boolean") and have == "datetime":
        return F.lit(None).cast(want)
    if have == "string" and want == "double":
        return F.when(c.rlike(_NUMBER), c.try_cast(want))
    if have == "string" and want == "timestamp_ntz":
        return F.when(c.rlike(r"^\s*[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}"), c.try_cast(want))
    return c.try_cast(want)


def cast_column(df: DataFrame, column: str, target: str, failure_policy: str = "strict") -> DataFrame:
    _user(df, [column])
    new = lenient_cast(df, column, target)
    if failure_policy == "strict" and df.where(col(column).isNotNull() & new.isNull()).limit(1).count():
        raise Refused("cast_failure", column)
    return df.withColumn(column, new)


def mode_value(df: DataFrame, column: str):
    """The most frequent value that isn't null; of equally frequent ones that with the smallest text."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.desc("n"), F.col("value").cast("string")).first()
    return None if row is None else row[0]


def fill_values(df: DataFrame, columns: list[str], strategy: str, constant: object = None) -> dict:
    """What each column is filled with; None where that isn't defined."""
    _user(df, columns)
    if strategy == "constant":
        for c in columns:
            check_literal(df, c, constant)
        return dict.fromkeys(columns, constant)
    if strategy in ("mean", "median"):
        for c in columns:
            if family(df.schema[c].dataType) != "numeric":
                raise Refused("numeric_fill_required", c)
        if strategy == "mean":
            learned = dict(zip(columns, df.agg(*(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns))).first(), strict=True))
        else:
            learned = {c: v for c, (v,) in quantiles(df, columns, [0.5]).items()}
        for c, v in learned.items():
            if v is not None and (v != v or v in (float("inf"), float("-inf"))):
                raise Refused("non_finite_value", c)
        return learned
    if strategy == "mode":
        return {c: mode_value(df, c) for c in columns}
    raise Refused("unknown_fill_strategy", strategy)


def fill_missing(df: DataFrame, columns: list[str], strategy: str, constant: object = None) -> DataFrame:
    return fill_with(df, fill_values(df, columns, strategy, constant))


def fill_with(df: DataFrame, learned: dict) -> DataFrame:
    """Columns whose value is None stay as they are."""
    known = {c: v for c, v in learned.items() if v is not None}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in known.items()}) if known else df


def remove_duplicates(df: DataFrame, columns: list[str], keep: str = "first") -> DataFrame:
    """The row of the lowest order for each key: a partial minimum, then the rows that have it."""
    if keep != "first":
        raise Refused("unsupported_keep", keep)
    least = free(df.columns, "_first")
    first = df.groupBy(*(col(c) for c in _user(df, columns))).agg(F.min(ROW_ORDER).alias(least)).select(least)
    return df.join(first, F.col(ROW_ORDER) == F.col(least), "left_semi")


def replace_values(df: DataFrame, column: str, mapping: list[tuple]) -> DataFrame:
    """Exact replacements in order, the first that matches; null is allowed on both sides."""
    _user(df, [column])
    if not mapping:
        raise Refused("empty_mapping")
    c, new = col(column), None
    for old, to in mapping:
        check_literal(df, column, old)
        check_literal(df, column, to)
        hit = c.isNull() if old is None else c == F.lit(old)
        new = F.when(hit, F.lit(to)) if new is None else new.when(hit, F.lit(to))
    return df.withColumn(column, new.otherwise(c))


def replace_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values become null; NaN stays."""
    for c in _user(df, columns):
        if family(df.schema[c].dataType) != "numeric":
            raise Refused("numeric_column_required", c)
    return df.withColumns({c: F.when(F.abs(col(c)) == float("inf"), None).otherwise(col(c)) for c in columns if isinstance(df.schema[c].dataType, T.FractionalType)})


def append_rows(df: DataFrame, others: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of other versions (id, table) of the same columns, behind those of df. Their ids are made from version and row id."""
    if not others or len({k for k, _ in others}) != len(others):
        raise Refused("invalid_append_inputs")
    want = [(c, family(df.schema[c].dataType)) for c in user_columns(df)]
    for k, other in others:
        if [(c, family(other.schema[c].dataType)) for c in user_columns(other)] != want:
            raise Refused("incompatible_append_schema", k)
    start = df.agg(F.max(ROW_ORDER)).first()[0]
    at = 0 if start is None else start + 1
    which, old = free(df.columns, "_input"), free(df.columns, "_old")
    added = None
    for i, (k, other) in enumerate(others):
        part = other.select(F.md5(F.concat_ws(":", F.lit(k), F.col(ROW_ID))).alias(ROW_ID), F.lit(i).alias(which), F.col(ROW_ORDER).alias(old), *(col(c) for c in user_columns(other)))
        added = part if added is None else added.unionByName(part)
    numbered = number_rows(added, [which, old], start=at).drop(which, old)
    return df.unionByName(numbered)


STEPS = {
    "filter_rows": filter_rows,
    "drop_missing_rows": drop_missing_rows,
    "drop_columns": drop_columns,
    "rename_column": rename_column,
    "cast_column": cast_column,
    "fill_missing": fill_missing,
    "remove_duplicates": remove_duplicates,
    "replace_values": replace_values,
    "replace_non_finite": replace_non_finite,
    "append_rows": append_rows,
}
