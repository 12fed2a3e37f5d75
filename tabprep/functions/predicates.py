"""Row predicates with SQL's three values: rows where a predicate is unknown don't match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from .names import col

COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def family(kind: T.DataType) -> str:
    """numeric, boolean, datetime or string."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "datetime" if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else "string"


def check_literal(df: DataFrame, column: str, value: object) -> None:
    """A literal must be of the column's family, and finite."""
    if value is None:
        return
    want = family(df.schema[column].dataType)
    have = "boolean" if isinstance(value, bool) else "numeric" if isinstance(value, int | float) else "string"
    if want != have and not (want == "datetime" and have == "string"):
        raise Refused("incompatible_value_type", f"{have} for {want} column {column}")
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise Refused("non_finite_value", column)


def predicate(column: str, operator: str, value: object = None) -> Column:
    c = col(column)
    if operator in ("is_null", "is_not_null"):
        if value is not None:
            raise Refused("value_not_allowed", operator)
        return c.isNull() if operator == "is_null" else c.isNotNull()
    if operator == "eq":
        return c.isNull() if value is None else c == F.lit(value)
    if operator == "ne":
        return c.isNotNull() if value is None else c != F.lit(value)
    if value is None:
        raise Refused("value_required", operator)
    if operator in COMPARE:
        return getattr(c, COMPARE[operator])(F.lit(value))
    if operator == "contains_literal":
        return F.contains(c.cast("string"), F.lit(str(value)))
    raise Refused("unknown_operator", operator)
