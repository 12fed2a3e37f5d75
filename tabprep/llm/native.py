"""Small helpers for expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once; inside other lambdas Spark would do it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + of(x).cast("long"))


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of equal id and text only: the id's length comes first (-1 for null), so that ids and texts may hold any characters."""
    own_id, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.length(own_id), F.lit(-1)).cast("string"), F.coalesce(own_id, F.lit("")), text)))
