"""Columns by their exact names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of this very name; dots in it don't reach into structs."""
    return F.col(quoted(name))


def free(columns: Iterable[str], name: str) -> str:
    """The name, with as many underscores behind it as it takes to differ from the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
