"""Small derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units, each 1,024 times the one before.
UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(size: Column) -> Column:
    """A size as text in the largest unit below it."""
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for i in range(3, -1, -1):
        out = F.when(size < 1024.0 ** (i + 1), F.format_string(f"%.1f {UNITS[i]}", size / F.lit(1024.0**i))).otherwise(out)
    return out


def metric_state(value: Column) -> Column:
    """finite, not_defined, positive_infinity or negative_infinity."""
    inf = float("inf")
    return F.when(value.isNull() | F.isnan(value), "not_defined").when(value == inf, "positive_infinity").when(value == -inf, "negative_infinity").otherwise("finite")


def interpretation(precision: Column, recall: Column, fp: Column, tp: Column) -> Column:
    """screening when half or more of the alarms are false, selective when precision and recall are both high, else review."""
    return F.when((precision < 0.5) | (fp > tp), "screening").when((precision >= 0.8) & (recall >= 0.8), "selective").otherwise("review")


def sample_support(positive: Column, negative: Column) -> Column:
    """How far an evaluation can be trusted, by its smaller class."""
    low = F.least(positive, negative)
    return F.when(low < 10, "severe").when(low < 30, "limited").otherwise("none")


def sample_diagnosis(positive: Column, negative: Column) -> Column:
    """severity (as sample_support), recall_resolution (what one positive row makes of recall; null without any) and limited_sample."""
    severity = sample_support(positive, negative)
    return F.struct(severity.alias("severity"), (F.lit(1.0) / F.when(positive > 0, positive)).alias("recall_resolution"), (severity != "none").alias("limited_sample"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))
