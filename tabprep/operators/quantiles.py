"""Exact quantiles of any number of values: no task sees all values of a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..storage import materialize


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Per numeric column the interpolated quantiles of its values that aren't null (NaN is the greatest); None without values.

    Equal values are counted before the shuffle and dealt out by ranges. Only the ranges' totals and the values beside each quantile
    go to the driver.
    """
    if not columns:
        return {}
    cells = F.array(*(F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)))
    counts = df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("c", "v").count()
    ranged = materialize(counts.repartitionByRange("c", "v").withColumn("p", F.spark_partition_id()))
    sums: dict[int, list[tuple[int, int]]] = {}
    for c, p, n in sorted(tuple(r) for r in ranged.groupBy("c", "p").agg(F.sum("count")).collect()):
        sums.setdefault(c, []).append((p, n))
    wanted = []
    for c, parts in sums.items():
        last = sum(n for _, n in parts) - 1
        ranks = sorted({int(r) for s in shares for r in (math.floor(last * s), math.ceil(last * s))})
        at = 0
        for p, n in parts:
            wanted += [(c, p, r, r - at) for r in ranks if at <= r < at + n]
            at += n
    if not wanted:
        return {c: [None] * len(shares) for c in columns}
    places = df.sparkSession.createDataFrame(wanted, "c int, p int, rank long, inside long")
    hit = ranged.join(F.broadcast(places.select("c", "p").distinct()), ["c", "p"], "left_semi")
    upto = hit.withColumn("upto", F.sum("count").over(Window.partitionBy("c", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    near = upto.join(F.broadcast(places), ["c", "p"]).where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("count")))
    found = {(r["c"], r["rank"]): r["v"] for r in near.select("c", "rank", "v").collect()}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        if i not in sums:
            out[c] = [None] * len(shares)
            continue
        last, out[c] = sum(n for _, n in sums[i]) - 1, []
        for s in shares:
            place = last * s
            low, high = found[i, math.floor(place)], found[i, math.ceil(place)]
            part = place - math.floor(place)
            out[c].append(low if low == high or not part else low * (1 - part) + high * part)
    return out
