"""Exact stratified splits, and source combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.names import col, free, quoted
from ..storage import materialize

PARTS = ("train", "validation", "test")
#: Classes beyond which a split is refused: quotas are worked out by the driver.
MOST_CLASSES = 10_000


def _largest_remainder(counts: dict, n: int) -> dict:
    """Shares n among classes in proportion to their counts."""
    total = sum(counts.values())
    exact = {k: n * c / total for k, c in counts.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))[: n - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, target: str, id_col: str, seed: int = 42) -> DataFrame:
    """Adds split: 70 % train, 15 % validation, 15 % test, each class in proportion and exact in number.

    Rows are dealt by a hash of their id. Only the hash buckets that a quota's border falls into are ranked, so a class of any
    size needs no window over all its rows.
    """
    hash_, bucket, last_v, last_w, start, at_v, at_w = (free(df.columns, c) for c in ("_hash", "_bucket", "_last_v", "_last_w", "_start", "_v", "_w"))
    hashed = materialize(df.withColumn(hash_, F.xxhash64(col(id_col), F.lit(seed))).withColumn(bucket, F.shiftright(hash_, 48)))
    counts = {r[0]: r[1] for r in hashed.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise Refused("too_many_classes", target)
    total = sum(counts.values())
    n_rest = -(-total * 3 // 10)
    rest = _largest_remainder(counts, n_rest) if counts else {}
    n_test = -(-n_rest // 2)
    test = _largest_remainder(rest, n_test) if n_rest else {}
    if any(c < 3 or rest[k] < 2 or test[k] < 1 for k, c in counts.items()):
        raise Refused("split_too_small")
    # per class and bucket of hashes: rows before it and in it; those whose rows all go to one part need no ranks
    sizes = hashed.groupBy(col(target).alias("t"), F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = df.sparkSession.createDataFrame([(k, counts[k] - rest[k], counts[k] - test[k]) for k in counts], f"q {df.schema[target].dataType.simpleString()}, v long, w long")
    placed = sizes.select("t", "b", before.alias("start"), (before + F.col("n")).alias("stop")).join(F.broadcast(quotas), F.col("t").eqNullSafe(F.col("q")))
    # a border lies within one bucket, or between two: two rows a class at most
    within = lambda q: (F.col("start") < F.col(q)) & (F.col(q) < F.col("stop"))
    borders = materialize(placed.where(within("v") | within("w")).select(F.col("t").alias("bt"), F.col("b").alias("bb"), F.col("start").alias(start)))
    cuts = placed.groupBy(F.col("t").alias("ct")).agg(F.max(F.when(F.col("stop") <= F.col("v"), F.col("b"))).alias(last_v), F.max(F.when(F.col("stop") <= F.col("w"), F.col("b"))).alias(last_w), F.max("v").alias(at_v), F.max("w").alias(at_w))
    cuts = materialize(cuts)
    dealt = hashed.join(F.broadcast(cuts), hashed[quoted(target)].eqNullSafe(cuts["ct"])).drop(cuts["ct"])
    on = dealt[quoted(target)].eqNullSafe(borders["bt"]) & (dealt[bucket] == borders["bb"])
    dealt = dealt.join(F.broadcast(borders), on, "left").drop(borders["bt"], borders["bb"])
    low = lambda last: F.coalesce(F.col(bucket) <= F.col(last), F.lit(False))
    own, split = [col(c) for c in df.columns if c != "split"], lambda x: x.alias("split")
    inner = dealt.where(F.col(start).isNull()).select(*own, split(F.when(low(last_v), PARTS[0]).when(low(last_w), PARTS[1]).otherwise(PARTS[2])))
    rank = F.col(start) + F.row_number().over(Window.partitionBy(col(target), F.col(bucket)).orderBy(hash_, col(id_col)))
    ranked = dealt.where(F.col(start).isNotNull()).withColumn(free(dealt.columns, "_rank"), rank)
    place = F.col(ranked.columns[-1])
    return inner.unionByName(ranked.select(*own, split(F.when(place <= F.col(at_v), PARTS[0]).when(place <= F.col(at_w), PARTS[1]).otherwise(PARTS[2]))))


def split_summary(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy("split", col(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    rows = F.sum("count").over(Window.partitionBy("split"))
    return counts.select("split", rows.alias("rows"), "class", "count", F.round(100.0 * F.col("count") / rows, 2).alias("percentage"))


def source_column_name(columns: list[str], base: str = "__source_file") -> str:
    """The first free name: the base, then with _1, _2 and so on."""
    name, i = base, 0
    while name in columns:
        i += 1
        name = f"{base}_{i}"
    return name


def combine_sources(parts: list[tuple[str, DataFrame]], add_source: bool = True) -> DataFrame:
    """The union of tables with the same columns (in any order) and families, by name; a column tells the source."""
    from ..functions.predicates import family

    first = parts[0][1]
    for name, part in parts[1:]:
        missing, more = sorted(set(first.columns) - set(part.columns)), sorted(set(part.columns) - set(first.columns))
        other = sorted(c for c in set(first.columns) & set(part.columns) if family(first.schema[c].dataType) != family(part.schema[c].dataType))
        if missing or more or other:
            raise Refused("incompatible_sources", f"{name}: missing {missing}, additional {more}, other types {other}")
    column = source_column_name(first.columns)
    out = None
    for name, part in parts:
        part = part.select([col(c) for c in first.columns])
        part = part.withColumn(column, F.lit(name)) if add_source else part
        out = part if out is None else out.unionByName(part)
    return out
