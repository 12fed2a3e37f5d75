"""Row identity, row order and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .names import col, free

ROW_ID, ROW_ORDER = "_row_id", "_row_order"
SYSTEM = (ROW_ID, ROW_ORDER)


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM]


def number_rows(df: DataFrame, order: list[Column | str], column: str = ROW_ORDER, start: int = 0) -> DataFrame:
    """Dense numbers in the given order. Rows are sorted by ranges; only the ranges' sizes go through the driver, never a window over all rows."""
    part, place, first = (free(df.columns, c) for c in ("_part", "_at", "_first"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    offsets, at = [], start
    for k, n in sorted(tuple(r) for r in placed.groupBy(part).count().collect()):
        offsets.append((k, at))
        at += n
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{part} int, {first} long"))
    numbered = placed.join(offset, part).withColumn(column, F.col(first) + F.col(place))
    return numbered.drop(part, place, first)


def with_identity(df: DataFrame, order: list[Column | str], digest: str) -> DataFrame:
    """System columns first: the same source gives the same ids."""
    numbered = number_rows(df, order)
    return numbered.select(F.md5(F.concat_ws(":", F.lit(digest), F.col(ROW_ORDER))).alias(ROW_ID), ROW_ORDER, *(col(c) for c in df.columns))


#: Consecutive row orders of a leaf of the fingerprint's tree, and leaves or nodes of a node above.
LEAF = 4096


def typed_cell(df: DataFrame, column: str) -> Column:
    """A cell as text that tells its type and where it ends; NaN counts as missing."""
    kind = df.schema[column].dataType.typeName()
    c = col(column)
    missing = (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()
    text = c.cast("string")
    return F.when(missing, "null").otherwise(F.concat(F.lit(f"{kind}:"), F.length(text).cast("string"), F.lit(":"), text))


def _joined(parts: DataFrame, leaf: int, order: str) -> DataFrame:
    """block, rows, digest: of the digests (at most leaf of them, in order) of each block of what is below."""
    each = F.collect_list(F.struct(F.col(order).alias("at"), F.col("digest")))
    text = F.array_join(F.transform(F.array_sort("all"), lambda x: F.lower(F.hex(x["digest"]))), "")
    made = parts.groupBy(F.floor(F.col(order) / leaf).alias("block")).agg(each.alias("all"), F.sum("rows").alias("rows"))
    return made.select("block", "rows", F.unhex(F.sha2(text, 256)).alias("digest"))


def block_digests(df: DataFrame, leaf: int = LEAF) -> DataFrame:
    """block (of ``leaf`` consecutive row orders), rows, digest (sha256 in hex of its rows' sha256, in row order)."""
    cells = F.concat_ws(",", *(typed_cell(df, c) for c in [ROW_ORDER, *user_columns(df)]))
    rows = df.select(F.col(ROW_ORDER).alias("at"), F.lit(1).cast("long").alias("rows"), F.unhex(F.sha2(cells, 256)).alias("digest"))
    return _joined(rows, leaf, "at").withColumn("digest", F.lower(F.hex("digest")))


def changed_blocks(before: DataFrame, after: DataFrame, leaf: int = LEAF) -> DataFrame:
    """block, first and last row order: where two tables' rows differ."""
    one, two = (block_digests(df, leaf).select("block", F.col("digest").alias(n)) for df, n in ((before, "one"), (after, "two")))
    both = one.join(two, "block", "full").where(~F.col("one").eqNullSafe(F.col("two")))
    return both.select("block", (F.col("block") * leaf).alias("first"), (F.col("block") * leaf + leaf - 1).alias("last"))


def content_fingerprint(df: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row, fingerprint: equal for equal ordered content, however the rows are partitioned.

    A tree of SHA-256 digests: of rows within blocks of consecutive orders, of the blocks' digests within blocks of these, and so on. No task holds more than
    ``leaf`` digests of one block, and changed_blocks finds where two tables differ.
    """
    level = materialize(block_digests(df, leaf).withColumn("digest", F.unhex("digest")))
    top = level.agg(F.max("block")).first()[0] or 0
    while top > 0:
        level, top = _joined(level, leaf, "block"), top // leaf
    names = F.lit(",".join(f"{len(c)}:{c}:{df.schema[c].dataType.simpleString()}" for c in user_columns(df)))
    root = F.concat_ws(",", F.sort_array(F.collect_list(F.lower(F.hex("digest")))))  # one, or none without rows
    return level.agg(F.sha2(F.concat_ws("|", names, root, F.coalesce(F.sum("rows"), F.lit(0)).cast("string")), 256).alias("fingerprint"))
