"""Profiling of tables and of binary targets, in a few wide aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions.names import col
from ..functions.predicates import family
from ..storage import materialize
from .quantiles import quantiles

#: Columns of one aggregate with exact distinct counts; more make several.
WIDE = 50
#: Relative deviation of the sketches, and five times as much, within which an estimate is taken to be.
SKETCH, ERROR = 0.02, 0.1
#: Columns of about so few values are counted exactly.
FEW = 30
STATS = "column string, position int, family string, n_rows long, n_missing long, n_distinct long, exact boolean"


def _missing(df: DataFrame, c: str) -> Column:
    """NaN counts as missing."""
    return col(c).isNull() | F.isnan(col(c)) if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType) else col(c).isNull()


def _filled(df: DataFrame, c: str) -> Column:
    return F.when(~_missing(df, c), col(c))


def _in_doubt(name: str, kind: str, n_rows: int, filled: int, estimate: int) -> bool:
    """Whether an exact count of a column's values could decide a check otherwise than the estimate does, or is reported."""
    low, high = estimate * (1 - ERROR), estimate * (1 + ERROR)
    if estimate <= FEW:
        return True
    if kind != "numeric" and high > max(20, n_rows // 5):  # a reported count
        return True
    if named_like_id(name) and low <= 0.5 * filled <= high:
        return True
    return kind not in ("numeric", "boolean") and filled >= 50 and high >= 0.995 * filled


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: column, position, family, n_rows, n_missing, n_distinct (without missing), exact.

    One pass of sketches, without multiplying rows; columns of one value are known by their least and greatest. Exact counts follow for columns
    only that a check below could see otherwise, or whose count it reports; n_distinct of the others is within ERROR of the truth.
    """
    columns = columns or df.columns
    if not columns:
        return df.sparkSession.createDataFrame([], STATS)
    made = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = _filled(df, c)
        made += [F.count(F.when(_missing(df, c), 1)).alias(f"m{i}"), F.approx_count_distinct(v, SKETCH).alias(f"d{i}"), (F.min(v) == F.max(v)).alias(f"s{i}")]
    got = df.agg(*made).first()
    kinds = [family(df.schema[c].dataType) for c in columns]
    known = {i: 0 if got[f"s{i}"] is None else 1 for i in range(len(columns)) if got[f"s{i}"] is not False}
    doubtful = [i for i, c in enumerate(columns) if i not in known and _in_doubt(c, kinds[i], got["n"], got["n"] - got[f"m{i}"], got[f"d{i}"])]
    for at in range(0, len(doubtful), WIDE):
        some = doubtful[at : at + WIDE]
        known |= {int(k[1:]): n for k, n in df.agg(*(F.count_distinct(_filled(df, columns[i])).alias(f"d{i}") for i in some)).first().asDict().items()}
    rows = [(c, i, kinds[i], got["n"], got[f"m{i}"], known.get(i, got[f"d{i}"]), i in known) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, STATS)


def missing_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: column, family, n_rows, n_missing. One aggregate without distinct counts: no row is multiplied."""
    columns = columns or df.columns
    made = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(columns)))
    return made.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(family(df.schema[c].dataType)).alias("family"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)))))


def schema_overview(df: DataFrame) -> DataFrame:
    share = F.round(100.0 * F.col("n_missing") / F.when(F.col("n_rows") > 0, F.col("n_rows")), 2)
    return missing_stats(df).select("column", "family", "n_missing", share.alias("missing_pct"))


def missing_cells(df: DataFrame) -> DataFrame:
    return missing_stats(df).agg(F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing_cells"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind; missing cells are alike, NaN or null."""
    keys = df.groupBy(*(_filled(df, c).alias(f"k{i}") for i, c in enumerate(df.columns))).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def binary_candidates(df: DataFrame) -> DataFrame:
    return column_stats(df).where("n_distinct = 2").select("column")


def columns_missing(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    return (stats or missing_stats(df)).where("n_missing > 0").select("column", "n_missing")


def constant_columns(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """At most one value, a missing one counting as a value. stats: column_stats of df, where known (here and below)."""
    return (stats or column_stats(df)).where("n_distinct + cast(n_missing > 0 as int) <= 1").select("column")


def high_cardinality(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    return (stats or column_stats(df)).where("family <> 'numeric' and n_distinct > greatest(20, cast(floor(0.2 * n_rows) as bigint))").select("column", "n_distinct")


def named_like_id(name: str) -> bool:
    name = name.lower().replace("-", "_").replace(" ", "_")
    return name == "id" or name.endswith("_id") or "uuid" in name or "identifier" in name


def possible_ids(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Named like an id and half unique, or almost unique texts and dates."""
    named = F.col("column").isin([c for c in df.columns if named_like_id(c)])
    filled = F.col("n_rows") - F.col("n_missing")
    unique = F.col("n_distinct") / F.when(filled > 0, filled)
    other = ~F.col("family").isin("numeric", "boolean") & (filled >= 50) & (unique >= 0.995)
    return (stats or column_stats(df)).where((named & (unique >= 0.5)) | other).select("column")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def outliers_iqr(df: DataFrame, factor: float = 3.0) -> DataFrame:
    """Per numeric column: values beyond factor interquartile ranges from the quartiles; columns without any are left out. NaN is missing."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    places = [f"v{i}" for i in range(len(names))]
    values = df.select(*(_filled(df, c).alias(p) for c, p in zip(names, places, strict=True)))
    quartiles = quantiles(values, places, [0.25, 0.75])
    counts = []
    for p in places:
        q1, q3 = (q or 0.0 for q in quartiles[p])
        wide = q3 - q1
        odd = (F.col(p) < q1 - factor * wide) | (F.col(p) > q3 + factor * wide)
        counts.append(F.coalesce(F.sum((odd if wide > 0 else F.lit(False)).cast("long")), F.lit(0)).alias(p))
    found = values.agg(*counts)
    return found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(p).alias("outliers")) for c, p in zip(names, places, strict=True))))).where("outliers > 0")


def scaling_hint(df: DataFrame) -> DataFrame:
    """Whether the spreads of numeric columns differ more than tenfold; false with fewer than two. NaN is missing."""
    names = numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([(False,)], "scaling_recommended boolean")
    spread = df.agg(*(F.stddev_samp(_filled(df, c)).alias(f"v{i}") for i, c in enumerate(names)))
    places = [f"v{i}" for i in range(len(names))]
    low, high = F.least(*places), F.greatest(*places)
    return spread.select(F.coalesce(F.when(low == 0, high > 0).otherwise(high / low > 10), F.lit(False)).alias("scaling_recommended"))


def _classes(df: DataFrame, target: str) -> DataFrame:
    """class and its number of rows n."""
    return df.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_summary(df: DataFrame, target: str) -> DataFrame:
    counts = materialize(_classes(df, target))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("class", F.col("n").alias("count"), F.round(100.0 * F.col("n") / total, 2).alias("percentage"))


def validate_target(df: DataFrame, target: str) -> DataFrame:
    """status: target_missing, target_not_binary, target_too_small or target_valid, in this order."""
    if target not in df.columns:
        raise Refused("unknown_column", target)
    facts = _classes(df, target).agg(F.sum(F.col("class").isNull().cast("int")).alias("nulls"), F.count("class").alias("classes"), F.min(F.when(F.col("class").isNotNull(), F.col("n"))).alias("low"))
    return facts.select(F.when(F.col("nulls") > 0, "target_missing").when(F.col("classes") != 2, "target_not_binary").when(F.col("low") < 3, "target_too_small").otherwise("target_valid").alias("status"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    share = _classes(df, target).where(F.col("class").isNotNull()).agg((F.min("n") / F.sum("n")).alias("minority"))
    return share.select(F.round("minority", 6).alias("minority"), (F.col("minority") < 0.3).alias("imbalanced"), (F.col("minority") < 0.1).alias("severe"))


def prevalence(df: DataFrame, target: str) -> DataFrame:
    """The positive class is the largest value."""
    top = df.agg(F.max(col(target))).first()[0]
    return df.agg(F.max(col(target)).alias("positive"), F.round(F.avg((col(target) == F.lit(top)).cast("double")), 6).alias("prevalence"))


def fill_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return missing_stats(df, columns).select("column", "n_missing")


def estimate_bytes(df: DataFrame) -> DataFrame:
    """Bytes of all cells: texts by length, others by the width of their type."""
    widths = {"long": 8, "integer": 4, "short": 2, "byte": 1, "double": 8, "float": 4, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    cells = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(widths.get(f.dataType.typeName(), 8)) for f in df.schema.fields]
    return df.agg(F.coalesce(F.sum(sum(cells, F.lit(0)).cast("long")), F.lit(0)).alias("bytes"))


def quality_findings(df: DataFrame, target: str | None = None) -> DataFrame:
    """Ordered rows: position, severity, finding, n, columns; one row 'ok' if nothing is found."""
    features = df.drop(target) if target else df
    every = column_stats(df)
    stats = every.where(F.col("column") != target) if target else every
    found = []

    def add(severity: str, finding: str, columns: list[str], n: int) -> None:
        if n:
            found.append((len(found), severity, finding, n, sorted(columns)))

    gaps = {r["column"]: r["n_missing"] for r in columns_missing(df, every).collect()}
    add("warning", "missing_values", list(gaps), sum(gaps.values()))
    add("warning", "duplicate_rows", [], duplicate_count(df).first()[0])
    for severity, finding, table in (("issue", "constant_columns", constant_columns(features, stats)), ("warning", "high_cardinality", high_cardinality(features, stats)), ("warning", "possible_ids", possible_ids(features, stats)), ("warning", "outliers", outliers_iqr(features))):
        names = [r["column"] for r in table.collect()]
        add(severity, finding, names, len(names))
    if target and imbalance(df, target).first()["severe"]:
        add("issue", "severe_imbalance", [target], 1)
    return df.sparkSession.createDataFrame(found or [(0, "ok", "no_findings", 0, [])], "position int, severity string, finding string, n long, columns array<string>")


def diagnose(df: DataFrame, target: str) -> DataFrame:
    """All checks of a table with a binary target as one report: check, column (null for the table), value as text."""
    features = df.drop(target)
    every = column_stats(df)
    stats = every.where(F.col("column") != target)
    checks = [
        ("class_count", class_summary(df, target), F.col("class").cast("string"), F.col("count")),
        ("minority", imbalance(df, target), F.lit(target), F.col("minority")),
        ("imbalanced", imbalance(df, target), F.lit(target), F.col("imbalanced")),
        ("missing", columns_missing(df, every), F.col("column"), F.col("n_missing")),
        ("constant", constant_columns(features, stats), F.col("column"), F.lit(True)),
        ("high_cardinality", high_cardinality(features, stats), F.col("column"), F.col("n_distinct")),
        ("possible_id", possible_ids(features, stats), F.col("column"), F.lit(True)),
    ]
    if numeric_columns(features):
        checks.append(("outliers", outliers_iqr(features), F.col("column"), F.col("outliers")))
    if len(numeric_columns(features)) > 1:
        checks.append(("scaling_recommended", scaling_hint(features), F.lit(None), F.col("scaling_recommended")))
    out = None
    for name, found, column, value in checks:
        part = found.select(F.lit(name).alias("check"), column.cast("string").alias("column"), value.cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
