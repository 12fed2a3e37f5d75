"""Every operator as a query over the given tables, with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.identity import block_digests, content_fingerprint, with_identity
from .operators import access, curves, models, prepare, profile, split
from .plans import versions
from .plans.recipe import preview_summary, recipe_preview, run_recipe
from .sources import csv, stored, workbooks
from .storage import materialize, new_folder

Query = Callable[[SparkSession, str], DataFrame]

#: Orders with missing and infinite values, texts that hold numbers, and a repeated key; the same expressions in both dialects.
_ORDERS = {
    "_row_id": "md5('orders:' || CAST(o_orderkey AS {text}))",
    "_row_order": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END",
    "amount": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END",
    "priority": "nullif(o_orderpriority, '5-LOW')",
    "status": "o_orderstatus",
    "grp": "o_custkey % 50",
    "placed": "o_orderdate",
    "mixed": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS {text}) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS {text}) ELSE o_orderstatus END",
}
BASE = "(SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _ORDERS.items()) + " FROM orders)"

#: Two made-up models over all line items; truth is the line status.
_MODELS = {"a": "((l_orderkey * 37 + l_partkey * 11) % 101) / 100.0", "b": "((l_partkey * 53 + l_suppkey * 7) % 97) / 96.0"}
_TRUTH = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"
SCORES = "(" + " UNION ALL ".join(f"SELECT '{m}' AS model, {_TRUTH} AS truth, CAST({e} AS DOUBLE) AS score FROM lineitem" for m, e in _MODELS.items()) + ")"
_GROUPS = f"g AS (SELECT model, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM {SCORES} GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)), r AS (SELECT *, tp / (tp + fp) AS precision_, tp / p AS recall_ FROM c)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*(f"{e.format(text='STRING')} AS {c}" for c, e in _ORDERS.items()))


def scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    parts = [lines.selectExpr(f"'{m}' AS model", f"{_TRUTH} AS truth", f"CAST({e} AS DOUBLE) AS score") for m, e in _MODELS.items()]
    return parts[0].union(parts[1])


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _on(of: Callable[[DataFrame], DataFrame], source: Query = base) -> Query:
    return lambda spark, d: of(source(spark, d))


_FILTERS = {
    "eq": ("status", "eq", "F", "status = 'F'"),
    "ne": ("priority", "ne", "1-URGENT", "priority <> '1-URGENT'"),
    "gt": ("price", "gt", 200000.0, "price > 200000"),
    "gte": ("grp", "gte", 25, "grp >= 25"),
    "lt": ("price", "lt", 50000.0, "price < 50000"),
    "lte": ("grp", "lte", 10, "grp <= 10"),
    "contains": ("mixed", "contains_literal", "1", "contains(mixed, '1')"),
    "is_null": ("price", "is_null", None, "price IS NULL"),
    "is_not_null": ("priority", "is_not_null", None, "priority IS NOT NULL"),
}
for _name, (_c, _op, _v, _where) in _FILTERS.items():
    add(f"filter_{_name}", _on(lambda df, a=(_c, _op, _v): prepare.filter_rows(df, *a)), f"SELECT * FROM {BASE} WHERE {_where}")
add("drop_missing", _on(lambda df: prepare.drop_missing_rows(df, ["price", "priority"])), f"SELECT * FROM {BASE} WHERE price IS NOT NULL AND priority IS NOT NULL")

add("select_columns", _on(lambda df: access.select_columns(df, ["_row_order", "status", "price"])), f"SELECT _row_order, status, price FROM {BASE}")
add("filtered_projection", _on(lambda df: access.filtered_projection(df, ["_row_order", "price"], [("grp", "lt", 20), ("priority", "is_not_null")])), f"SELECT _row_order, price FROM {BASE} WHERE grp < 20 AND priority IS NOT NULL")
add("ordered_export", _on(access.ordered_export), f"SELECT * FROM {BASE}")
add("drop_columns", _on(lambda df: prepare.drop_columns(df, ["mixed", "placed"])), f"SELECT * EXCLUDE (mixed, placed) FROM {BASE}")
add("rename_column", _on(lambda df: prepare.rename_column(df, "price", " total ")), f"SELECT * RENAME (price AS total) FROM {BASE}")
add("cast_lenient", _on(lambda df: prepare.cast_column(df, "mixed", "numeric", "invalid_to_null")), f"SELECT * REPLACE (TRY_CAST(mixed AS DOUBLE) AS mixed) FROM {BASE}")
add("cast_datetime", _on(lambda df: prepare.cast_column(df, "mixed", "datetime", "invalid_to_null")), f"SELECT * REPLACE (TRY_CAST(mixed AS TIMESTAMP) AS mixed) FROM {BASE}")
add("cast_strict", _on(lambda df: prepare.cast_column(df, "grp", "string")), f"SELECT * REPLACE (CAST(grp AS VARCHAR) AS grp) FROM {BASE}")
add("fill_constant", _on(lambda df: prepare.fill_missing(df, ["priority"], "constant", "none")), f"SELECT * REPLACE (coalesce(priority, 'none') AS priority) FROM {BASE}")
add("fill_mean", _on(lambda df: prepare.fill_missing(df, ["amount"], "mean").withColumn("amount", F.round("amount", 2))), f"SELECT * REPLACE (round(coalesce(amount, (SELECT avg(amount) FROM {BASE})), 2) AS amount) FROM {BASE}")
add("fill_median", _on(lambda df: prepare.fill_missing(df, ["amount"], "median").withColumn("amount", F.round("amount", 4))), f"SELECT * REPLACE (round(coalesce(amount, (SELECT median(amount) FROM {BASE})), 4) AS amount) FROM {BASE}")
add("fill_mode", _on(lambda df: prepare.fill_missing(df, ["priority"], "mode")), f"SELECT * REPLACE (coalesce(priority, (SELECT priority FROM {BASE} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority) FROM {BASE}")
add("fill_undefined", _on(lambda df: prepare.fill_missing(df.withColumn("none", F.lit(None).cast("double")), ["none"], "mean")), f"SELECT *, CAST(NULL AS DOUBLE) AS none FROM {BASE}")
add("fill_stats", _on(lambda df: profile.fill_stats(df, ["price", "priority"])), f"SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS n_missing FROM {BASE} UNION ALL SELECT 'priority', count(*) FILTER (priority IS NULL) FROM {BASE}")
add("replace_values", _on(lambda df: prepare.replace_values(df, "priority", [("1-URGENT", "urgent"), (None, "low"), ("2-HIGH", None)])), f"SELECT * REPLACE (CASE WHEN priority = '1-URGENT' THEN 'urgent' WHEN priority IS NULL THEN 'low' WHEN priority = '2-HIGH' THEN NULL ELSE priority END AS priority) FROM {BASE}")
add("replace_non_finite", _on(lambda df: prepare.replace_non_finite(df, ["price"])), f"SELECT * REPLACE (CASE WHEN isinf(price) THEN NULL ELSE price END AS price) FROM {BASE}")
add("remove_duplicates", _on(lambda df: prepare.remove_duplicates(df, ["grp", "status"])), f"SELECT * FROM {BASE} QUALIFY row_number() OVER (PARTITION BY grp, status ORDER BY _row_order) = 1")
add("duplicates_removed", _on(lambda df: access.removed_duplicates(df, ["grp", "status"])), f"SELECT _row_id, _row_order FROM (SELECT *, row_number() OVER (PARTITION BY grp, status ORDER BY _row_order) AS k FROM {BASE}) WHERE k > 1 ORDER BY _row_order LIMIT 100")
add("duplicate_rows", _on(lambda df: access.duplicate_rows(df, ["priority", "placed"])), f"SELECT * FROM {BASE} QUALIFY count(*) OVER (PARTITION BY priority, placed) > 1")
add("append_rows", _on(lambda df: prepare.append_rows(df, [("v2", prepare.filter_rows(df, "status", "eq", "P"))])), f"SELECT * FROM {BASE} UNION ALL SELECT * REPLACE (md5('v2:' || _row_id) AS _row_id, (SELECT max(_row_order) FROM {BASE}) + row_number() OVER (ORDER BY _row_order) AS _row_order) FROM {BASE} WHERE status = 'P'")
add("sample_changes", _on(lambda df: access.sample_changes(df, F.col("price").isNull())), f"SELECT _row_id, _row_order FROM {BASE} WHERE price IS NULL ORDER BY _row_order LIMIT 100")
add("sample_offset", _on(lambda df: access.sample_offset(df, 500)), f"SELECT _row_id, _row_order FROM {BASE} WHERE _row_order >= 500 ORDER BY _row_order LIMIT 100")
add("head10", _on(access.head), f"SELECT * FROM {BASE} ORDER BY _row_order LIMIT 10")

add("row_count", _on(lambda df: df.agg(F.count(F.lit(1)).alias("n"))), f"SELECT count(*) AS n FROM {BASE}")
for _kind, _sql in {"count": "count(price)", "min": "min(price)", "max": "max(amount)", "sum": "CAST(sum(grp) AS DECIMAL(38, 0))", "mean": "round(avg(amount), 4)", "median": "round(median(amount), 4)"}.items():
    _column = {"count": "price", "min": "price", "sum": "grp"}.get(_kind, "amount")
    add(f"agg_{_kind}", _on(lambda df, k=_kind, c=_column: access.aggregate_value(df, c, k).select((F.round("value", 4) if k in ("mean", "median") else F.col("value")).alias("value"))), f"SELECT {_sql} AS value FROM {BASE}")

_COLUMNS = ("_row_id string", "_row_order numeric", "price numeric", "amount numeric", "priority string", "status string", "grp numeric", "placed datetime", "mixed string")
_STATS = "s AS (" + " UNION ALL ".join(f"SELECT '{c.split()[0]}' AS \"column\", '{c.split()[1]}' AS family, count(*) AS n_rows, count(*) - count({c.split()[0]}) AS n_missing, count(DISTINCT {c.split()[0]}) AS n_distinct FROM {BASE}" for c in _COLUMNS) + ")"
add("schema_overview", _on(profile.schema_overview), f'WITH {_STATS} SELECT "column", family, n_missing, round(100.0 * n_missing / n_rows, 2)::DOUBLE AS missing_pct FROM s')
add("missing_cells", _on(profile.missing_cells), f"WITH {_STATS} SELECT CAST(sum(n_missing) AS BIGINT) AS missing_cells FROM s")
add("duplicate_count", _on(lambda df: profile.duplicate_count(df.select("grp", "status", "priority"))), f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT grp, status, priority FROM {BASE})) AS duplicates FROM {BASE}")
add("binary_candidates", lambda s, d: profile.binary_candidates(table(s, d, "lineitem")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM lineitem HAVING count(DISTINCT {c}) = 2" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))
add("columns_missing", _on(profile.columns_missing), f'WITH {_STATS} SELECT "column", n_missing FROM s WHERE n_missing > 0')
add("constant_columns", _on(lambda df: profile.constant_columns(df.withColumns({"same": F.lit("x"), "gaps": F.when(F.col("grp") > 3, 1)}))), f"WITH {_STATS}, m AS (SELECT * FROM s UNION ALL SELECT 'same', 'string', count(*), 0, count(DISTINCT 'x') FROM {BASE} UNION ALL SELECT 'gaps', 'numeric', count(*), count(*) FILTER (grp <= 3), count(DISTINCT CASE WHEN grp > 3 THEN 1 END) FROM {BASE}) SELECT \"column\" FROM m WHERE n_distinct + CAST(n_missing > 0 AS INT) <= 1")
add("high_cardinality", _on(profile.high_cardinality), f"WITH {_STATS} SELECT \"column\", n_distinct FROM s WHERE family <> 'numeric' AND n_distinct > greatest(20, CAST(floor(0.2 * n_rows) AS BIGINT))")
add("possible_ids", _on(profile.possible_ids), f"WITH {_STATS} SELECT \"column\" FROM s WHERE (regexp_matches(lower(\"column\"), '(^id$|_id$|uuid|identifier)') AND n_distinct >= 0.5 * (n_rows - n_missing)) OR (family NOT IN ('numeric', 'boolean') AND n_rows - n_missing >= 50 AND n_distinct >= 0.995 * (n_rows - n_missing))")
_OUT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) WHERE b > a AND ({c} < a - 0.1 * (b - a) OR {c} > b + 0.1 * (b - a))" for c in ("l_quantity", "l_extendedprice", "l_tax"))
add("outliers_iqr", lambda s, d: profile.outliers_iqr(table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_tax"), 0.1), f"SELECT * FROM ({_OUT}) WHERE outliers > 0")
add("scaling_hint", lambda s, d: profile.scaling_hint(table(s, d, "lineitem").select("l_quantity", "l_tax")), "SELECT greatest(a, b) / least(a, b) > 10 AS scaling_recommended FROM (SELECT stddev_samp(l_quantity) AS a, stddev_samp(l_tax) AS b FROM lineitem)")
add("class_summary", lambda s, d: profile.class_summary(table(s, d, "lineitem"), "l_returnflag"), 'SELECT l_returnflag AS "class", count(*) AS "count", round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2)::DOUBLE AS percentage FROM lineitem GROUP BY 1')
add("validate_target", lambda s, d: profile.validate_target(table(s, d, "labels"), "quality"), "SELECT CASE WHEN count(*) FILTER (quality IS NULL) > 0 THEN 'target_missing' WHEN count(DISTINCT quality) <> 2 THEN 'target_not_binary' WHEN least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) < 3 THEN 'target_too_small' ELSE 'target_valid' END AS status FROM labels")
add("imbalance", lambda s, d: profile.imbalance(table(s, d, "labels"), "toxic"), "SELECT round(m, 6) AS minority, m < 0.3 AS imbalanced, m < 0.1 AS severe FROM (SELECT min(c) / sum(c) AS m FROM (SELECT count(*) AS c FROM labels WHERE toxic IS NOT NULL GROUP BY toxic))")
add("prevalence", lambda s, d: profile.prevalence(table(s, d, "labels"), "toxic"), "SELECT max(toxic) AS positive, round(avg((toxic = (SELECT max(toxic) FROM labels))::INT), 6) AS prevalence FROM labels")
add("estimate_bytes", lambda s, d: profile.estimate_bytes(table(s, d, "customer")), "SELECT CAST(sum(octet_length(encode(c_name)) + octet_length(encode(c_mktsegment)) + 8 + 4 + 8) AS BIGINT) AS bytes FROM customer")
_IS_ID = "((regexp_matches(lower(\"column\"), '(^id$|_id$|uuid|identifier)') AND n_distinct >= 0.5 * (n_rows - n_missing)) OR (family NOT IN ('numeric', 'boolean') AND n_rows - n_missing >= 50 AND n_distinct >= 0.995 * (n_rows - n_missing)))"
_MANY = "(family <> 'numeric' AND n_distinct > greatest(20, CAST(floor(0.2 * n_rows) AS BIGINT)))"
_SAME = "(n_distinct + CAST(n_missing > 0 AS INT) <= 1)"


def _far(source: str, columns: tuple[str, ...]) -> str:
    """SQL of the columns with values beyond three interquartile ranges, and how many."""
    each = (f"SELECT '{c}' AS \"column\", count(*) AS outliers FROM {source}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}) WHERE b > a AND ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a))" for c in columns)
    return f"(SELECT * FROM ({' UNION ALL '.join(each)}) WHERE outliers > 0)"


_NAMES = "coalesce(string_agg(\"column\", ',' ORDER BY \"column\"), '')"
add(
    "quality_findings",
    _on(lambda df: profile.quality_findings(df.drop("_row_id"), "status").withColumn("columns", F.array_join("columns", ","))),
    f"""WITH {_STATS}, t AS (SELECT * FROM s WHERE "column" <> '_row_id'), x AS (SELECT * FROM t WHERE "column" <> 'status'), f AS (
SELECT 0 AS k, 'warning' AS severity, 'missing_values' AS finding, CAST(sum(n_missing) AS BIGINT) AS n, {_NAMES} AS columns FROM t WHERE n_missing > 0
UNION ALL SELECT 1, 'warning', 'duplicate_rows', (SELECT count(*) FROM {BASE}) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (_row_id) FROM {BASE})), ''
UNION ALL SELECT 2, 'issue', 'constant_columns', count(*), {_NAMES} FROM x WHERE {_SAME}
UNION ALL SELECT 3, 'warning', 'high_cardinality', count(*), {_NAMES} FROM x WHERE {_MANY}
UNION ALL SELECT 4, 'warning', 'possible_ids', count(*), {_NAMES} FROM x WHERE {_IS_ID}
UNION ALL SELECT 5, 'warning', 'outliers', count(*), {_NAMES} FROM {_far(BASE, ("_row_order", "price", "amount", "grp"))}
UNION ALL SELECT 6, 'issue', 'severe_imbalance', CAST(min(c) < 0.1 * sum(c) AS BIGINT), 'status' FROM (SELECT count(*) AS c FROM {BASE} WHERE status IS NOT NULL GROUP BY status))
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, severity, finding, n, columns FROM f WHERE n > 0""",
)

add("row_identity", lambda s, d: with_identity(table(s, d, "events").select("event_id", "event_type"), ["event_id"], "events"), "SELECT md5('events:' || CAST(k AS VARCHAR)) AS _row_id, k AS _row_order, event_id, event_type FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, event_id, event_type FROM events)")
add("content_fingerprint", _on(content_fingerprint))
_CELL = "coalesce('{kind}:' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'null')"
_CELLS = " || ',' || ".join(_CELL.format(kind=k, c=c) for k, c in (("long", "o_orderkey"), ("long", "o_custkey"), ("string", "o_orderstatus"), ("string", "nullif(o_orderpriority, '5-LOW')")))
add(
    "fingerprint_blocks",
    lambda s, d: block_digests(table(s, d, "orders").selectExpr("o_orderkey AS _row_order", "o_custkey", "o_orderstatus", "nullif(o_orderpriority, '5-LOW') AS priority"), 1024),
    f"SELECT o_orderkey // 1024 AS block, count(*) AS rows, sha256(string_agg(sha256({_CELLS}), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1",
)
add("canonical_roundtrip", _on(materialize), f"SELECT * FROM {BASE}")
add("combine_sources", lambda s, d: split.combine_sources([("a.csv", table(s, d, "customer").select("c_custkey", "c_name")), ("b.csv", table(s, d, "customer").where("c_custkey % 2 = 0").select("c_name", "c_custkey"))]), "SELECT c_custkey, c_name, 'a.csv' AS __source_file FROM customer UNION ALL SELECT c_custkey, c_name, 'b.csv' FROM customer WHERE c_custkey % 2 = 0")


def _files_of_lines(spark: SparkSession, d: str) -> str:
    """A folder of files of the line items, so many rows each."""
    path = new_folder(spark)
    table(spark, d, "lineitem").write.option("maxRecordsPerFile", 5000).parquet(path)
    return path


def _verified(spark: SparkSession, d: str) -> DataFrame:
    """Of every three files that a task wrote, the second has another digest in the manifest and the third another path."""
    path = _files_of_lines(spark, d)
    told = materialize(stored.source_digests(spark, path)).withColumn("k", F.regexp_extract("name", "-c([0-9]+)[.]", 1).cast("int") % 3)
    manifest = told.select(F.when(F.col("k") == 2, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), "name", "size", F.when(F.col("k") == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return stored.verify_files(spark, manifest, path)


add("source_digests", lambda s, d: stored.source_digests(s, _files_of_lines(s, d)))
add("source_totals", lambda s, d: stored.source_totals(s, f"{d}/orders.parquet"))
add("verify_files", _verified)
add("infer_types", lambda s, d: csv.infer_types(table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS k", "CAST(nullif(o_custkey % 9, 0) AS STRING) AS gaps", "o_orderstatus AS status", "CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE o_orderpriority END AS p", "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS flag")), "SELECT o_orderkey AS k, CAST(nullif(o_custkey % 9, 0) AS DOUBLE) AS gaps, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p, o_orderkey % 2 = 0 AS flag FROM orders")

add("format_bytes", lambda s, d: table(s, d, "orders").select("o_orderkey", scalar.format_bytes(F.col("o_orderkey").cast("double") * F.col("o_orderkey") * 977 + 13).alias("size")), "SELECT o_orderkey, CASE WHEN x < 1024 THEN printf('%.1f B', x) WHEN x < 1048576 THEN printf('%.1f KB', x / 1024) WHEN x < 1073741824 THEN printf('%.1f MB', x / 1048576) WHEN x < 1099511627776 THEN printf('%.1f GB', x / 1073741824) ELSE printf('%.1f TB', x / 1099511627776) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * o_orderkey * 977 + 13 AS x FROM orders)")
add("metric_state", _on(lambda df: df.select("_row_order", scalar.metric_state(F.col("price")).alias("state"))), f"SELECT _row_order, CASE WHEN price IS NULL THEN 'not_defined' WHEN isinf(price) THEN 'positive_infinity' ELSE 'finite' END AS state FROM {BASE}")
add("sample_support", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("p"), F.sum((F.col("o_orderstatus") != "F").cast("long")).alias("n")).select("o_custkey", scalar.sample_support(F.col("p"), F.col("n")).alias("severity")), "SELECT o_custkey, CASE WHEN least(p, n) < 10 THEN 'severe' WHEN least(p, n) < 30 THEN 'limited' ELSE 'none' END AS severity FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY 1)")

add("confusion_matrix", _on(lambda df: curves.confusion_matrix(df, 0.5), scores), f"SELECT model, count(*) FILTER (score < 0.5 AND truth = 0) AS tn, count(*) FILTER (score >= 0.5 AND truth = 0) AS fp, count(*) FILTER (score < 0.5 AND truth = 1) AS fn, count(*) FILTER (score >= 0.5 AND truth = 1) AS tp FROM {SCORES} GROUP BY model")
add("prf_metrics", _on(lambda df: curves.prf_metrics(df, 0.5), scores), f"SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM ({SQL['confusion_matrix']})")
add("interpretation", _on(lambda df: curves.prf_metrics(df, 0.5).select("model", scalar.interpretation(F.col("precision"), F.col("recall"), F.col("fp"), F.col("tp")).alias("reading")), scores), f"SELECT model, CASE WHEN precision < 0.5 OR fp > tp THEN 'screening' WHEN precision >= 0.8 AND recall >= 0.8 THEN 'selective' ELSE 'review' END AS reading FROM ({SQL['prf_metrics']})")
add("roc_curve", _on(lambda df: curves.roc_curve(df).withColumn("score", F.round("score", 6)), scores), f"WITH {_GROUPS} SELECT model, round(score, 6) AS score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c")
add("pr_curve", _on(lambda df: curves.pr_curve(df).withColumn("threshold", F.round("threshold", 6)), scores), f"WITH {_GROUPS} SELECT model, round(score, 6) AS threshold, round(precision_, 6) AS precision, round(recall_, 6) AS recall FROM r UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM r")
add("roc_auc", _on(curves.roc_auc, scores), f"WITH {_GROUPS} SELECT model, round(sum(neg * (2 * tp - pos) / 2.0::DOUBLE) / (max(p) * max(n)), 6) AS roc_auc FROM c GROUP BY model")
add("average_precision", _on(curves.average_precision, scores), f"WITH {_GROUPS} SELECT model, round(sum(pos / p * precision_), 6) AS pr_auc FROM r GROUP BY model")
_CHOSEN = ["model", "feasible", "threshold", "precision", "recall"]
add("optimize_models", _on(lambda df: curves.optimize_threshold(df, 0.3).select(_CHOSEN), scores), f"WITH {_GROUPS} SELECT model, true AS feasible, score AS threshold, round(precision_, 6) AS precision, round(recall_, 6) AS recall FROM r WHERE recall_ >= 0.3 QUALIFY row_number() OVER (PARTITION BY model ORDER BY precision_ DESC, recall_ DESC, score DESC) = 1")
add("optimize_threshold", _on(lambda df: curves.optimize_threshold(df.where("model = 'a'"), 0.6).select(_CHOSEN), scores), f"WITH {_GROUPS} SELECT model, true AS feasible, score AS threshold, round(precision_, 6) AS precision, round(recall_, 6) AS recall FROM r WHERE model = 'a' AND recall_ >= 0.6 QUALIFY row_number() OVER (PARTITION BY model ORDER BY precision_ DESC, recall_ DESC, score DESC) = 1")
add("candidate_thresholds", _on(lambda df: curves.candidate_thresholds(df, [0.3, 0.7, 0.7, 1.5]), scores), f"SELECT model, t AS threshold, count(*) FILTER (score >= t AND truth = 1) AS tp, count(*) FILTER (score >= t AND truth = 0) AS fp, round(coalesce(count(*) FILTER (score >= t AND truth = 1) / nullif(count(*) FILTER (score >= t), 0), 0), 6) AS precision, round(count(*) FILTER (score >= t AND truth = 1) / sum(truth), 6) AS recall FROM {SCORES}, (SELECT DISTINCT t FROM (VALUES (0.3::DOUBLE), (0.7::DOUBLE), (0.7::DOUBLE), (1.5::DOUBLE)) AS w(t) WHERE t BETWEEN 0 AND 1) AS v GROUP BY model, t")
add("recommend_model", _on(lambda df: curves.recommend_model(df, 0.3), scores), f"SELECT o.model, threshold, precision, pr_auc, recall FROM ({SQL['optimize_models']}) o JOIN ({SQL['average_precision']}) a USING (model) ORDER BY precision DESC, pr_auc DESC, recall DESC LIMIT 1")



def _at(t: float) -> str:
    return SQL["prf_metrics"].replace("score < 0.5", f"score < {t}").replace("score >= 0.5", f"score >= {t}")


_JUDGED = "({prf}) m JOIN (" + SQL["roc_auc"] + ") u USING (model) JOIN (" + SQL["average_precision"] + ") v USING (model)"
add("scored_validation", _on(models.validation_metrics, scores), f"SELECT m.*, roc_auc, pr_auc FROM {_JUDGED.format(prf=SQL['prf_metrics'])}")
add("scored_comparison", _on(models.model_comparison, scores), f"SELECT model, pr_auc, roc_auc, precision, recall, f1, fp, fn FROM {_JUDGED.format(prf=SQL['prf_metrics'])}")
add("scored_final_test", _on(lambda df: models.final_test(df, "a", 0.6), scores), f"SELECT m.*, roc_auc, pr_auc, 0.6::DOUBLE AS threshold, tn + fp + fn + tp AS test_rows FROM {_JUDGED.format(prf=_at(0.6))} WHERE model = 'a'")
add("optimized_matrix", _on(lambda df: curves.optimize_threshold(df, 0.3).select("model", "threshold", "f1", "tn", "fp", "fn", "tp"), scores), f"WITH {_GROUPS}, k AS (SELECT * FROM r WHERE recall_ >= 0.3 QUALIFY row_number() OVER (PARTITION BY model ORDER BY precision_ DESC, recall_ DESC, score DESC) = 1) SELECT model, score AS threshold, round(2 * tp / (2 * tp + fp + p - tp), 6) AS f1, CAST(n - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM k")
add("sample_diagnosis", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("positive_count"), F.sum((F.col("o_orderstatus") != "F").cast("long")).alias("negative_count")).select("o_custkey", "positive_count", "negative_count", scalar.sample_diagnosis(F.col("positive_count"), F.col("negative_count")).alias("d")).select("o_custkey", "positive_count", "negative_count", "d.severity", F.round("d.recall_resolution", 6).alias("recall_resolution"), "d.limited_sample"), "SELECT o_custkey, p AS positive_count, n AS negative_count, CASE WHEN least(p, n) < 10 THEN 'severe' WHEN least(p, n) < 30 THEN 'limited' ELSE 'none' END AS severity, round(1.0::DOUBLE / nullif(p, 0), 6) AS recall_resolution, least(p, n) < 30 AS limited_sample FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY 1)")

add("stratified_split", lambda s, d: split.stratified_split(table(s, d, "labels"), "quality", "doc_id"))
add("split_summary", lambda s, d: split.split_summary(table(s, d, "labels").withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test")), "quality"), "SELECT split, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS rows, quality AS \"class\", count(*) AS \"count\", round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 2)::DOUBLE AS percentage FROM (SELECT quality, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM labels) GROUP BY split, quality")

#: Labelled documents: gaps among the numbers, texts and a binary target.
_LABELLED = "SELECT doc_id, quality, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars END AS n_chars, nullif(lang, 'en') AS lang, source, toxic FROM labels JOIN documents USING (doc_id)"
_FEATURES = ["n_chars", "lang", "source", "toxic"]


def labelled(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").where("quality IS NOT NULL")
    return both.selectExpr("doc_id", "quality", "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars END AS n_chars", "nullif(lang, 'en') AS lang", "source", "toxic")


def _parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    dealt = materialize(split.stratified_split(labelled(spark, d), "quality", "doc_id"))
    return {p: dealt.where(F.col("split") == p).drop("split") for p in split.PARTS}


def _judged(spark: SparkSession, d: str, *parts: str) -> list[DataFrame]:
    """Both models' scores on parts that they weren't trained on."""
    dealt = _parts(spark, d)
    fitted = models.train_models(dealt["train"], "quality", _FEATURES)
    return [models.long_scores(fitted, dealt[p], "quality", 1) for p in parts]


def _trained(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        dealt = _parts(spark, d)
        model = models.train_models(dealt["train"], "quality", _FEATURES, models=(name,))[name]
        return models.score(model, dealt["validation"]).select("doc_id", "quality", F.round("score", 6).alias("score"), "predicted")

    return query


def _scored_by_package(spark: SparkSession, d: str) -> DataFrame:
    dealt, path, name = _parts(spark, d), new_folder(spark), models.MODELS[0]
    model = models.train_models(dealt["train"], "quality", _FEATURES, models=(name,))[name]
    models.save_package(model, path, name, 0.4, "quality", 1, _FEATURES)
    return models.score_batch(spark, path, dealt["test"]).select("doc_id", F.round("score", 6).alias("score"), "predicted")


def _export(spark: SparkSession, d: str) -> DataFrame:
    validation, test = _judged(spark, d, "validation", "test")
    path = new_folder(spark)
    models.write_metrics(models.metrics_export(validation, test, models.MODELS[0], 0.5, 0.8), path)
    return spark.read.csv(path, header=True)


def _numeric_features(spark: SparkSession, d: str) -> DataFrame:
    got = models.preprocess(labelled(spark, d), labelled(spark, d), ["n_chars", "toxic"])
    parts = models.vector_to_array("features")
    return got.select("doc_id", *(F.round(parts[i], 4).alias(c) for i, c in enumerate(("n_chars", "toxic"))))


def _categorical(spark: SparkSession, d: str) -> DataFrame:
    df = labelled(spark, d)
    return df.select("doc_id", F.coalesce("lang", F.lit(models.learn(df, ["lang"]).modes["lang"])).alias("lang"))


def _one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Levels are learned from all labelled rows."""
    df = labelled(spark, d)
    places = F.transform(models.vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return models.preprocess(df, df, ["lang", "source"]).select("doc_id", F.array_join(places, "").alias("features"))


add("preprocess_numeric", _numeric_features, f"WITH b AS ({_LABELLED} WHERE quality IS NOT NULL), f AS (SELECT doc_id, coalesce(n_chars::DOUBLE, (SELECT median(n_chars) FROM b)) AS x, coalesce(toxic::DOUBLE, (SELECT median(toxic) FROM b)) AS y FROM b) SELECT doc_id, round((x - avg(x) OVER ()) / coalesce(nullif(stddev_pop(x) OVER (), 0), 1), 4) AS n_chars, round((y - avg(y) OVER ()) / coalesce(nullif(stddev_pop(y) OVER (), 0), 1), 4) AS toxic FROM f")
add("preprocess_categorical", _categorical, f"WITH b AS ({_LABELLED} WHERE quality IS NOT NULL) SELECT doc_id, coalesce(lang, (SELECT lang FROM b WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang FROM b")
_FILLED = ", ".join(f"coalesce({c}, (SELECT {c} FROM b WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in ("lang", "source"))
_PLACES = " || ".join(f"(SELECT string_agg(CASE WHEN l.v = f.{c} THEN '1' ELSE '0' END, '' ORDER BY l.v) FROM (SELECT DISTINCT {c} AS v FROM f) l)" for c in ("lang", "source"))
add("preprocess_onehot", _one_hot, f"WITH b AS ({_LABELLED} WHERE quality IS NOT NULL), f AS (SELECT doc_id, {_FILLED} FROM b) SELECT doc_id, {_PLACES} AS features FROM f")


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """Orders' customers as levels: as many places as customers with orders."""
    orders = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "CAST(nullif(o_custkey, 7) AS STRING) AS customer", "nullif(o_orderstatus, 'P') AS status")
    got = models.preprocess_sparse(orders, orders, ["o_totalprice", "customer", "status"])
    value = F.round(F.get("values", F.lit(0)), 4)
    return got.select("o_orderkey", "size", value.alias("price"), F.array_join("indices", ",").alias("indices"))


_O = "o AS (SELECT o_orderkey, o_totalprice AS x, nullif(CAST(o_custkey AS VARCHAR), '7') AS customer, nullif(o_orderstatus, 'P') AS status FROM orders)"
_MODE = "coalesce({c}, (SELECT {c} FROM o WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
add(
    "preprocess_sparse",
    _sparse,
    f"WITH {_O}, f AS (SELECT o_orderkey, x, {_MODE.format(c='customer')}, {_MODE.format(c='status')} FROM o), a AS (SELECT customer, row_number() OVER (ORDER BY customer) AS i FROM (SELECT DISTINCT customer FROM f)), b AS (SELECT status, row_number() OVER (ORDER BY status) + (SELECT count(*) FROM a) AS j FROM (SELECT DISTINCT status FROM f)) SELECT o_orderkey, 1 + (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS size, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS price, '0,' || i || ',' || j AS indices FROM f JOIN a USING (customer) JOIN b USING (status)",
)
add("preprocess", lambda s, d: models.preprocess(_parts(s, d)["train"], labelled(s, d), _FEATURES).select("doc_id", models.vector_to_array("features").alias("features")))
add("train_logistic", _trained("logistic_regression"))
add("train_forest", _trained("random_forest"))
add("train_baselines", lambda s, d: _judged(s, d, "validation")[0])
add("validation_metrics", lambda s, d: models.validation_metrics(_judged(s, d, "validation")[0]))
add("model_comparison", lambda s, d: models.model_comparison(_judged(s, d, "validation")[0]))
add("final_test", lambda s, d: models.final_test(_judged(s, d, "test")[0], "logistic_regression", 0.5))
add("metrics_export", _export)
add("score_batch", _scored_by_package)
_DOCS = "(SELECT doc_id, quality, toxic, lang, source, n_chars FROM labels JOIN documents USING (doc_id))"
_DOC_STATS = "s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS family, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM {_DOCS}" for c, k in (("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric"), ("lang", "string"), ("source", "string"), ("n_chars", "numeric"))) + ")"
add(
    "diagnose",
    lambda s, d: profile.diagnose(table(s, d, "labels").join(table(s, d, "documents").drop("text"), "doc_id"), "quality"),
    f"""WITH {_DOC_STATS}, x AS (SELECT * FROM s WHERE "column" <> 'quality'), c AS (SELECT quality, count(*) AS n FROM {_DOCS} GROUP BY quality),
m AS (SELECT min(n) / sum(n) AS m FROM c WHERE quality IS NOT NULL), d AS (SELECT greatest(a, b, e) AS hi, least(a, b, e) AS lo FROM (SELECT stddev_samp(doc_id) AS a, stddev_samp(toxic) AS b, stddev_samp(n_chars) AS e FROM {_DOCS}))
SELECT 'class_count' AS "check", CAST(quality AS VARCHAR) AS "column", CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT 'minority', 'quality', CAST(round(m, 6) AS VARCHAR) FROM m
UNION ALL SELECT 'imbalanced', 'quality', CAST(m < 0.3 AS VARCHAR) FROM m
UNION ALL SELECT 'missing', "column", CAST(n_missing AS VARCHAR) FROM s WHERE n_missing > 0
UNION ALL SELECT 'constant', "column", 'true' FROM x WHERE {_SAME}
UNION ALL SELECT 'high_cardinality', "column", CAST(n_distinct AS VARCHAR) FROM x WHERE {_MANY}
UNION ALL SELECT 'possible_id', "column", 'true' FROM x WHERE {_IS_ID}
UNION ALL SELECT 'outliers', "column", CAST(outliers AS VARCHAR) FROM {_far(_DOCS, ("doc_id", "toxic", "n_chars"))}
UNION ALL SELECT 'scaling_recommended', NULL, CAST(CASE WHEN lo = 0 THEN hi > 0 ELSE hi / lo > 10 END AS VARCHAR) FROM d""",
)


def _package(spark: SparkSession, d: str) -> DataFrame:
    """What a written package says of itself, and how many stages its pipeline has."""
    dealt, path, name = _parts(spark, d), new_folder(spark), models.MODELS[0]
    models.save_package(models.train_models(dealt["train"], "quality", _FEATURES, models=(name,))[name], path, name, 0.4, "quality", 1, _FEATURES)
    model, about = models.load_package(spark, path)
    return dealt["train"].agg(F.count(F.lit(1)).alias("train_rows")).select("train_rows", F.lit(len(model.stages)).alias("stages"), *(F.lit(str(v)).alias(k) for k, v in about.items()))


add("model_package", _package)


def _workbooks_of_customers(spark: SparkSession, d: str) -> str:
    path = new_folder(spark)
    workbooks.write_workbooks(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "customers", 200)
    return path


add("workbook_sheets", lambda s, d: workbooks.workbook_sheets(s, _workbooks_of_customers(s, d)).groupBy("sheet_index", "sheet_name", "status").agg((F.count(F.lit(1)) > 0).alias("found")), "SELECT * FROM (VALUES (0, 'customers', 'ok', true), (1, 'about', 'ok', true)) AS v(sheet_index, sheet_name, status, found) WHERE (SELECT count(*) FROM customer) > 0")
add("workbook_rows", lambda s, d: workbooks.workbook_rows(s, _workbooks_of_customers(s, d), "customers").where("row_index > 1").select(F.get("cells", F.lit(0)).cast("long").alias("c_custkey"), F.get("cells", F.lit(1)).alias("c_name"), F.get("cells", F.lit(2)).cast("double").alias("c_acctbal")), "SELECT c_custkey, c_name, c_acctbal FROM customer")


def _csv_of_orders(spark: SparkSession, d: str) -> str:
    path = new_folder(spark)
    table(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_custkey % 9, 0) AS gaps", "concat(o_orderstatus, ',\n\"', o_orderpriority) AS odd").write.options(header=True, escape='"').csv(path)
    return path


add("csv_import", lambda s, d: csv.import_csv(s, _csv_of_orders(s, d)), "SELECT o_orderkey, CAST(nullif(o_custkey % 9, 0) AS DOUBLE) AS gaps, o_orderstatus || ',' || chr(10) || '\"' || o_orderpriority AS odd FROM orders")
add("source_metadata", lambda s, d: stored.source_metadata(s, _csv_of_orders(s, d)).groupBy("file_type", "columns").agg(F.sum("rows").alias("rows")), "SELECT 'CSV' AS file_type, 3 AS \"columns\", count(*) AS rows FROM orders")

#: A log of versions made from orders: a customer is a dataset, an order a version; each order has inputs and sources.
_HEADS = "SELECT CAST(o_custkey AS {text}) AS dataset, CAST(o_orderkey AS {text}) AS version, o_orderkey AS revision FROM orders"
_LINEAGE = "SELECT CAST(o_orderkey AS {text}) AS version, CAST(o_orderkey + i * 3 AS {text}) AS input, i AS input_order, CASE WHEN i = 0 THEN 'base' ELSE 'append' END AS role FROM orders, (VALUES (0), (1), (2)) AS v(i)"
_SOURCES = "SELECT CAST(l_orderkey AS {text}) AS version, CAST(l_suppkey % 40 AS {text}) AS source, l_linenumber AS source_order FROM lineitem"
_PREVIEWS = "SELECT o_orderkey AS preview, CAST(o_custkey AS {text}) AS dataset, CAST(o_orderkey AS {text}) AS version, o_orderkey AS revision, o_orderdate AS expires_at, CASE WHEN o_orderkey % 13 = 0 THEN 'v' END AS applied_version FROM orders"
_VERIFIED = "SELECT o_orderkey AS preview, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM orders WHERE o_orderkey % 7 <> 0"
_NOW = "1995-01-01 00:00:00"


def _log(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(text="STRING").replace("FROM orders", "FROM {o}").replace("FROM lineitem", "FROM {l}"), o=table(spark, d, "orders"), l=table(spark, d, "lineitem"))


def _duck(sql: str) -> str:
    return f"({sql.format(text='VARCHAR')})"


add("current_head", lambda s, d: versions.current_heads(_log(s, d, _HEADS)), f"SELECT dataset, version, revision FROM {_duck(_HEADS)} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY revision DESC) = 1")
add("version_history", lambda s, d: versions.version_history(_log(s, d, _HEADS), "7"), f"SELECT * FROM {_duck(_HEADS)} WHERE dataset = '7'")
add("version_lineage", lambda s, d: versions.version_lineage(_log(s, d, _LINEAGE), "7"), f"SELECT * FROM {_duck(_LINEAGE)} WHERE version = '7'")
add("inherit_sources", lambda s, d: versions.inherit_sources(_log(s, d, _LINEAGE), _log(s, d, _SOURCES)), f"WITH f AS (SELECT l.version, s.source, min(input_order * 1000 + source_order) AS seen FROM {_duck(_LINEAGE)} l JOIN {_duck(_SOURCES)} s ON s.version = l.input GROUP BY ALL) SELECT version, source, row_number() OVER (PARTITION BY version ORDER BY seen, source) - 1 AS source_order FROM f")
add("preview_status", lambda s, d: versions.preview_status(_log(s, d, _PREVIEWS), _log(s, d, _HEADS), _log(s, d, _VERIFIED), F.lit(_NOW).cast("timestamp")), f"SELECT p.preview, CASE WHEN applied_version IS NOT NULL THEN 'applied' WHEN expires_at <= TIMESTAMP '{_NOW}' THEN 'expired' WHEN p.version <> h.version THEN 'stale' WHEN coalesce(v.status, '') <> 'ok' THEN 'tampered' ELSE 'ready' END AS status FROM {_duck(_PREVIEWS)} p LEFT JOIN ({SQL['current_head']}) h USING (dataset) LEFT JOIN {_duck(_VERIFIED)} v ON v.preview = p.preview")


def _published(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the orders in a new log; the older one is read back after the newer became the head."""
    log, orders = new_folder(spark), base(spark, d)
    versions.start_log(spark, log)
    versions.publish(orders, log, "orders", "v1", sources=["orders.parquet"])
    versions.publish(prepare.filter_rows(orders, "status", "eq", "F"), log, "orders", "v2", inputs=["v1"], recipe="final")
    return versions.read_version(spark, log, "v1")


add("read_version", _published, f"SELECT * FROM {BASE}")


RECIPE = [
    ("filter_rows", {"column": "grp", "operator": "gte", "value": 10}),
    ("fill_missing", {"columns": ["amount"], "strategy": "median"}),
    ("replace_non_finite", {"columns": ["price"]}),
    ("drop_missing_rows", {"columns": ["price"]}),
    ("remove_duplicates", {"columns": ["grp", "status"]}),
]
add("recipe_preview", _on(lambda df: run_recipe(df, RECIPE)[0].withColumn("amount", F.round("amount", 4))), f"WITH f AS (SELECT * FROM {BASE} WHERE grp >= 10), m AS (SELECT * REPLACE (round(coalesce(amount, (SELECT median(amount) FROM f)), 4) AS amount, CASE WHEN isinf(price) THEN NULL ELSE price END AS price) FROM f) SELECT * FROM m WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp, status ORDER BY _row_order) = 1")
add(
    "recipe_samples",
    _on(lambda df: recipe_preview(df, RECIPE)[2]),
    f"""WITH f AS (SELECT * FROM {BASE} WHERE grp >= 10), p AS (SELECT * FROM f WHERE price IS NOT NULL AND NOT isinf(price)),
a AS (SELECT 0 AS step, 'filter_rows' AS operation, _row_id, _row_order FROM {BASE} WHERE NOT grp >= 10 UNION ALL SELECT 1, 'fill_missing', _row_id, _row_order FROM f WHERE amount IS NULL
UNION ALL SELECT 2, 'replace_non_finite', _row_id, _row_order FROM f WHERE isinf(price) UNION ALL SELECT 3, 'drop_missing_rows', _row_id, _row_order FROM f WHERE price IS NULL OR isinf(price)
UNION ALL SELECT 4, 'remove_duplicates', _row_id, _row_order FROM p QUALIFY row_number() OVER (PARTITION BY grp, status ORDER BY _row_order) > 1)
SELECT step, operation, _row_id FROM a ORDER BY step, _row_order LIMIT 100""",
)
add("recipe_summary", _on(lambda df: preview_summary(df, run_recipe(df, RECIPE)[0], RECIPE).drop("fingerprint")), f"SELECT count(*) AS rows_before, CAST(7 AS BIGINT) AS columns_before, (SELECT count(*) FROM (SELECT DISTINCT grp, status FROM {BASE} WHERE grp >= 10 AND price IS NOT NULL AND NOT isinf(price))) AS rows_after, CAST(7 AS BIGINT) AS columns_after FROM {BASE}")
add("recipe_learned", _on(lambda df: run_recipe(df, RECIPE)[1].select("step", F.round(F.get_json_object("learned", "$.amount").cast("double"), 4).alias("amount"), F.size("warnings").alias("warnings"), "columns_after")), f"SELECT CAST(k AS INTEGER) AS step, CASE WHEN k = 1 THEN (SELECT round(median(amount), 4) FROM {BASE} WHERE grp >= 10) END AS amount, 0 AS warnings, 7 AS columns_after FROM range(5) AS r(k)")
add("recipe_steps", _on(lambda df: run_recipe(df, RECIPE)[1].select("step", "operation", "affected_rows", "affected_cells", "rows_after")), f"WITH b AS (SELECT * FROM {BASE}), f AS (SELECT * FROM b WHERE grp >= 10), p AS (SELECT * FROM f WHERE price IS NOT NULL AND NOT isinf(price)), u AS (SELECT DISTINCT grp, status FROM p), n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM f WHERE amount IS NULL) AS na, (SELECT count(*) FROM f WHERE isinf(price)) AS ni, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM u) AS nu) SELECT 0 AS step, 'filter_rows' AS operation, nb - nf AS affected_rows, CAST(0 AS BIGINT) AS affected_cells, nf AS rows_after FROM n UNION ALL SELECT 1, 'fill_missing', na, na, nf FROM n UNION ALL SELECT 2, 'replace_non_finite', ni, ni, nf FROM n UNION ALL SELECT 3, 'drop_missing_rows', nf - np, 0, np FROM n UNION ALL SELECT 4, 'remove_duplicates', np - nu, 0, nu FROM n")


def _applied(spark: SparkSession, d: str) -> DataFrame:
    """A recipe's preview over a new log of the orders, applied twice; the version that both gave, read back."""
    log = new_folder(spark)
    versions.start_log(spark, log)
    versions.publish(base(spark, d), log, "orders", "v1", sources=["orders.parquet"])
    name = versions.preview(spark, log, "orders", RECIPE)[0]
    first, again = versions.apply_preview(spark, log, name), versions.apply_preview(spark, log, name)
    head, revision = versions.head_of(spark, log, "orders")
    return versions.read_version(spark, log, again).withColumn("amount", F.round("amount", 4)).withColumn("same", F.lit(first == again == head)).withColumn("revision", F.lit(revision))


add("apply_preview", _applied, f"SELECT *, true AS same, 2 AS revision FROM ({SQL['recipe_preview']})")


def _scored_export(spark: SparkSession, d: str) -> DataFrame:
    """The export of made-up scores, written as CSV and read back."""
    made, path = models.metrics_export(scores(spark, d), scores(spark, d), "a", 0.6, 0.3), new_folder(spark)
    models.write_metrics(made, path)
    return spark.read.schema(made.schema).csv(path, header=True, enforceSchema=True)


_CHOICE = f"SELECT o.model, feasible, o.threshold, precision, recall, f1, tn, fp, fn, tp FROM ({SQL['optimize_models']}) o JOIN ({SQL['optimized_matrix']}) x USING (model)"
add("scored_export", _scored_export, f"SELECT 'validation_default_0.5' AS stage, * FROM ({SQL['scored_comparison']}) UNION ALL BY NAME SELECT 'validation_selected_threshold' AS stage, * FROM ({_CHOICE}) UNION ALL BY NAME SELECT 'final_test_locked_threshold' AS stage, * FROM ({SQL['scored_final_test']})")


def _remainders(source: str, n: str, share: str) -> str:
    """SQL that shares out the number ``share`` among the rows of source (k, and n of each) by largest remainders."""
    return f"SELECT k, all_of, CAST(down + CASE WHEN row_number() OVER (ORDER BY down - exact, CAST(k AS VARCHAR)) <= {share} - sum(down) OVER () THEN 1 ELSE 0 END AS BIGINT) AS part FROM (SELECT *, floor(exact) AS down FROM (SELECT k, {n} AS all_of, ({share}) * {n} / CAST(sum({n}) OVER () AS DOUBLE) AS exact FROM {source}))"


_REST = "(SELECT (3 * count(*) + 9) // 10 FROM labels)"
add(
    "split_quotas",
    lambda s, d: split.stratified_split(table(s, d, "labels"), "quality", "doc_id").groupBy("split", "quality").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH c AS (SELECT quality AS k, count(*) AS n FROM labels GROUP BY 1), rest AS ({_remainders("c", "n", _REST)}), test AS ({_remainders("rest", "part", f"(({_REST} + 1) // 2)")})
SELECT 'train' AS split, k AS quality, all_of - part AS n FROM rest UNION ALL SELECT 'validation', k, all_of - part FROM test UNION ALL SELECT 'test', k, part FROM test""",
)


def _texts_by_nation(spark: SparkSession, d: str, name: str = "c_name") -> str:
    """A text file for each nation: its customers' names in order, one a line."""
    path = new_folder(spark)
    table(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").selectExpr("c_nationkey", f"{name} AS value").write.partitionBy("c_nationkey").text(path)
    return path


def _nation() -> Column:
    return F.regexp_extract("path", "c_nationkey=([0-9]+)/part-", 1).cast("int").alias("nation")


def _texts_verified(spark: SparkSession, d: str) -> DataFrame:
    """Files against the digests of others, in which the names of every third nation's customers are in small letters."""
    path = _texts_by_nation(spark, d)
    named = stored.source_digests(spark, path).select("path", "name", _nation())
    other = stored.source_digests(spark, _texts_by_nation(spark, d, "if(c_nationkey % 3 = 2, lower(c_name), c_name)")).select(_nation(), "size", "sha256")
    return stored.verify_files(spark, named.join(other, "nation").drop("nation"), path).select(_nation(), "status")


_TEXTS = "(SELECT c_nationkey AS nation, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY c_nationkey)"
add("text_digests", lambda s, d: stored.source_digests(s, _texts_by_nation(s, d)).select(_nation(), "size", "sha256").where("nation IS NOT NULL"), f"SELECT nation, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS sha256 FROM {_TEXTS}")
add("text_totals", lambda s, d: stored.source_totals(s, _texts_by_nation(s, d)), f"SELECT CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes, sum(octet_length(encode(t))) >= 1073741824 AS large FROM {_TEXTS}")
add("text_verified", _texts_verified, f"SELECT nation, CASE WHEN nation % 3 = 2 AND lower(t) <> t THEN 'changed' ELSE 'ok' END AS status FROM {_TEXTS}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A recipe over line items in a dense order: what each of its steps did."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") != 0.05, F.col("l_discount")))
    steps = [("filter_rows", {"column": "l_quantity", "operator": "gte", "value": 10}), ("fill_missing", {"columns": ["l_discount"], "strategy": "median"}), ("remove_duplicates", {"columns": ["l_orderkey"]})]
    return run_recipe(with_identity(lines, order, "lineitem"), steps)[1]
