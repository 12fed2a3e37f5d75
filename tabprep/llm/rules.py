r"""Quality rules of single documents, and of the hosts that they come from.

Documents: words are [^\x20\x09-\x0D]+. A document fails its base rules with fewer than 50 words, or if more than half of its words
stand in three-word windows that occur twice or more in it. It fails the further rules if symbols make up more than a tenth of
its word characters, or more than 30 % of its lines with a word repeat an earlier line.

Hosts: failures (of any rule) are summed for each host. The rates of all hosts give a beta prior by the method of moments, towards
which each host's rate is drawn; a host whose drawn rate is above ``host_limit`` is rejected with all its documents.

All expressions are built-in functions; windows are compared by 64-bit hashes within one document. Counts of a hot host are summed
before the shuffle; its documents are joined to verdicts by a join that Spark can split. Defined results: null and empty texts have no
words and fail; documents of null hosts share the host ''; repeated rows count and are reported each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let
from .shared import stash

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows that the array has twice or more."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        """s: (hash, position) by hash, then position."""
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked, covered))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, lambda w: let(hashes(w), count)))


def document_rules(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed."""
    host = F.col("source") if host is None else host
    plain = documents.select(F.col(id_col).alias("_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = F.when(F.contains("_t", F.lit("\n")), let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))))
    found = plain.select(
        "_id",
        "host",
        counts.alias("c"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_line.alias("l"),
    )
    found = found.select(
        F.col("_id").alias(id_col),
        "host",
        F.col("c.n_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.coalesce("l.n_lines", F.when(F.col("c.n_words") > 0, 1).otherwise(0)).cast("long").alias("n_lines"),
        F.coalesce("l.n_dup_lines", F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("c.n_repeat_words").cast("long").alias("n_repeat_words"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    further = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    return found.withColumn("base_failed", base).withColumn("failed", base | further)


def host_verdicts(rules: DataFrame, host_limit: float) -> DataFrame:
    """host, host_rate (drawn towards the prior), host_failed."""
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    row = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.avg(F.col("bad") / F.col("n")).alias("mean"), F.var_pop(F.col("bad") / F.col("n")).alias("var")).first()
    mean = min(max(row["mean"] or 0.0, 1e-6), 1 - 1e-6)
    strength = min(mean * (1 - mean) / row["var"] - 1, 1000.0) if row["var"] else 1000.0
    a, b = mean * max(strength, 0.1), (1 - mean) * max(strength, 0.1)
    rate = (F.col("bad") + a) / (F.col("n") + a + b)
    return hosts.select("host", rate.alias("host_rate"), (rate > host_limit).alias("host_failed"))


def quality_rules(documents: DataFrame, *, host_limit: float = 0.6, **columns) -> DataFrame:
    """document_rules with host_rate, host_failed and kept: a document stays unless it fails base rules or its host is rejected."""
    rules = stash(document_rules(documents, **columns))
    joined = rules.join(host_verdicts(rules, host_limit), "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i : i + 2], ' ')) AS k FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 3)) AS r(p) GROUP BY rid),
f AS (
  SELECT rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS further FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR further) AS bad FROM g GROUP BY host),
m AS (SELECT least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS mean, var_pop(bad / n) AS v FROM h),
p AS (SELECT mean, greatest(CASE WHEN v > 0 THEN least(mean * (1 - mean) / v - 1, 1000.0) ELSE 1000.0 END, 0.1) AS s FROM m),
v AS (SELECT host, (bad + mean * s) / (n + s) > 0.6 AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept FROM g JOIN v USING (host)
"""
