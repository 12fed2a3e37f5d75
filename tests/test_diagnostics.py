"""Table operators over columns whose names hold dots or are used inside, and cells that are NaN; compared with pandas."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.errors import Refused
from tabprep.functions.identity import content_fingerprint, with_identity
from tabprep.operators import access, prepare, profile, quantiles, split
from tabprep.plans.recipe import recipe_preview
from tabprep.storage import materialize

NAMES = ["a.b", "count", "_first", "_h", "_start", "n", "class", "k`0", "_k0", "_input"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        x = math.nan if i % 11 == 0 else None if i % 13 == 0 else 9e5 if i == 17 else float(rng.randrange(20))
        rows.append((f"r{i}", i, x, rng.choice([1, 2]), rng.choice("xy"), i, None if i % 5 == 0 else i % 3, float(i % 7), "only", f"t{i}", i % 4, bool(i % 2)))
    schema = "_row_id string, _row_order long, `a.b` double, count int, _first string, _h long, _start int, n double, class string, `k``0` string, _k0 int, _input boolean"
    return materialize(spark.createDataFrame(rows, schema)), pd.DataFrame(rows, columns=["_row_id", "_row_order", *NAMES])


def test_missing_and_distinct_counts(odd):
    df, table = odd
    got = {r["column"]: r for r in profile.column_stats(df.select([F.col(f"`{c.replace('`', '``')}`") for c in NAMES])).collect()}
    assert {c: (r["n_missing"], r["n_distinct"]) for c, r in got.items() if r["exact"]} == {c: (table[c].isna().sum(), table[c].nunique()) for c in NAMES if got[c]["exact"]}
    assert not got["_h"]["exact"] and abs(got["_h"]["n_distinct"] - 240) < 24 and got["k`0"]["exact"]
    assert {r["column"]: r["n_missing"] for r in profile.schema_overview(df).collect()} == table.isna().sum().to_dict()
    assert [r[0] for r in profile.constant_columns(df).collect()] == ["class"]
    assert sorted(r[0] for r in profile.binary_candidates(df).collect()) == sorted(c for c in table if table[c].nunique() == 2)
    assert {r["column"]: r["n_distinct"] for r in profile.high_cardinality(df).collect()} == {"_row_id": 240, "k`0": 240}
    assert {r[0] for r in profile.possible_ids(df).collect()} == {"_row_id", "k`0"}
    assert profile.duplicate_count(df.select("`a.b`", "count", "_first")).first()[0] == table.duplicated(["a.b", "count", "_first"]).sum()


def test_decided_columns_are_not_counted_exactly(spark, odd, monkeypatch):
    df, _ = odd
    numbers = df.select("_row_order", "_h", F.col("_h").alias("more"), F.col("`a.b`") + F.col("_h"))
    monkeypatch.setattr(F, "count_distinct", lambda *a: pytest.fail("counted"))
    assert profile.binary_candidates(numbers).count() == profile.constant_columns(numbers).count() == 0


def test_quartiles_take_nan_as_missing(spark, odd):
    df, table = odd
    x = table["a.b"]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    want = int(((x < q1 - 3 * (q3 - q1)) | (x > q3 + 3 * (q3 - q1))).sum())
    assert {r["column"]: r["outliers"] for r in profile.outliers_iqr(df.drop("_row_order")).collect()} == {"a.b": want}
    few = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 1000.0, math.nan) for _ in range(20)], "`a.b` double")
    assert profile.outliers_iqr(few, 0.1).collect()[0]["outliers"] == 20  # the thousands, not the NaNs
    same = spark.createDataFrame([(float(i), math.nan if i == 3 else float(i)) for i in range(9)], "`a.b` double, count double")
    assert profile.scaling_hint(same).first()[0] is False and profile.scaling_hint(same.select("count")).first()[0] is False
    assert profile.outliers_iqr(df.select("_first")).count() == 0
    assert quantiles.quantiles(df, ["_h", "n"], [0.5]) == {"_h": [table["_h"].median()], "n": [table["n"].median()]}


@pytest.mark.parametrize("target", ["count", "_input"])
def test_targets_of_such_names(odd, target):
    df, table = odd
    counts = table[target].value_counts()
    assert {r["class"]: r["count"] for r in profile.class_summary(df, target).collect()} == counts.to_dict()
    assert profile.imbalance(df, target).first()["minority"] == round(counts.min() / len(table), 6)
    assert profile.validate_target(df, target).first()[0] == "target_valid"
    assert profile.prevalence(df, "count").first()["prevalence"] == round((table["count"] == 2).mean(), 6)
    assert profile.diagnose(df, target).count() > 5 and profile.quality_findings(df, target).count() > 1


def test_steps_on_such_names(odd):
    df, table = odd
    orders = lambda x: [r["_row_order"] for r in x.orderBy("_row_order").collect()]
    assert orders(prepare.filter_rows(df, "a.b", "gte", 5.0)) == table[(table["a.b"] >= 5) | table["_row_order"].isin([i for i in range(240) if i % 11 == 0])]["_row_order"].tolist()  # NaN is the greatest in comparisons
    assert orders(prepare.drop_missing_rows(df, ["_start"])) == table[table["_start"].notna()]["_row_order"].tolist()
    for key in (["_first", "count"], ["_start"]):
        first = table.drop_duplicates(key)["_row_order"].tolist()
        kept = prepare.remove_duplicates(df, key)
        assert orders(kept) == first and kept.columns == df.columns
        assert orders(access.removed_duplicates(df, key, 1_000)) == sorted(set(range(240)) - set(first))
        assert orders(access.duplicate_rows(df, key)) == table[table.duplicated(key, keep=False)]["_row_order"].tolist()
    assert prepare.fill_values(df, ["n", "_start"], "mean") == pytest.approx({"n": table["n"].mean(), "_start": table["_start"].mean()})
    assert prepare.fill_values(df, ["_start"], "median") == {"_start": table["_start"].median()}
    assert prepare.mode_value(df, "count") == table["count"].mode()[0]
    assert prepare.fill_missing(df, ["a.b"], "constant", 1.5).where("`a.b` = 1.5").count() == sum(i % 13 == 0 and i % 11 != 0 for i in range(240))
    assert prepare.replace_values(df, "_first", [("x", "z")]).where("_first = 'z'").count() == (table["_first"] == "x").sum()
    assert prepare.cast_column(df, "_h", "string").schema["_h"].dataType.typeName() == "string"
    assert prepare.rename_column(df, "a.b", "c.d").columns[2] == "c.d" and "a.b" not in prepare.drop_columns(df, ["a.b"]).columns
    both = prepare.append_rows(df, [("v", df)])
    assert both.columns == df.columns and orders(both) == list(range(480)) and both.where("_input").count() == 240
    assert access.select_columns(df, ["a.b", "k`0"]).columns == ["a.b", "k`0"] and access.aggregate_value(df, "_h", "sum").first()[0] == 240 * 239 // 2


def test_split_leaves_columns_of_its_own_names(odd):
    df, table = odd
    got = split.stratified_split(df, "count", "_row_id")
    assert got.columns == [*df.columns, "split"]
    back = got.toPandas().sort_values("_row_order").reset_index(drop=True)
    for c in ("_h", "_start", "_first"):
        assert back[c].astype(object).where(back[c].notna(), None).tolist() == table[c].astype(object).where(table[c].notna(), None).tolist()
    assert sorted(back.groupby("split").size().tolist()) == [36, 36, 168]


def test_identity_recipe_and_fingerprint_on_such_names(odd):
    df, _ = odd
    one = with_identity(df.drop("_row_id", "_row_order"), ["_h"], "s")
    assert content_fingerprint(one).first() == content_fingerprint(one.repartition(5)).first()
    done, report, samples = recipe_preview(df, [("fill_missing", {"columns": ["a.b"], "strategy": "constant", "constant": 0.0}), ("replace_non_finite", {"columns": ["a.b"]}), ("remove_duplicates", {"columns": ["_first", "_start"]})])
    assert done.columns == df.columns and report.count() == 3 and samples.count() == 100


def test_five_steps_take_few_jobs_and_no_step_works_out_those_before_again(spark, odd):
    df, table = odd
    steps = [
        ("filter_rows", {"column": "_h", "operator": "gte", "value": 10}),
        ("fill_missing", {"columns": ["_start"], "strategy": "mean"}),
        ("replace_non_finite", {"columns": ["a.b"]}),
        ("drop_missing_rows", {"columns": ["a.b"]}),
        ("remove_duplicates", {"columns": ["count", "_first", "_k0"]}),
    ]
    spark.sparkContext.setJobGroup("recipe", "recipe")
    try:
        done, report, _ = recipe_preview(df, steps, samples=0)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("recipe"))
    left = table[(table["_h"] >= 10) & ~table["_row_order"].isin([i for i in range(240) if i % 13 == 0 and i % 11])]
    want = left.drop_duplicates(["count", "_first", "_k0"])
    assert [r["_row_order"] for r in done.orderBy("_row_order").collect()] == want["_row_order"].tolist()
    got = [tuple(r)[2:5] for r in report.orderBy("step").collect()]
    gaps = int(((table["_h"] >= 10) & table["_start"].isna()).sum())
    assert got == [(10, 0, 230), (gaps, gaps, 230), (0, 0, 230), (230 - len(left), 0, len(left)), (len(left) - len(want), 0, len(want))]
    assert jobs <= 16, jobs


def test_strict_casts_in_a_recipe_are_refused_once_counted(odd):
    df, _ = odd
    with pytest.raises(Refused, match="cast_failure"):
        recipe_preview(df, [("cast_column", {"column": "k`0", "target": "numeric"}), ("filter_rows", {"column": "_h", "operator": "lt", "value": 5})])
    done, report, samples = recipe_preview(df, [("cast_column", {"column": "k`0", "target": "numeric", "failure_policy": "invalid_to_null"}), ("rename_column", {"column": "a.b", "name": " c.d "}), ("drop_columns", {"columns": ["count", "_h"]})], samples=5)
    assert [tuple(r)[2:6] for r in report.orderBy("step").collect()] == [(240, 240, 240, 10), (240, 0, 240, 10), (240, 480, 240, 8)]
    assert "c.d" in done.columns and [r[2] for r in samples.collect()] == [f"r{i}" for i in range(5)]
