"""Quantiles, features, models and the version log."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabprep.errors import Refused
from tabprep.operators import models, profile
from tabprep.operators.quantiles import quantiles
from tabprep.plans import versions
from tabprep.storage import new_folder

FEATURES = ["x", "y", "kind", "flag"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, None if i % 9 == 0 else float(i % 50), float("nan") if i % 11 == 0 else i * 1.5, None if i % 7 == 0 else "abc"[i % 3], i % 2 == 0, "yes" if i % 50 > 30 else "no") for i in range(400)]
    return spark.createDataFrame(made, "id long, x double, y double, kind string, flag boolean, target string").repartition(5).cache()


def test_quantiles_equal_sorted_values(spark):
    values = [3.0, 1.0, 1.0, 7.0, None, 2.5, 10.0, 1.0]
    df = spark.createDataFrame([(v, None, i) for i, v in enumerate(values)], "a double, b double, c int")
    got = quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 1.0])
    known = sorted(v for v in values if v is not None)
    assert got["b"] == [None] * 4
    assert got["a"] == pytest.approx([1.0, statistics.quantiles(known, n=4, method="inclusive")[0], statistics.median(known), 10.0])
    assert got["c"] == pytest.approx([0, 1.75, 3.5, 7])
    assert quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    one = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),)], "a double")
    assert quantiles(one, ["a"], [0.0, 0.5]) == {"a": [1.0, math.inf]}


def test_quantiles_equal_spark_on_many_rows(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 1237 / 3).alias("v"), (F.col("id") % 3).alias("w"))
    want = df.agg(F.percentile("v", F.array(*(F.lit(s) for s in (0.1, 0.5, 0.9)))), F.median("w")).first()
    got = quantiles(df, ["v", "w"], [0.1, 0.5, 0.9])
    assert got["v"] == pytest.approx(list(want[0])) and got["w"][1] == want[1]


def test_features_are_learned_from_training_rows_only(spark, rows):
    train, other = rows.where("id < 300"), rows.where("id >= 300").withColumn("kind", F.lit("new"))
    got = models.learn(train, FEATURES)
    kept = [r[0] for r in train.select("x").collect() if r[0] is not None]
    assert got.medians["x"] == statistics.median(kept)
    counts = train.where("kind is not null").groupBy("kind").count().collect()
    assert got.modes["kind"] == min(counts, key=lambda r: (-r["count"], r["kind"]))["kind"]
    made = [r[0] for r in models.preprocess(train, other, FEATURES).select(vector_to_array("features")).collect()]
    assert {len(v) for v in made} == {2 + 3 + 2}
    assert all(v[2:5] == [0.0, 0.0, 0.0] and sum(v[5:]) == 1 for v in made)
    scaled = [r[0] for r in models.preprocess(train, train, ["x"]).select(vector_to_array("features")[0]).collect()]
    assert statistics.fmean(scaled) == pytest.approx(0, abs=1e-9) and statistics.pstdev(scaled) == pytest.approx(1)


def test_odd_feature_columns(spark):
    df = spark.createDataFrame([(None, None, "it's", 1), (None, None, "a\\b", 1), (None, None, None, 1)], "a double, b string, `c d` string, same int")
    got = models.learn(df, df.columns)
    assert list(got.medians) == ["same"] and list(got.modes) == ["c d"]
    assert models.preprocess(df, df, df.columns).count() == 3
    with pytest.raises(Refused, match="no_usable_features"):
        models.learn(df, ["a", "b"])


def test_each_tree_weights_the_classes_of_its_bag(spark):
    rows = spark.range(300, numPartitions=3).select(F.col("id").alias("row"), (F.col("id") % 7 == 0).cast("double").alias("label"))
    draws = rows.select("row", "label", *(models.drawn(42, F.lit(b), F.col("row")).alias(f"b{b}") for b in range(20))).collect()
    want = {}
    for b in range(20):
        n = {c: sum(r[f"b{b}"] for r in draws if r["label"] == c) for c in (0.0, 1.0)}
        want |= {(b, c): (n[c], sum(n.values()) / (2 * n[c])) for c in n}
    got = models.bag_weights(rows.repartition(5), "label", "row", 20, 42).collect()
    assert {(r["bag"], r["label"]): (r["n"], pytest.approx(r["weight"])) for r in got} == want
    assert len({w for _, w in want.values()}) > 20
    # the draws are those of a Poisson distribution of mean 1, and bags differ
    flat = [r[f"b{b}"] for r in draws for b in range(20)]
    assert all(abs(flat.count(k) / 6000 - math.exp(-1) / math.factorial(k)) < 0.02 for k in range(5))
    assert len({tuple(r[f"b{b}"] for r in draws) for b in range(20)}) == 20


def test_a_forest_is_the_mean_of_its_trees_and_bags_may_lack_a_class(spark):
    few = spark.createDataFrame([(float(i), i == 3, i) for i in range(8)], "x double, t boolean, i long")
    made = models.VectorAssembler(inputCols=["x"], outputCol="_tp_features").transform(few)
    rows = made.select("_tp_features", F.col("t").cast("double").alias("_tp_label"), F.col("i").alias("_tp_row"))
    bags = models.bag_weights(rows, "_tp_label", "_tp_row", 6, 1).collect()
    assert {r["weight"] for r in bags if sum(o["bag"] == r["bag"] for o in bags) == 1} == {1.0}
    forest = models.bagged_forest(rows, 6, 1)
    assert len(forest.trees) == 6 == len({r["bag"] for r in bags})
    vectors = [r[0] for r in rows.orderBy("_tp_row").select("_tp_features").collect()]
    for v in vectors:
        apart = [t.predictRaw(v) for t in forest.trees]
        assert forest.predictProbability(v)[1] == pytest.approx(statistics.fmean(a[1] / (a[0] + a[1]) for a in apart))


def test_models_learn_a_simple_rule_and_survive_saving(spark, rows):
    fitted = models.train_models(rows, "target", FEATURES)
    scores = models.long_scores(fitted, rows, "target", "yes")
    by = {r["model"]: r for r in models.validation_metrics(scores).collect()}
    assert by["random_forest"]["roc_auc"] > 0.95 and by["logistic_regression"]["roc_auc"] > 0.9
    path = new_folder(spark)
    models.save_package(fitted["random_forest"], path, "random_forest", 0.7, "target", "yes", FEATURES)
    loaded = models.load_package(spark, path)[0].stages[-1]
    assert loaded.getNumTrees == 100 and loaded.getOrDefault("maxDepth") == 12
    got = models.score_batch(spark, path, rows.drop("target"))
    assert got.columns == ["id", "x", "y", "kind", "flag", "score", "predicted"]
    assert got.where("predicted <> (score >= 0.7)").isEmpty()
    assert got.where("predicted").count() == scores.where("model = 'random_forest' and score >= 0.7").count()
    with pytest.raises(Refused, match="unknown_column"):
        models.score_batch(spark, path, rows.drop("x"))
    test = models.final_test(scores, "random_forest", 0.7).first()
    assert test["test_rows"] == 400 and test["threshold"] == 0.7
    stages = [r["stage"] for r in models.metrics_export(scores, scores, "random_forest", 0.7, 0.5).collect()]
    assert len(stages) == 5 and len(set(stages)) == 3
    for bad, reason in (("none", "unknown_model"), ("random_forest", "invalid_threshold")):
        with pytest.raises(Refused, match=reason):
            models.final_test(scores, bad, 0.5 if bad == "none" else 1.5)


def test_targets_that_cannot_be_learned(rows):
    with pytest.raises(Refused, match="target_not_binary"):
        models.train_models(rows, "id", FEATURES)
    with pytest.raises(Refused, match="target_missing"):
        models.train_models(rows.withColumn("target", F.when(F.col("id") > 3, F.col("target"))), "target", FEATURES)


def test_diagnosis_reports_each_check(rows):
    got = {(r["check"], r["column"]): r["value"] for r in profile.diagnose(rows.withColumn("same", F.lit(1)), "target").collect()}
    assert got["missing", "x"] == str(len(range(0, 400, 9))) and got["constant", "same"] == "true" and got["possible_id", "id"] == "true"


def test_versions(spark):
    log = new_folder(spark)
    versions.start_log(spark, log)
    versions.publish(spark.range(5), log, "d", "v1", sources=["a", "b"])
    versions.publish(spark.range(3), log, "e", "w1", sources=["c", "a"])
    versions.publish(spark.range(8), log, "d", "v2", inputs=["v1", "w1"], recipe="r")
    heads = versions.read_log(spark, log, "heads")
    assert {r["dataset"]: (r["version"], r["revision"]) for r in versions.current_heads(heads).collect()} == {"d": ("v2", 2), "e": ("w1", 1)}
    assert [r["version"] for r in versions.version_history(heads, "d").collect()] == ["v1", "v2"]
    assert [(r["input"], r["role"]) for r in versions.version_lineage(versions.read_log(spark, log, "lineage"), "v2").collect()] == [("v1", "base"), ("w1", "append")]
    assert [r["source"] for r in versions.read_log(spark, log, "sources").where("version = 'v2'").orderBy("source_order").collect()] == ["a", "b", "c"]
    assert versions.read_version(spark, log, "v1").count() == 5
    with pytest.raises(Refused):
        versions.read_version(spark, log, "none")
    with pytest.raises(Refused):
        versions.publish(spark.range(1), log, "d", "v3")


def test_preview_status(spark):
    soon, past = dt.datetime(2030, 1, 1), dt.datetime(2020, 1, 1)
    previews = spark.createDataFrame(
        [(1, "d", "v2", 2, soon, None), (2, "d", "v1", 1, soon, None), (3, "d", "v2", 2, past, None), (4, "d", "v2", 2, soon, None), (5, "d", "v1", 1, past, "v2"), (6, "none", "v", 1, soon, None)],
        "preview int, dataset string, version string, revision long, expires_at timestamp, applied_version string",
    )
    heads = spark.createDataFrame([("d", "v1", 1), ("d", "v2", 2)], versions.SCHEMAS["heads"])
    verified = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "ok"), (4, "ok"), (4, "changed")], "preview int, status string")
    got = versions.preview_status(previews, heads, verified, F.lit(dt.datetime(2025, 1, 1)))
    assert dict(got.collect()) == {1: "ready", 2: "stale", 3: "expired", 4: "tampered", 5: "applied", 6: "stale"}


def test_one_hot_query_knows_levels_of_odd_ids(spark, tmp_path):
    from tabprep.queries import QUERIES

    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    ids.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) AS quality", "0 AS toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    ids.selectExpr("doc_id", "'t' AS text", "if(doc_id % 2 = 1, 'odd', 'xx') AS lang", "if(doc_id = 7, 'rare', 'web') AS source", "1 AS n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["features"] for r in QUERIES["preprocess_onehot"](spark, f"file://{tmp_path}").collect()}
    assert len(got) == 40 and all(v.count("1") == 2 for v in got.values())


def test_a_hundred_thousand_levels(spark):
    """Places by a numbered dictionary, equal to those of the encoder where that takes the levels, too."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).select("id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"), (F.col("id") % 5).cast("double").alias("x"))
    got = models.preprocess_sparse(df, df, ["url", "x"], scaled=False)
    assert got.where("size <> 100001").count() == 0
    assert got.where("indices[cardinality(indices) - 1] <> id + 1 OR cardinality(indices) <> if(x = 0, 1, 2)").count() == 0
    with pytest.raises(Refused, match="too_many_levels"):
        models.preprocess(df, df, ["url"])
    few = df.where("id < 40").withColumn("url", F.when(F.col("id") % 9 != 0, F.concat(F.lit("v"), (F.col("id") % 6).cast("string"))))
    other = few.withColumn("url", F.when(F.col("id") == 3, "new").otherwise(F.col("url")))
    dense = {r["id"]: r["f"] for r in models.preprocess(few, other, ["x", "url"]).select("id", models.vector_to_array("features").alias("f")).collect()}
    for r in models.preprocess_sparse(few, other, ["x", "url"]).collect():
        row = [0.0] * r["size"]
        for i, v in zip(r["indices"], r["values"]):
            row[i] = v
        assert row == pytest.approx(dense[r["id"]])
