import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabprep.errors import Refused
from tabprep.functions import scalar
from tabprep.functions.identity import changed_blocks, content_fingerprint, with_identity
from tabprep.operators import access, curves, prepare, profile, split
from tabprep.plans.recipe import preview_summary, recipe_preview, run_recipe
from tabprep.sources import stored
from tabprep.sources.csv import import_csv
from tabprep.storage import materialize, new_folder

INF = float("inf")


@pytest.fixture(scope="module")
def base(spark):
    rows = [(1.0, "1", True, "a"), (2.0, None, False, "a"), (None, "x", True, "b"), (4.0, "x", False, "b"), (INF, "z", True, "c")]
    return spark.createDataFrame([(f"r{i}", i, *r) for i, r in enumerate(rows)], "_row_id string, _row_order long, num double, text string, flag boolean, grp string").cache()


@pytest.mark.parametrize(("op", "n"), [("eq", 1), ("ne", 3), ("gt", 2), ("gte", 3), ("lt", 1), ("lte", 2)])
def test_comparisons_drop_unknown_rows(base, op, n):
    assert prepare.filter_rows(base, "num", op, 2.0).count() == n


def test_other_filters(base):
    assert prepare.filter_rows(base, "text", "contains_literal", "x").count() == 2
    assert prepare.filter_rows(base, "text", "is_null").count() == prepare.filter_rows(base, "text", "eq", None).count() == 1
    with pytest.raises(Refused):
        prepare.filter_rows(base, "num", "gt", None)
    with pytest.raises(Refused):
        prepare.filter_rows(base, "num", "eq", True)


def test_casts(base):
    with pytest.raises(Refused, match="cast_failure"):
        prepare.cast_column(base, "text", "numeric")
    got = prepare.cast_column(base, "text", "numeric", "invalid_to_null").orderBy("_row_order").select("text").collect()
    assert [r[0] for r in got] == [1.0, None, None, None, None]


def test_fills(base):
    assert prepare.fill_values(base, ["num"], "median") == {"num": 3.0}
    assert prepare.mode_value(base, "grp") == "a"
    with pytest.raises(Refused, match="numeric_fill_required"):
        prepare.fill_values(base, ["text"], "mean")
    with pytest.raises(Refused, match="non_finite_value"):
        prepare.fill_values(base, ["num"], "mean")


def test_duplicates_and_replacements(base):
    kept = prepare.remove_duplicates(base, ["grp"]).orderBy("_row_order").collect()
    assert [r["_row_order"] for r in kept] == [0, 2, 4]
    assert access.duplicate_rows(base, ["grp"]).count() == 4
    assert prepare.replace_values(base, "text", [("1", "one")]).where("text = 'one'").count() == 1
    with pytest.raises(Refused):
        prepare.replace_values(base, "text", [(1, "one")])
    assert prepare.replace_non_finite(base, ["num"]).where("num is null").count() == 2


def test_columns(base):
    with pytest.raises(Refused):
        prepare.drop_columns(base, ["num", "text", "flag", "grp"])
    with pytest.raises(Refused):
        prepare.drop_columns(base, ["_row_id"])
    with pytest.raises(Refused):
        prepare.rename_column(base, "text", "grp")
    assert "name" in prepare.rename_column(base, "text", " name ").columns


def test_append(base):
    both = prepare.append_rows(base, [("v2", base)])
    assert sorted(r["_row_order"] for r in both.collect()) == list(range(10))
    assert both.select("_row_id").distinct().count() == 10
    with pytest.raises(Refused):
        prepare.append_rows(base, [("v2", base), ("v2", base)])


def test_recipe_counts(base):
    steps = [("filter_rows", {"column": "num", "operator": "gte", "value": 2.0}), ("fill_missing", {"columns": ["text"], "strategy": "constant", "constant": "-"}), ("drop_columns", {"columns": ["flag"]})]
    done, report = run_recipe(base, steps)
    assert done.count() == 3
    assert [r["affected_rows"] for r in report.orderBy("step").collect()] == [2, 1, 3]
    with pytest.raises(Refused):
        run_recipe(base, [])


def test_identity_and_fingerprint(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), (F.col("id") % 7).cast("double").alias("v")).repartition(7)
    one = with_identity(df, ["k"], "s")
    assert [r["_row_order"] for r in one.orderBy("k").collect()] == list(range(1000))
    prints = {content_fingerprint(x).first()[0] for x in (one, one.repartition(3), with_identity(df.repartition(2), ["k"], "s"))}
    assert len(prints) == 1
    assert content_fingerprint(one.withColumn("v", F.when(F.col("k") == 5, 0.5).otherwise(F.col("v")))).first()[0] not in prints


def test_a_fingerprint_is_a_tree_that_names_changed_ranges(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(f"r{i}", i, None if i % 7 == 0 else i * 3, "a,b" if i % 2 else "é:") for i in range(300) if not 40 <= i < 72]
    df = spark.createDataFrame(rows, "_row_id string, _row_order long, v long, t string")

    def cell(kind, x):
        return "null" if x is None else f"{kind}:{len(str(x))}:{x}"

    level = {}
    for _, i, v, t in rows:
        level.setdefault(i // 8, []).append(sha(",".join((cell("long", i), cell("long", v), cell("string", t)))))
    while True:
        level = {b: sha("".join(d)) for b, d in sorted(level.items())}
        if max(level) == 0:
            break
        above = {}
        for b, d in level.items():
            above.setdefault(b // 8, []).append(d)
        level = above
    want = sha(f"1:v:bigint,1:t:string|{level[0]}|{len(rows)}")
    for parts in (1, 5):
        assert content_fingerprint(df.repartition(parts), 8).first()[0] == want
    other = df.withColumn("t", F.when(F.col("_row_order").isin(10, 299), "z").otherwise(F.col("t"))).where("_row_order <> 100")
    got = [tuple(r) for r in changed_blocks(df, other, 8).orderBy("block").collect()]
    assert got == [(1, 8, 15), (12, 96, 103), (37, 296, 303)]
    assert content_fingerprint(df.limit(0)).first()[0] == sha("1:v:bigint,1:t:string||0") and changed_blocks(df, df.repartition(3)).count() == 0


def test_profile(spark):
    """Plants: two readings lost, one far away, a column of one value, a code that tells rows apart."""
    rows = [(i, None if i in (3, 8) else 9_000.0 if i == 11 else 20.0 + i % 7, "metre", f"p{i:03}", "north" if i % 12 else "south") for i in range(120)]
    df = spark.createDataFrame(rows, "visit_id long, reading double, unit string, code string, site string")
    assert [r["column"] for r in profile.constant_columns(df).collect()] == ["unit"]
    assert [tuple(r) for r in profile.columns_missing(df).collect()] == [("reading", 2)]
    assert [tuple(r) for r in profile.outliers_iqr(df).collect()] == [("reading", 1)]
    assert {r["column"] for r in profile.possible_ids(df).collect()} == {"visit_id", "code"}
    assert profile.validate_target(df, "site").first()[0] == "target_valid"
    assert [round(x, 6) for x in profile.imbalance(df, "site").first()[:1]] == [round(10 / 120, 6)]
    got = {r["finding"]: (r["severity"], r["columns"]) for r in profile.quality_findings(df, "site").collect()}
    assert got == {"missing_values": ("warning", ["reading"]), "constant_columns": ("issue", ["unit"]), "high_cardinality": ("warning", ["code"]), "possible_ids": ("warning", ["code", "visit_id"]), "outliers": ("warning", ["reading"]), "severe_imbalance": ("issue", ["site"])}
    assert [r["finding"] for r in profile.quality_findings(df.select("visit_id").withColumn("w", F.col("visit_id") % 5).drop("visit_id").distinct()).collect()] == ["no_findings"]


def test_counting_missing_cells_multiplies_no_row(base):
    for found in (profile.missing_cells(base), profile.schema_overview(base), profile.columns_missing(base), profile.fill_stats(base, ["num"])):
        assert "Expand" not in found._jdf.queryExecution().toString()


def test_support_follows_the_smaller_class(spark):
    pairs = [(p, n) for p in (0, 1, 9, 10, 17, 29, 30, 400) for n in (5, 10, 30, 77)]
    got = spark.createDataFrame(pairs, "p long, n long").select("p", "n", scalar.sample_diagnosis(F.col("p"), F.col("n")).alias("d")).collect()
    for r in got:
        low, d = min(r["p"], r["n"]), r["d"]
        assert d["severity"] == ["severe", "limited", "none"][(low >= 10) + (low >= 30)] and d["limited_sample"] == (low < 30)
        assert d["recall_resolution"] == (1 / r["p"] if r["p"] else None)


def test_curves_equal_brute_force(spark):
    rng = random.Random(21)
    rows = [(m, int(rng.random() < s), round(s, 1 + (m == "fine"))) for m in ("fine", "coarse") for s in (rng.random() for _ in range(90))]
    df = spark.createDataFrame(rows, "model string, truth int, score double")
    auc, best, some = ({r["model"]: r for r in t.collect()} for t in (curves.roc_auc(df), curves.optimize_threshold(df, 0.6), curves.candidate_thresholds(df, [0.5, -0.1, 1.2, 0.5])))
    for m in ("fine", "coarse"):
        own = [(t, s) for k, t, s in rows if k == m]
        pos, neg = [s for t, s in own if t], [s for t, s in own if not t]
        assert auc[m]["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / len(pos) / len(neg), abs=1e-6)
        at = {t: (sum(s >= t for s in pos), sum(s >= t for s in neg)) for t in {s for _, s in own}}
        want = max((tp / (tp + fp), tp / len(pos), t) for t, (tp, fp) in at.items() if tp / len(pos) >= 0.6)
        assert best[m]["feasible"] and best[m]["threshold"] == want[2] and best[m]["precision"] == pytest.approx(want[0], abs=1e-6)
        assert [some[m][c] for c in ("threshold", "tp", "fp")] == [0.5, sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)]
    assert curves.candidate_thresholds(df, [0.5, -0.1, 1.2, 0.5]).count() == 2
    with pytest.raises(Refused, match="no_candidate_thresholds"):
        curves.candidate_thresholds(df, [2.0])
    alone = spark.createDataFrame([("m", 0, 0.5)], "model string, truth int, score double")
    assert not curves.optimize_threshold(alone, 0.9).first()["feasible"]


def test_split_is_exact(spark):
    df = spark.range(500).select("id", (F.col("id") < 14).cast("int").alias("target"))
    got = split.stratified_split(df, "target", "id")
    assert got.count() == 500 and got.select("id").distinct().count() == 500
    assert not [p for p in ("_h", "_b", "_start") if p in got.columns]
    counts = {(r["split"], r["target"]): r["count"] for r in got.groupBy("split", "target").count().collect()}
    assert counts["validation", 1] == counts["test", 1] == 2 and counts["validation", 0] == counts["test", 0] == 73


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,f,t,b\n1,1,"a,b",True\n2,NA,x,False\n')
    got = import_csv(spark, f"file://{tmp_path}/a.csv")
    assert got.dtypes == [("n", "bigint"), ("f", "double"), ("t", "string"), ("b", "boolean")]
    assert got.orderBy("n").collect()[0]["t"] == "a,b"
    (tmp_path / "b.csv").write_text("n,n\n1,2\n")
    with pytest.raises(Refused, match="duplicate_column_names"):
        import_csv(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "c.csv").write_text("n,m\n1,2,3\n")
    with pytest.raises(Refused, match="csv_too_many_fields"):
        import_csv(spark, f"file://{tmp_path}/c.csv")


def test_split_follows_the_order_of_hashes(spark):
    df = spark.range(3_000).select("id", (F.col("id") % 3).alias("target"))
    hashed = df.withColumn("h", F.xxhash64("id", F.lit(42))).collect()
    got = {r["id"]: r["split"] for r in split.stratified_split(df, "target", "id").collect()}
    for c in range(3):
        own = [r["id"] for r in sorted((r for r in hashed if r["target"] == c), key=lambda r: r["h"])]
        assert [got[i] for i in own] == ["train"] * 700 + ["validation"] * 150 + ["test"] * 150


def test_csv_files_need_the_same_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("left,right\n1,x\n")
    (tmp_path / "2.csv").write_text("left,right\n2,y\n")
    assert sorted(tuple(r) for r in import_csv(spark, f"file://{tmp_path}").collect()) == [(1, "x"), (2, "y")]
    for other in ("right,left\ny,2\n", "left\n3\n", "left,Right\n3,z\n", "left,right,more\n3,z,w\n"):
        (tmp_path / "2.csv").write_text(other)
        for whole in (True, False):
            with pytest.raises(Refused, match="csv_headers_differ|csv_too_many_fields"):
                import_csv(spark, f"file://{tmp_path}", multi_line=whole)


def test_combine(spark):
    spring = spark.createDataFrame([("oak", 3.5), ("elm", None)], "tree string, height double")
    autumn = spark.createDataFrame([(4, "ash")], "height int, tree string")
    both = split.combine_sources([("spring.csv", spring), ("autumn.csv", autumn)])
    assert both.columns == ["tree", "height", "__source_file"]
    assert sorted((r["tree"], r["height"] or 0, r["__source_file"]) for r in both.collect()) == [("ash", 4.0, "autumn.csv"), ("elm", 0, "spring.csv"), ("oak", 3.5, "spring.csv")]
    assert split.combine_sources([("spring.csv", both), ("again.csv", both)]).columns[-1] == "__source_file_1"
    for bad in (autumn.drop("tree"), autumn.withColumn("girth", F.lit(1)), autumn.withColumn("height", F.lit("tall"))):
        with pytest.raises(Refused, match="incompatible_sources"):
            split.combine_sources([("spring.csv", spring), ("bad.csv", bad)])


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(Refused, match="shared_folder_required"):
        new_folder(Session())


def test_numbering_keeps_columns_of_its_own_names(spark):
    df = spark.range(50).select("id", F.lit("a").alias("_part"), F.lit("b").alias("_at"), F.lit("c").alias("_first"))
    got = with_identity(df, ["id"], "s").collect()
    assert {(r["_part"], r["_at"], r["_first"]) for r in got} == {("a", "b", "c")} and all(r["_row_order"] == r["id"] for r in got)


def test_a_preview_has_shapes_and_a_fingerprint_of_content_and_steps(base):
    steps = [("filter_rows", {"column": "num", "operator": "gte", "value": 2.0}), ("drop_columns", {"columns": ["flag"]})]
    one, two = preview_summary(base, run_recipe(base, steps)[0], steps).first(), preview_summary(base.repartition(3), run_recipe(base, steps)[0], steps).first()
    assert one == two and one[:4] == (5, 4, 3, 3)
    assert preview_summary(base, run_recipe(base, steps[:1])[0], steps[:1]).first()["fingerprint"] != one["fingerprint"]


def test_files_of_equal_names_in_nested_folders(spark, tmp_path):
    for folder, rows in (("a", 1), ("b", 2), ("b/c", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x y.csv").write_text("n\n" + "1\n" * rows)
    paths = [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]
    assert sorted(r["rows"] for r in stored.source_metadata(spark, paths).collect()) == [1, 2, 3]
    manifest = materialize(stored.source_digests(spark, paths))
    assert manifest.count() == 3 and {r["status"] for r in stored.verify_files(spark, manifest, paths).collect()} == {"ok"}
    (tmp_path / "b/x y.csv").write_text("n\n7\n")
    (tmp_path / "b/c/x y.csv").unlink()
    got = sorted((r["path"].rsplit("/", 2)[1], r["status"]) for r in stored.verify_files(spark, manifest, paths).collect())
    assert got == [("a", "ok"), ("b", "changed"), ("c", "missing")]


def test_file_queries_grow_with_the_table(spark, tmp_path):
    from tabprep.queries import QUERIES

    spark.range(20_000).coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    assert QUERIES["source_digests"](spark, f"file://{tmp_path}").count() == 4
    got = {r["status"]: r["count"] for r in QUERIES["verify_files"](spark, f"file://{tmp_path}").groupBy("status").count().collect()}
    assert got == {"ok": 2, "changed": 1, "missing": 1}


def test_recipe_tells_learned_values_warnings_and_changed_rows(base):
    df = base.withColumn("none", F.lit(None).cast("double"))
    steps = [("filter_rows", {"column": "grp", "operator": "ne", "value": "c"}), ("fill_missing", {"columns": ["num", "none"], "strategy": "median"}), ("replace_values", {"column": "text", "mapping": [("x", "y")]}), ("remove_duplicates", {"columns": ["grp"]})]
    _, report, samples = recipe_preview(df, steps)
    got = report.orderBy("step").collect()
    assert got[1]["learned"] == '{"num": 2.0, "none": null}' and [r["warnings"] for r in got] == [[], ["fill_value_not_defined"], [], []]
    assert [tuple(r) for r in samples.collect()] == [(0, "filter_rows", "r4"), *((1, "fill_missing", r) for r in ("r2", "r0", "r1", "r3")), (2, "replace_values", "r2"), (2, "replace_values", "r3"), (3, "remove_duplicates", "r1"), (3, "remove_duplicates", "r3")]


def test_chosen_threshold_has_f1_and_matrix(spark):
    df = spark.createDataFrame([("m", t, s) for t, s in zip([1, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6, 0.1], strict=True)] + [("none", 0, 0.5)], "model string, truth int, score double")
    got = {r["model"]: r for r in curves.optimize_threshold(df, 0.9).collect()}
    assert [got["m"][c] for c in ("threshold", "f1", "tn", "fp", "fn", "tp")] == [0.6, 0.857143, 1, 1, 0, 3]
    assert [got["none"][c] for c in ("feasible", "f1", "tp")] == [False, None, None]
