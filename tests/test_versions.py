from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabprep.errors import Refused
from tabprep.plans import versions
from tabprep.storage import new_folder

STEPS = [("filter_rows", {"column": "num", "operator": "gte", "value": 2.0}), ("fill_missing", {"columns": ["text"], "strategy": "constant", "constant": "-"})]


def start(spark, revisions=1):
    """A log with a data set of five rows and so many revisions."""
    rows = [(f"r{i}", i, float(i), None if i % 2 else "x") for i in range(5)]
    df = spark.createDataFrame(rows, "_row_id string, _row_order long, num double, text string")
    log = new_folder(spark)
    versions.start_log(spark, log)
    versions.publish(df, log, "d/s", "v1", sources=["b", "a"])
    for i in range(2, revisions + 1):
        versions.publish(df, log, "d/s", f"v{i}", inputs=[f"v{i - 1}"])
    return log


def heads(spark, log):
    return [(r["version"], r["revision"]) for r in versions.version_history(versions.read_log(spark, log, "heads"), "d/s").collect()]


def test_applying_a_preview_twice_gives_one_version(spark):
    log = start(spark)
    name, report, samples = versions.preview(spark, log, "d/s", STEPS)
    assert heads(spark, log) == [("v1", 1)] and report.count() == 2 and samples.count() == 3
    version = versions.apply_preview(spark, log, name)
    assert versions.apply_preview(spark, log, name) == version and heads(spark, log) == [("v1", 1), (version, 2)]
    got = versions.read_version(spark, log, version).orderBy("_row_order").collect()
    assert [(r["num"], r["text"]) for r in got] == [(2.0, "x"), (3.0, "-"), (4.0, "x")]
    row = versions.read_log(spark, log, "versions").where(F.col("version") == version).collect()
    assert len(row) == 1 and row[0]["path"].endswith(f"/candidates/{name}")  # nothing was worked out or written again
    lineage = versions.version_lineage(versions.read_log(spark, log, "lineage"), version).collect()
    assert [(r["input"], r["role"]) for r in lineage] == [("v1", "base")]
    assert [r["source"] for r in versions.read_log(spark, log, "sources").where(F.col("version") == version).orderBy("source_order").collect()] == ["b", "a"]


def test_going_on_after_a_run_that_broke_off(spark, monkeypatch):
    log = start(spark)
    name = versions.preview(spark, log, "d/s", STEPS)[0]
    commit = versions._commit
    for broken in ("_told", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(versions, broken, lambda *a: (_ for _ in ()).throw(RuntimeError("broken")))
            with pytest.raises(RuntimeError):
                versions.apply_preview(spark, log, name)
        assert heads(spark, log) == [("v1", 1)]
    assert commit is versions._commit
    version = versions.apply_preview(spark, log, name)
    assert heads(spark, log) == [("v1", 1), (version, 2)]
    assert versions.read_log(spark, log, "lineage").where(F.col("version") == version).count() == 1


def test_expired_stale_unknown_and_changed_previews_are_refused(spark):
    log = start(spark)
    with pytest.raises(Refused, match="preview_not_found"):
        versions.apply_preview(spark, log, "none")
    with pytest.raises(Refused, match="lifetime_must_be_positive"):
        versions.preview(spark, log, "d/s", STEPS, timedelta(0))
    with pytest.raises(Refused, match="unknown_dataset"):
        versions.preview(spark, log, "other", STEPS)
    one, two, three = (versions.preview(spark, log, "d/s", STEPS)[0] for _ in range(3))
    with pytest.raises(Refused, match="preview_expired"):
        versions.apply_preview(spark, log, one, F.current_timestamp() + F.expr("interval 2 hours"))
    part = sorted(Path(f"{log}/candidates/{one}".removeprefix("file://")).glob("part-*"))[0]
    whole = part.read_bytes()
    part.with_name(f".{part.name}.crc").unlink()  # else the file system itself refuses to read it
    part.write_bytes(whole[:-1] + b"?")
    with pytest.raises(Refused, match="preview_tampered"):
        versions.apply_preview(spark, log, one)
    part.write_bytes(whole)
    part.with_name("part-more.parquet").write_bytes(whole)
    with pytest.raises(Refused, match="preview_tampered"):
        versions.apply_preview(spark, log, one)
    part.with_name("part-more.parquet").unlink()
    version = versions.apply_preview(spark, log, one)
    with pytest.raises(Refused, match="preview_stale"):
        versions.apply_preview(spark, log, two)
    assert heads(spark, log) == [("v1", 1), (version, 2)] and three


def test_of_two_that_publish_at_once_one_is_refused(spark, monkeypatch):
    """The second has read the same head before the first commits."""
    log = start(spark)
    name = versions.preview(spark, log, "d/s", STEPS)[0]
    told = versions._told

    def slow(*a):
        told(*a)
        monkeypatch.setattr(versions, "_told", told)
        versions.publish(versions.read_version(spark, log, "v1"), log, "d/s", "w", inputs=["v1"])

    monkeypatch.setattr(versions, "_told", slow)
    with pytest.raises(Refused, match="preview_stale"):
        versions.apply_preview(spark, log, name)
    assert heads(spark, log) == [("v1", 1), ("w", 2)] and versions.head_of(spark, log, "d/s") == ("w", 2)


def test_an_append_of_other_versions_is_in_the_lineage(spark):
    log = start(spark, revisions=2)
    name = versions.preview(spark, log, "d/s", [("append_rows", {"versions": ["v1"]}), ("drop_missing_rows", {"columns": ["text"]})])[0]
    version = versions.apply_preview(spark, log, name)
    assert versions.read_version(spark, log, version).count() == 6
    lineage = versions.version_lineage(versions.read_log(spark, log, "lineage"), version).collect()
    assert [(r["input"], r["role"]) for r in lineage] == [("v2", "base"), ("v1", "append")]
    assert versions.read_log(spark, log, "sources").where(F.col("version") == version).count() == 2


@pytest.mark.parametrize("few", [0, 10_000])
def test_no_task_takes_all_inherited_sources(spark, monkeypatch, few):
    monkeypatch.setattr(versions, "ROWS_A_TASK", 40, raising=False)
    monkeypatch.setattr(versions, "FEW", few, raising=False)
    inputs = [(f"v{i}", f"v{(i + j) % 100}", j) for i in range(100) for j in (0, 7)]
    own = [(f"v{i}", f"s{(i * 3 + j) % 50}", j) for i in range(100) for j in range(5)]
    got = versions.inherit_sources(spark.createDataFrame(inputs, "version string, input string, input_order int"), spark.createDataFrame(own, "version string, source string, source_order int"))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    want = set()
    for i in range(100):
        seen = dict.fromkeys(s for j in (0, 7) for v, s, _ in own if v == f"v{(i + j) % 100}")
        want |= {(f"v{i}", s, k) for k, s in enumerate(seen)}
    assert len(rows) == len(want) and {(r["version"], r["source"], r["source_order"]) for r in rows} == want
    assert max(sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}) < len(rows) / 5
