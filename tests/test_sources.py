import hashlib

import pytest

from tabprep.errors import Refused
from tabprep.sources import csv, records, stored


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    """Every file is longer than what one task takes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def whole(spark, path, names):
    """The same files, each read whole by one task."""
    return rows_of(spark.read.options(multiLine=True, header=True, quote='"', escape='"', nullValue="\0", emptyValue="", enforceSchema=True, sep=",").schema(", ".join(f"`{n}` string" for n in names)).csv(path))


ODD = 'n.x,"free\ntext",z\n1,"a\nb",x\n\n2,"say ""hi""\n\n,\n",\n3,5" pipe,"ab"c"d\n4,"\r\n",y\n"5\n6\n7\n8\n9",,"q"\n10,last,"open ""\n""end"\n'


@pytest.mark.parametrize("size", [2, 7, 40])
def test_csv_records_are_the_same_wherever_ranges_end(spark, tmp_path, size):
    """Byte ranges of a few bytes: borders fall on every kind of place, some ranges lie within one field."""
    (tmp_path / "a.csv").write_bytes(ODD.encode())
    (tmp_path / "b.csv").write_bytes(('n.x,"free\ntext",z\n' + "".join(f'{i},"{"é" * (i % 4)}\n{i}",\n' for i in range(5))).encode())
    names = ["n.x", "free\ntext", "z"]
    want = whole(spark, f"file://{tmp_path}", names)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = records.lines_of(spark, f"file://{tmp_path}")
        ends = records.range_ends(lines, ",").collect()
        cut = records.records_of(lines, records.begin_inside(ends), ",")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(ends) > 20 * (size < 3) and any(r["spans"] for r in ends)
    cells = csv._cut(spark, cut, dict(sep=",", encoding="utf-8", quote='"', escape='"', nullValue="\0", emptyValue=""))
    assert cells.names == names and rows_of(cells.body) == want
    assert {r["rows"] for r in csv.file_facts(cells).collect()} == {5, len(want) - 5}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,t\n" + "".join(f'{i},"x\n{i}"\n' for i in range(4_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8_000)
    try:
        assert records.lines_of(spark, f"file://{tmp_path}").rdd.getNumPartitions() > 5
        got = csv.import_csv(spark, f"file://{tmp_path}/a.csv")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.dtypes == [("k", "bigint"), ("t", "string")]
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(i, f"x\n{i}") for i in range(4_000)]


@pytest.mark.parametrize("line", ['a,b', '"a",b', '"a,b', 'a"b,"c', '"a""', '""', '"""', '"a"x,"b', ',"', 'a,"b""c', '"a"b"c,"d"', '","', '";"', ' "a,b'])
def test_open_fields_by_steps(line):
    """Against a walk over the characters."""

    def walk(text, inside):
        state = "in" if inside else "start"
        for ch in text + "\0":
            if state == "quote":  # a quote inside a field: doubled, or its end
                state = "in" if ch == '"' else "start" if ch == "," else "plain"
            elif state == "in":
                state = "quote" if ch == '"' else "in"
            elif ch == ",":
                state = "start"
            elif state == "start":
                state = "in" if ch == '"' else "plain"
        return state == "in"

    quotes = records.Quotes(",")
    for inside in (False, True):
        assert quotes.after(line.encode(), inside) == walk(line, inside)


def test_csv_other_line_ends_and_encodings(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes(b'k,t\r1,"x\ry"\r2,z\r')
    assert rows_of(csv.import_csv(spark, f"file://{tmp_path}/a.csv")) == [(1, "x\ny"), (2, "z")]
    (tmp_path / "b.csv").write_bytes('k;t\n1;"é\nß"\n2;ü\n'.encode("latin-1"))
    assert rows_of(csv.import_csv(spark, f"file://{tmp_path}/b.csv", delimiter=";", encoding="latin-1")) == [(1, "é\nß"), (2, "ü")]
    (tmp_path / "c.csv").write_bytes('k,t\n1,"é\nß"\n'.encode("utf-16"))
    assert rows_of(csv.import_csv(spark, f"file://{tmp_path}/c.csv", encoding="utf-16")) == [(1, "é\nß")]
    (tmp_path / "d.csv").write_bytes('﻿k.a,t\n1,"x\ny"\n'.encode())
    assert csv.import_csv(spark, f"file://{tmp_path}/d.csv").columns == ["k.a", "t"]
    with pytest.raises(Refused, match="invalid_csv_delimiter"):
        csv.import_csv(spark, f"file://{tmp_path}/d.csv", delimiter='"')


def test_csv_refusals_with_line_ends_in_fields(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('k,t\n1,"x\ny"\n')
    for other, code in (('k,u\n1,"x\ny"\n', "csv_headers_differ"), ('k,t\n1,"x\ny",3\n', "csv_too_many_fields")):
        (tmp_path / "b.csv").write_text(other)
        with pytest.raises(Refused, match=code):
            csv.import_csv(spark, f"file://{tmp_path}")
    (tmp_path / "b.csv").write_text('k,"k"\n1,"x\ny"\n')
    with pytest.raises(Refused, match="duplicate_column_names"):
        csv.import_csv(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "b.csv").write_text('k,"t\nt"\n')
    with pytest.raises(Refused, match="csv_has_no_rows"):
        csv.import_csv(spark, f"file://{tmp_path}/b.csv")


def test_types_come_from_one_aggregate_that_checks_files(spark, tmp_path):
    """Names that look like values don't count; a line equal to the header does."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("1,NA,True,2.5,w\n" + f"{i},,False,1e3,w\n{i},7,True,inf,w\n")
    got = csv.import_csv(spark, f"file://{tmp_path}")
    assert got.dtypes == [("1", "bigint"), ("NA", "double"), ("True", "boolean"), ("2.5", "double"), ("w", "string")] and got.count() == 6
    (tmp_path / "3.csv").write_text("1,NA,True,2.5,w\nx,,maybe,-,w\n")
    assert [t for _, t in csv.import_csv(spark, f"file://{tmp_path}").dtypes] == ["string", "double", "string", "string", "string"]


def test_csv_jobs_are_few(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,t\n" + "".join(f"{i},x\n" for i in range(100)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("import", "import")
    try:
        csv.import_csv(spark, f"file://{tmp_path}/a.csv", multi_line=False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("import")) <= 6


def test_digests_of_streams_equal_hashlib(spark, tmp_path, monkeypatch):
    parts = {"empty": b"", "a b": b"x" * 3_000_000, "long": bytes(range(256)) * 20_000, "edge": b"y" * (1 << 20)}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    want = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in parts.items()}
    for small in (0, 1 << 20, 1 << 30):
        monkeypatch.setattr(stored, "SMALL_BYTES", small)
        assert {r["name"]: (r["size"], r["sha256"]) for r in stored.source_digests(spark, f"file://{tmp_path}").collect()} == want


def test_a_digest_reads_so_many_bytes_at_once(tmp_path, monkeypatch):
    with (tmp_path / "big").open("wb") as f:
        for _ in range(30):
            f.write(b"z" * (1 << 20))
    import pyarrow as pa

    taken = []
    read = stored.open_stream

    class Watched:
        def __init__(self, path):
            self.stream = read(path)

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.stream.close()

        def read(self, n):
            taken.append(n)
            return self.stream.read(n)

    monkeypatch.setattr(stored, "open_stream", Watched)
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{tmp_path}/big"]), pa.array([30 << 20])], ["path", "length"])
    (got,) = stored._hashed(iter([batch]))
    assert got.column(2)[0].as_py() == hashlib.sha256(b"z" * (30 << 20)).hexdigest()
    assert set(taken) == {1 << 20} and len(taken) == 31


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    plan = stored.source_totals(spark, f"file://{tmp_path}")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<length:bigint>" in plan
