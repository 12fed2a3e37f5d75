import zipfile

import pytest

from tabprep.errors import Refused
from tabprep.sources import workbooks

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    with zipfile.ZipFile(d / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {M} xmlns:r="{R}"><sheets><sheet name="Second" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {M}><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>")
        first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="B4"><v>7</v></c><c r="C4" t="b"><v>0</v></c></row>'
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {M}><sheetData>{first}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {M}><sheetData/></worksheet>")
    (d / "b.xlsx").write_bytes(b"no package")
    whole = (d / "a.xlsx").read_bytes()
    (d / "c.xlsx").write_bytes(whole[: len(whole) // 2])
    return d


def test_sheets_come_in_workbook_order_and_bad_files_are_told(spark, folder):
    got = [(r["path"][-6:], r["sheet_index"], r["sheet_name"], r["status"]) for r in workbooks.workbook_sheets(spark, f"file://{folder}").collect()]
    assert sorted(got, key=str) == [("a.xlsx", 0, "Second", "ok"), ("a.xlsx", 1, "First", "ok"), ("b.xlsx", None, None, "invalid"), ("c.xlsx", None, None, "invalid")]


def test_one_sheet_as_a_table(spark, folder):
    got = workbooks.load_sheet(spark, f"file://{folder}/a.xlsx", "First")
    assert got.columns == ["name", "n", "ok"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("Anna", None, True), (None, 7.0, False)]


@pytest.mark.parametrize(("name", "sheet", "reason"), [("a", "Second", "sheet_is_empty"), ("a", "Third", "unknown_sheet"), ("b", "First", "invalid_workbook")])
def test_refused_sheets(spark, folder, name, sheet, reason):
    with pytest.raises(Refused, match=reason):
        workbooks.load_sheet(spark, f"file://{folder}/{name}.xlsx", sheet)


def test_cells_beyond_the_header_are_refused(spark, folder, tmp_path):
    more = '<row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row r="2"><c r="A2"><v>3</v></c>{}</row>'
    for name, cells in (("wide", '<c r="E2"><v>4</v></c>'), ("blank", '<c r="E2"/>')):
        with zipfile.ZipFile(folder / "a.xlsx") as old, zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as new:
            for member in old.namelist():
                new.writestr(member, f"<worksheet {M}><sheetData>{more.format(cells)}</sheetData></worksheet>" if member.endswith("s1.xml") else old.read(member))
    with pytest.raises(Refused, match="sheet_has_too_many_cells"):
        workbooks.load_sheet(spark, f"file://{tmp_path}/wide.xlsx", "First")
    assert workbooks.load_sheet(spark, f"file://{tmp_path}/blank.xlsx", "First").count() == 1


def test_a_sheet_is_read_as_a_stream(tmp_path):
    """Memory stays far below what a tree of the sheet takes, and batches are bounded."""
    import tracemalloc

    rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 500}</v></c><c r="B{i}"><v>{i}.5</v></c></row>' for i in range(1, 40_001))
    with zipfile.ZipFile(tmp_path / "long.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f"<workbook {M}/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {M}>{''.join(f'<si><t>text é {i}</t></si>' for i in range(500))}</sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {M}><sheetData>{rows}</sheetData></worksheet>")
    book = workbooks._opened(f"file:{tmp_path}/long.xlsx", None)
    tracemalloc.start()
    n = 0
    for at, cells in workbooks._cells(book, "xl/worksheets/s1.xml"):
        n += 1
        assert at == n and cells == [f"text é {n % 500}", f"{n}.5"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and peak < 3_000_000
    sizes = [len(b) for b in workbooks._in_batches("p", workbooks._cells(book, "xl/worksheets/s1.xml"))]
    assert sum(sizes) == 40_000 and len(sizes) > 1 and max(sizes) * 3 <= workbooks.BATCH_CELLS + 3


def test_large_packages_are_read_from_their_files(spark, folder, monkeypatch):
    from tabprep.sources import stored

    whole = sorted(tuple(r) for r in workbooks.workbook_rows(spark, f"file://{folder}", "First").collect())
    monkeypatch.setattr(stored, "SMALL_BYTES", 0)
    assert sorted(tuple(r) for r in workbooks.workbook_rows(spark, f"file://{folder}", "First").collect()) == whole and len(whole) == 3
    assert workbooks.workbook_sheets(spark, f"file://{folder}").where("status = 'invalid'").count() == 2
