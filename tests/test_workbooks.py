"""Workbooks: files made by hand, formats of dates, damaged files, writes that fail."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gridgauge.sources import excel

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(path, sheets, strings=(), styles="", since_1904=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(since_1904)}"/><sheets>' + "".join(f'<sheet name="S{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for k, s in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", s if s.startswith("!") else f'<worksheet xmlns="{MAIN}"><sheetData>{s}</sheetData></worksheet>')


def read(spark, path, **more):
    return [(r.sheet, r.row, [(c.col, c.kind, c.value) for c in r.cells] if r.cells is not None else None, (r.error or "").split(":")[0]) for r in excel.read(spark, str(path), **more).orderBy("path", "sheet_index", "row").collect()]


def test_cells(spark, tmp_path):
    rows = '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c><c t="str"><v>f</v></c></row><row><c><v>1.50</v></c><c/><c t="b"><v>1</v></c><c t="e"><v>#REF!</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t> line</t></r></is></c></row><row r="9"/><row r="1048576"><c r="XFD1048576"><v>7</v></c></row>'
    book(tmp_path / "a.xlsx", [rows, "", '<row r="1"><c r="A1"><v>2</v></c></row>'], ["<t>é &amp; </t>", "<r><t>two</t></r><r><t>parts</t></r><rPh><t>x</t></rPh>"])
    want = [("S0", 2, [(1, "s", "é & "), (26, "s", "twoparts"), (27, "s", "f")], ""), ("S0", 3, [(0, "n", "1.50"), (2, "b", "true"), (3, "e", "#REF!"), (4, "s", "in line")], ""), ("S0", 1048575, [(16383, "n", "7")], ""), ("S2", 0, [(0, "n", "2")], "")]
    assert read(spark, tmp_path) == want and read(spark, tmp_path / "a.xlsx", sheets=1) == want[:3]


@pytest.mark.parametrize(
    ("code", "want"),
    [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ("[Red]0.0", False), ('"day" 0', False), ("[h]:mm", True), ("mmm yy;@", True), (r"\d0", False), ("[$-409]d/m/yy", True), ("#,##0 _d", False), ("0;yyyy", False), ("h:mm AM/PM", True), ("[>100]0", False)],
)
def test_format_codes(code, want):
    assert excel.is_date_format(code) is want


@pytest.mark.parametrize(
    ("value", "since_1904", "want"),
    [(1, False, "1900-01-01"), (59, False, "1900-02-28"), (60, False, "1900-02-28"), (61, False, "1900-03-01"), (45657, False, "2024-12-31"), (45657.5, False, "2024-12-31 12:00:00"), (0.25, False, "06:00:00"), (44195, True, "2024-12-31"), (1, True, "1904-01-02"), (45657.000011574, False, "2024-12-31 00:00:01"), (0, False, "00:00:00")],
)
def test_serials(value, since_1904, want):
    assert excel.from_serial(value, since_1904) == want


def test_columns_and_serials():
    assert [excel.column_of(x) for x in ("A", "Z", "AA", "XFD")] == [0, 25, 26, 16383] and all(excel.column_of(excel.column_name(k)) == k for k in range(0, 16384, 7))
    assert [excel.from_serial(excel.to_serial(d)) for d in ("1900-01-01", "1900-02-28", "1900-03-01", "2024-12-31")] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-12-31"]


def test_styles(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/><numFmt numFmtId="165" formatCode="0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="22"/></cellXfs>'
    rows = '<row r="1">' + "".join(f'<c s="{s}"><v>45657</v></c>' for s in (0, 1, 2, 3, 9)) + '<c t="d"><v>2024-12-31T01:02:03Z</v></c></row>'
    book(tmp_path / "a.xlsx", [rows], styles=styles)
    book(tmp_path / "b.xlsx", [rows], styles=styles, since_1904=True)
    got = read(spark, tmp_path)
    assert [v for _, _, v in got[0][2]] == ["45657", "2024-12-31", "45657", "2024-12-31", "45657", "2024-12-31 01:02:03"] and got[1][2][1][2] == "2029-01-01"


def test_damaged(spark, tmp_path):
    book(tmp_path / "a.xlsx", ['<row r="1"><c><v>1</v></c></row>', "!not xml", '<row r="1"><c t="s"><v>5</v></c></row>', '<row r="1"><c><v>2</v></c></row>'])
    (tmp_path / "b.xlsx").write_bytes(b"PK nothing")
    (tmp_path / "c.txt").write_bytes(b"x")
    raw = (tmp_path / "a.xlsx").read_bytes()
    (tmp_path / "d.xlsx").write_bytes(raw[: len(raw) // 2])
    got = read(spark, tmp_path)
    assert [(s, r, e) for s, r, _, e in got[:4]] == [("S0", 0, ""), ("S1", None, "ParseError"), ("S2", None, "IndexError"), ("S3", 0, "")]
    assert len(got) == 6 and all(s is None and e for s, _, _, e in got[4:])


def test_sheets_are_partitions(spark, tmp_path, monkeypatch):
    book(tmp_path / "a.xlsx", ['<row r="1"><c><v>1</v></c></row>'] * 3)
    book(tmp_path / "b.xlsx", ['<row r="1"><c><v>1</v></c></row>'])
    reader = excel.Reader({"path": str(tmp_path)})
    assert [p.files for p in reader.partitions()] == [[(f"{tmp_path}/a.xlsx", None), (f"{tmp_path}/b.xlsx", None)]]
    monkeypatch.setattr(excel, "LARGE", 1)
    assert [p.files[0][1] for p in reader.partitions()] == [0, 1, 2, 0] and len(excel.Reader({"path": str(tmp_path), "sheets": "2"}).partitions()) == 3


def rows_of(spark, n, name="a"):
    cells = F.array(F.struct(F.lit("n").alias("kind"), F.col("id").cast("string").alias("value")), F.struct(F.lit("s").alias("kind"), F.lit("\x00a\r\n<").alias("value")))
    return spark.range(n).select(F.lit(name).alias("workbook"), F.lit("x & y").alias("sheet"), F.lit(0).alias("sheet_index"), F.col("id").alias("row"), cells.alias("cells"))


def test_writes(spark, tmp_path):
    at = tmp_path / "out"
    excel.write(rows_of(spark, 3000).unionByName(rows_of(spark, 2, "b/c")), str(at))
    assert sorted(os.listdir(at)) == ["a.xlsx", "b_c.xlsx"]
    got = read(spark, at)
    assert len(got) == 3002 and got[2999] == ("x & y", 2999, [(0, "n", "2999"), (1, "s", "a\r\n<")], "")
    excel.write(rows_of(spark, 5), str(at))
    assert len(read(spark, at)) == 7
    excel.write(rows_of(spark, 5), str(at), "overwrite")
    assert sorted(os.listdir(at)) == ["a.xlsx"]


def test_failed_write_leaves_nothing(spark, tmp_path):
    at = tmp_path / "out"
    excel.write(rows_of(spark, 5), str(at))
    before = (at / "a.xlsx").read_bytes()
    wrong = rows_of(spark, 5).unionByName(rows_of(spark, 900, "c")).withColumn("cells", F.when(F.col("row") == 700, F.array(F.struct(F.lit("d").alias("kind"), F.lit("no date").alias("value")))).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="no date"):
        excel.write(wrong, str(at))
    assert os.listdir(at) == ["a.xlsx"] and (at / "a.xlsx").read_bytes() == before
