"""Workbooks: what is written is read back; files as other programs write them; refusals."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import workbook as W

ODD = ["plain", " spaces  kept ", "a<b>&\"c\"'", "line\nbreak\ttab", "bell\x07 and _x0041_", "é😀漢", "", "TRUE", "007", "1e5"]


def test_round_trip_of_sheets_and_cells(spark, tmp_path):
    rows = [(f"20{i % 3}", i, ODD[i % len(ODD)], i * 0.1 if i % 4 else None, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "sheet string, _i int, A string, B double, C boolean").repartition(3)
    path = str(tmp_path / "books")
    W.write_workbook(df, path, "sheet", "_i")
    assert len([f for f in (tmp_path / "books").iterdir()]) == 3  # a file a task, nothing else left
    got = W.read_cells(spark, path, {"A": "string", "B": "double", "C": "boolean"})
    assert sorted((r.sheet, r.A or "", r.B or 0.0, r.C) for r in got.collect()) == sorted((s, a, b or 0.0, c) for s, _, a, b, c in rows)
    one = W.read_cells(spark, path, {"B": "double"}, sheet="201")
    assert {r.sheet for r in one.collect()} == {"201"} and one.count() == 20
    # in a file and sheet rows are in order and numbered without gaps
    for r in got.groupBy("file", "sheet").agg(F.count("*").alias("n"), F.max("row_nr").alias("last")).collect():
        assert r.n == r["last"]
    W.write_workbook(df.limit(1), path, "sheet", "_i", mode="overwrite")
    assert W.read_cells(spark, path, {"A": "string"}).count() == 1


def test_headed_tables_and_missing_columns(spark, tmp_path):
    rows = [("x", 1, "name", "amount"), ("x", 2, "a", "1.5"), ("x", 3, "b", "none"), ("y", 1, "amount", "other"), ("y", 2, "7", "z")]
    df = spark.createDataFrame(rows, "sheet string, _i int, A string, B string").coalesce(1)
    W.write_workbook(df, str(tmp_path / "t"), "sheet", "_i")
    got = W.read_headed(spark, str(tmp_path / "t"), "name string, amount double")
    assert sorted((r.sheet, r.row_nr, r.name or "", r.amount or 0.0) for r in got.collect()) == [("x", 2, "a", 1.5), ("x", 3, "b", 0.0), ("y", 2, "", 7.0)]


def test_files_as_other_programs_write_them(spark, tmp_path):
    """Shared strings with runs, truth values, errors, formulas, gaps, cells without references, parts by absolute target."""
    ns = f'xmlns="{W.MAIN}"'
    sheet = f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2" t="b"><v>1</v></c></row><row r="5"><c><v>1.50</v></c><c t="str"><f>A1</f><v>f</v></c><c t="e"><v>#N/A</v></c><c t="s"/></row><row/></sheetData></worksheet>'
    path = tmp_path / "other.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{W.LINKS}"><sheets><sheet name="Année &amp; co" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}/relationships"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>zero</t></si><si><r><t>ru</t></r><r><t>ns</t></r><rPh><t>hint</t></rPh></si></sst>")
        z.writestr("xl/worksheets/s.xml", sheet)
    spark.dataSource.register(W.Workbook)
    got = [(r.sheet, r.row_nr, r.cells) for r in spark.read.format("workbook").load(str(path)).orderBy("row_nr").collect()]
    assert got == [("Année & co", 2, {"B": "runs", "AA": "TRUE"}), ("Année & co", 5, {"A": "1.50", "B": "f", "C": "#N/A"}), ("Année & co", 6, {})]


def test_names_and_refusals(spark, tmp_path):
    assert [W.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    taken: set[str] = set()
    assert [W.sheet_name(n, taken) for n in ("a/b", "A_B", "x" * 40, "x" * 40, "")] == ["a_b", "A_B (2)", "x" * 31, "x" * 27 + " (2)", "sheet"]
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        W.read_cells(spark, str(tmp_path / "nowhere"), {"A": "string"}).count()
    (tmp_path / "empty").mkdir()
    assert W.read_cells(spark, str(tmp_path / "empty"), {"A": "string"}).count() == 0
    W.write_workbook(spark.createDataFrame([("s", "v")], "sheet string, A string"), str(tmp_path / "w"), "sheet")
    with pytest.raises(Exception, match="no sheet is called"):
        W.read_cells(spark, str(tmp_path / "w"), {"A": "string"}, sheet="t").count()
