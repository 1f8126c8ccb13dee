"""Workbooks written and read back, and such as other programs write."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evenkeel.sources import workbook

ODD = ["plain", " kept  spaces ", "a\nb\r\nc\td", "<x> & \"y\"", "_x0041_ and \x02", "é 日本 😀", "", None, "=1+1", "_x"]


def test_sheets_come_back_as_they_were(spark, tmp_path):
    a = spark.createDataFrame([(i, t, i * 0.1, i % 2 == 0, None) for i, t in enumerate(ODD)], "id long, `text, of it` string, x double, even boolean, none int").repartition(3)
    b = spark.range(2500).select("id", (F.col("id") * 1e10).alias("big"))
    path = f"file://{tmp_path}/book.xlsx"
    workbook.write({"One & <two>": a, "b": b, "empty": b.limit(0)}, path)
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        assert z.testzip() is None and list(workbook.sheet_paths(z)) == ["One & <two>", "b", "empty"]
    got = workbook.read(spark, path, "One & <two>", "even boolean, id long, `text, of it` string, x double, none int, missing string")
    assert sorted(map(tuple, got.select("id", "text, of it", "x", "even", "none", "missing").collect())) == [(i, t, i * 0.1, i % 2 == 0, None, None) for i, t in enumerate(ODD)]
    assert workbook.read(spark, path, "b", "id int, big double").agg(F.sum("id"), F.max("big")).first()[:] == (2500 * 2499 // 2, 2499e10)
    assert workbook.read(spark, path, "empty", "id int").count() == 0 and workbook.cells(spark, path, "none").count() == 0
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["book.xlsx"]


def test_values_that_a_cell_has_no_number_for(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1e300), (4, None)], "id int, x double")
    workbook.write({"s": df}, f"file://{tmp_path}/n.xlsx")
    assert {r["id"]: r["x"] for r in workbook.read(spark, f"file://{tmp_path}/n.xlsx", "s", "id int, x double").collect()} == {1: None, 2: None, 3: 1e300, 4: None}


def test_shared_strings_references_and_gaps(spark, tmp_path):
    main, rel, package = workbook._MAIN, workbook._REL, workbook._PACKAGE
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="7" r:id="x9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="x9" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si><si><t>n</t><phoneticPr fontId="1"/></si></sst>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><f>1+2</f><v>3.0</v></c></row><row r="5"><c r="AB5" t="str"><v>far</v></c><c r="AC5" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>')
    (tmp_path / "o.xlsx").write_bytes(made.getvalue())
    got = [tuple(r) for r in workbook.read(spark, f"file://{tmp_path}/o.xlsx", "S", "name string, n int").collect()]
    assert got == [("two runs", 3), (None, None)]
    far = workbook.cells(spark, f"file://{tmp_path}/o.xlsx").where("row = 5").first()["cells"]
    assert len(far) == 29 and far[27] == "far" and far[28] is None


def test_too_many_rows_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 5)
    workbook.write({"s": spark.range(4)}, f"file://{tmp_path}/a.xlsx")
    with pytest.raises(ValueError, match="5 rows or more"):
        workbook.write({"s": spark.range(5)}, f"file://{tmp_path}/b.xlsx")
    assert not (tmp_path / "b.xlsx").exists()
