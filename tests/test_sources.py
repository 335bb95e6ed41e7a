import zipfile

import pytest

from cohortry.sources import files, office


def _workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>x y</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>hi</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    _workbook(path)
    assert office.sheet_names(path) == ["One", "Two"]
    got = office.workbook(spark, path)
    assert got["One"].columns == ["id", "column_1", "x y"]
    assert [tuple(r) for r in got["One"].collect()] == [("7", None, "hi")]
    assert got["Two"].count() == 0


def test_document_tables(spark, tmp_path):
    path = str(tmp_path / "a.docx")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr>{cell('age')}{cell('years')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr><w:tr>{cell('not a name!')}</w:tr></w:tbl></w:body></w:document>")
    office.register(spark)
    df = spark.read.format("docx_tables").load(path)
    assert [tuple(r) for r in df.collect()] == [("0", "0", "age", "years"), ("0", "2", "not a name!", None)]
    assert office.variable_rows(df).count() == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>")
    made = []
    path = str(tmp_path / "m")
    make = lambda: made.append(1) or df
    files.cached_matrix(spark, path, 1, make), files.cached_matrix(spark, path, 1, make), files.cached_matrix(spark, path, 2, make)
    assert len(made) == 2
    empty = spark.createDataFrame([], "a string, b int")
    files.write_csv(empty, str(tmp_path / "c"), single=True)
    assert files.read_csv(spark, str(tmp_path / "c"), "a string, b int").count() == 0
    files.write_metadata(spark, str(tmp_path / "meta.json"), seed=42)
    assert files.read_json(spark, str(tmp_path / "meta.json")).first()["seed"] == 42
    (tmp_path / "env").write_text("# c\nA=1\nB = 'x'\n")
    own = {"A": "0"}
    assert files.load_settings(str(tmp_path / "env"), own) == {"A": "1", "B": "x"} and own == {"A": "0", "B": "x"}


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "here").write_text("x")
    files.require_inputs(spark, str(tmp_path / "here"), f"file://{tmp_path}/here")
    with pytest.raises(FileNotFoundError, match="missing input: .*/one, .*/two$"):
        files.require_inputs(spark, str(tmp_path / "one"), str(tmp_path / "here"), str(tmp_path / "two"))
