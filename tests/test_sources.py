import json
import struct
import zipfile

import pytest

from labelloom.sinks import artifacts
from labelloom.sources import files, plugins, recorded, workbook
from tests.conftest import rows


def _xlsx(path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda c, t, v: f'<c r="{c}" t="inlineStr"><is><t>{v}</t></is></c>' if t == "s" else f'<c r="{c}" s="{t}"><v>{v}</v></c>'
    sheet = (
        f"<worksheet {m}><sheetData><row>{cell('A1', 's', '说明')}</row><row>{cell('A2', 's', '标签 项目')}{cell('B2', 's', '客户填写原文')}{cell('C2', 's', '列3')}{cell('D2', 's', '标签项目')}</row>"
        f"<row>{cell('A3', 's', '净含量')}{cell('B3', 0, '0.5')}</row><row>{cell('A4', 's', '占比')}{cell('B4', 1, '0.25')}</row><row>{cell('A5', 's', '日期')}{cell('B5', 2, '45658')}</row></sheetData></worksheet>"
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="标签主文字" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_workbook(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = workbook.read_cells(spark, str(tmp_path))
    assert cells.where("error is not null").count() == 1
    good = cells.where("error is null")
    got = {(r.header, r.coord): r.text for r in workbook.sheet_rows(good).collect()}
    assert got == {("标签项目", "A3"): "净含量", ("客户填写原文", "B3"): "0.5", ("标签项目", "A4"): "占比", ("客户填写原文", "B4"): "25%", ("标签项目", "A5"): "日期", ("客户填写原文", "B5"): "2025-01-01"}
    assert workbook.missing_sheets(good).count() == 5


def test_polygon_and_layout_lines(spark):
    poly = {"result": {"ocrResults": [{"prunedResult": {"rec_texts": ["a", " ", "b"], "rec_scores": [0.9], "dt_polys": [[[0, 0], [50, 0], [50, 10], [0, 10]], None, [[5, 5], [5, 5]]]}}]}}
    layout = {"layout_details": [[{"index": 2, "label": "table", "content": "| a | b |\n| --- | --- |\n| c | d |"}, {"index": 3, "label": "text", "content": "x\n\ny"}]]}
    df = spark.createDataFrame([("p", json.dumps(poly)), ("l", json.dumps(layout)), ("e", "{}")], "doc string, body string")
    out = recorded.any_lines(df, "doc", "body")
    assert rows(out.select("doc", "page", "text", "confidence")) == [("l", 1, "a b", 1.0), ("l", 1, "c d", 1.0), ("l", 1, "x", 1.0), ("l", 1, "y", 1.0), ("p", 1, "a", 0.9), ("p", 1, "b", 0.0)]
    boxes = {r.text: r.bbox_pdf for r in recorded.polygon_lines(df.where("doc = 'p'"), "doc", "body", 50.0, 10.0).collect()}
    assert tuple(boxes["a"])[:4] == (0.0, 0.0, 50.0, 10.0) and boxes["b"] is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.ord for r in recorded.read_json_lines(spark, str(tmp_path)).orderBy("ord").collect()] == [0, 2]


def test_html_images_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b &amp; c</td></tr><tr><td> </td></tr></table><p>x</p>"), (2, None), (3, "<table><tr><td>open")], "k int, h string")
    assert rows(files.html_table_cells(df, "k", "h")) == [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b & c")]
    assert files.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == (3, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 10
    assert files.image_size(jpeg) == (9, 7) and files.image_size(b"GIF") is None
    (tmp_path / "m.json").write_text(json.dumps({"document": {"path": "in.pdf"}}))
    assert files.manifest_input(tmp_path / "m.json") == (tmp_path / "in.pdf").resolve()
    (tmp_path / ".env").write_text("A_KEY='v'\n# c\n")
    assert files.settings(tmp_path / ".env", {"KEY": ["A_KEY"], "NONE": []}) == {"KEY": "v", "NONE": None}


def test_plugins_and_sinks(spark, tmp_path):
    made = spark.createDataFrame([("f", bytearray(json.dumps([{"page": 2, "text": "x"}, {"text": " "}]).encode())), ("bad", bytearray(b"{"))], "path string, content binary")
    out = {r.path: r for r in plugins.lines_of(made, plugins.Replay).collect()}
    assert (out["f"].page, out["f"].text) == (2, "x") and out["bad"].error.startswith("JSONDecodeError")

    class Echo:
        def answer(self, prompt):
            if prompt == "fail":
                raise ValueError("no")
            return json.dumps({"p": prompt})

    prompts = spark.createDataFrame([(1, "a"), (2, "fail")], "k int, p string")
    assert {r.k: r.error for r in plugins.answers_of(prompts, "k", "p", Echo).collect()} == {1: None, 2: "ValueError: no"}
    artifacts.write_documents(spark.createDataFrame([("j", 1)], "job_id string, n int"), "job_id", str(tmp_path / "out"))
    index = artifacts.artifact_index(spark, str(tmp_path / "out")).collect()
    assert index and all(r.sha256.startswith("sha256:") for r in index)
    failed = artifacts.failure_results(spark.createDataFrame([("j", "ocr", "E", "why")], "job_id string, stage string, error_type string, reason string"))
    assert set(artifacts.ROOT_KEYS) <= set(failed.columns) and len(failed.first().review_tasks) == 1
    assert artifacts.redacted_bundle(spark.createDataFrame([("/root/x a@b.co",)], "t string"), "t").first() == ("<path> <email>", False)


def test_manifest_paths(tmp_path):
    for body, want in [({"inputs": [{"file_path": "b.pdf"}]}, "b.pdf"), ({"input_pdf": " ", "document": {"path": "c.pdf"}}, "c.pdf"), ({"inputs": [], "input": {"file_path": "d"}}, "d")]:
        (tmp_path / "m.json").write_text(json.dumps(body))
        assert files.manifest_input(tmp_path / "m.json").name == want
    for body in ([], {}, {"inputs": [1]}, {"input_pdf": 3}):
        (tmp_path / "m.json").write_text(json.dumps(body))
        with pytest.raises(ValueError):
            files.manifest_input(tmp_path / "m.json")


def test_tokens(spark):
    tokens = ["净", " ", {"text": "含", "line_index": 0, "box": [1, 2, 3, 4]}, {"token": "量", "line_index": 1, "points": [[0, 0], [5, 0], [5, 6]]}]
    df = spark.createDataFrame([("a", json.dumps(tokens, ensure_ascii=False)), ("b", json.dumps([{"text": "x", "line": 1}])), ("c", None)], "k string, tokens string")
    got = [tuple(r) for r in recorded.token_rows(df, "k", "tokens").orderBy("k", "token_no").collect()]
    assert got == [("a", 1, "净", None, None, None, None, None), ("a", 3, "含", 1, 1.0, 2.0, 3.0, 4.0), ("a", 4, "量", 2, 0.0, 0.0, 5.0, 6.0), ("b", 1, "x", 1, None, None, None, None)]


def test_nothing_leaks(spark):
    df = spark.createDataFrame([("mail a@b.co",)], "t string")
    assert artifacts.publishable(df, "t").first().t == "mail <email>"
    with pytest.raises(Exception, match="still holds"):
        artifacts.publishable(spark.createDataFrame([("AKIA" + "A" * 16,)], "t string"), "t").collect()


def test_optional_files_and_dictionaries(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"scope": {"label": ["净含量", " "], "process": ["打样"]}}, ensure_ascii=False))
    assert rows(files.dictionary(spark, str(tmp_path / "d.json"))) == [("scope", "label", "净含量"), ("scope", "process", "打样")]
    (tmp_path / "i.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    assert rows(files.optional_json(spark, str(tmp_path / "i.json"), "id string, n int")) == [("a", 1), ("b", None)]
    none = files.optional_json(spark, str(tmp_path / "none.json"), "id string, n int")
    assert none.columns == ["id", "n"] and none.count() == 0


def test_workbook_profile(spark):
    sheet, headers = next(iter(workbook.REQUIRED_HEADERS.items()))
    cells = [("f", sheet, 1, k, "A1", h, None) for k, h in enumerate(headers, 1)] + [("f", sheet, 2, 1, "A2", "v", None), ("f", sheet, 3, 9, "I3", "x", None), ("f", "Notes", 1, 1, "A1", "n", None)]
    df = spark.createDataFrame(cells, "file_name string, sheet string, row int, col int, coord string, text string, error string")
    got = {r.sheet: (r.known, r.header_row, r.columns, r.ignored, r.n_rows) for r in workbook.profile(df).collect()}
    assert got == {sheet: (True, 1, list(headers), [9], 1), "Notes": (False, None, None, None, 0)}
