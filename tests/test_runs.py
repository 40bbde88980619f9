import json

from labelloom.plans import runs


def test_run(spark, data, tmp_path):
    record = runs.consistency_run(spark, data, str(tmp_path / "out"))
    assert [(r["stage"], r["status"]) for r in record] == [(s, "done") for s in runs.STAGES]
    docs = spark.read.json(str(tmp_path / "out/documents"))
    assert docs.count() == spark.read.parquet(str(tmp_path / "out/results")).select("job_id").distinct().count()
    assert set(json.loads(docs.first().document)) == {"n_pass", "n_review", "n_critical", "overall", "matched_share"}


def test_cases_and_evaluation(spark, tmp_path):
    from labelloom.sources.files import matched_cases

    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"case_id": "a", "glob": "x*.pdf"}, {"case_id": "b", "glob": "*.pdf"}]}))
    files = spark.createDataFrame([("/d/x1.pdf",), ("/d/y.pdf",), ("/d/z.txt",)], "path string")
    got = {r.path: r.case_id for r in matched_cases(files, runs.cases(spark, str(tmp_path / "cases.json"))).collect()}
    assert got == {"/d/x1.pdf": "a", "/d/y.pdf": "b", "/d/z.txt": None}
    e = spark.createDataFrame([("g", 1), ("g", 2)], "g string, k int")
    assert runs.evaluate(e, e, ["g"], ["k"]).first().passed and not runs.evaluate(e, e.where("k = 1"), ["g"], ["k"]).first().passed
