import json

from labelloom.operators.nested import flat_table, nested_links, nested_nodes, visit
from tests.conftest import rows

SCHEMA = "result_id long, job_id string, tables_json string, evidence_json string, extracted_json string, node_kind string, payload int"


def links(tables=None, evidence=None, extracted=None, job="j"):
    dump = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return [v[:3] for v in visit(job, dump(tables), dump(evidence), dump(extracted))]


def test_shapes_give_the_same_links():
    a = links([{"table_id": "t", "rows": [{"cells": [{"column_id": "c1", "raw_value": "x", "evidence_refs": ["e1", "e2"]}]}]}])
    b = links({"tableId": "t", "rows": {"cells": {"c1": {"rawValue": "x", "evidenceRefs": ["e1", "e2"]}}}})
    c = links(json.dumps(json.dumps([{"table_id": "t", "rows": json.dumps([{"cells": {"column_id": "c1", "evidence_refs": '["e1","e2"]'}}])}])))
    assert a == b == c == [("table", "j", "t"), ("row", "t", "t#1"), ("cell", "t#1", "t#1#c1"), ("cell_ref", "t#1#c1", "e1"), ("cell_ref", "t#1#c1", "e2")]


def test_fields_and_evidence():
    data = {"entities": {"entity_id": "p"}, "fields": {"f1": {"semantic_key": "k", "entityId": "p", "evidence_refs": "e1"}, "f2": {"entity_id": None}}, "requirements": [{"requirementId": "r"}, {}]}
    assert links(None, {"evidenceId": "e1", "sourceNodeIds": "s1"}, data) == [
        ("evidence", "j", "e1"), ("node", "e1", "s1"), ("entity", "j", "p"), ("field", "p", "f1"), ("field_ref", "f1", "e1"), ("field", "j", "f2"), ("requirement", "j", "r"),
    ]


def test_broken_and_empty_parts_give_nothing():
    for bad in (None, "", "[", "null", '[{"table_id": "t"', "3", '"x"', "[]", "{}", "[null, 1, \"a\", []]", "[" * 5000):
        assert links(bad, bad, bad) == []
    assert links([{"rows": []}, {"table_id": " "}, {"table_id": "t", "rows": [None, {"cells": None}]}]) == [("table", "j", "t"), ("row", "t", "t#2")]


def test_distributed_and_flat(spark):
    t = json.dumps([{"table_id": "t\ud800", "title": "x", "rows": []}])
    e = json.dumps([{"evidence_id": f"e{n}", "source_text": "字" * 2000} for n in range(50)])
    df = spark.createDataFrame([(1, "j", t, e, None, "x", 1), (2, "j", t, e, "bad", "x", 1), (3, None, t, None, None, None, None)], SCHEMA)
    out = nested_links(df)
    assert out.count() == 51 and out.columns == ["job_id", "node_kind", "parent_key", "child_key"]
    flat = flat_table(nested_nodes(df), "evidence")
    assert flat.count() == 50 and flat.where("length(source_text) = 2000").count() == 50
    assert nested_links(df.where("false")).count() == 0
    assert rows(flat_table(nested_nodes(df), "node")) == []


def test_every_kind_has_its_flat_table(spark, data, tmp_path):
    """The flat tables hold the links of p3_found, and the tags written in one job read back to the same tables."""
    from labelloom.operators.nested import KINDS, write_tables
    from labelloom.plans.data_queries import FLAT, QUERIES
    from labelloom.session import table

    assert sorted(FLAT.values()) == sorted(KINDS)
    links = QUERIES["p3_found"](spark, data).cache()
    write_tables(nested_nodes(table(spark, data, "parse_results")), str(tmp_path / "nodes"))
    written = spark.read.parquet(str(tmp_path / "nodes"))
    for name, kind in FLAT.items():
        flat = QUERIES[name](spark, data)
        keys = ["job_id", "parent_key", "child_key"]
        got = rows(flat.select(keys).distinct())
        assert got and got == rows(links.where(links.node_kind == kind).select(keys)), kind
        assert rows(flat) == rows(flat_table(written, kind)), kind
