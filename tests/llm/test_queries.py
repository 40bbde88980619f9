from labelloom.llm import queries


def test_all_run(spark, data):
    counts = {name: q(spark, data).count() for name, q in queries.QUERIES.items()}
    assert all(n > 0 for n in counts.values()), counts


def test_columns(spark, data):
    want = {"p1_found": ["rec_a", "rec_b"], "p4_found": ["rec_id", "catalog_id"], "p5_found": ["rec_id", "noise_kind"], "p7_found": ["rec_a", "rec_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).columns == columns
