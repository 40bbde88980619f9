import numpy as np

from labelloom.operators import vectors
from tests.conftest import rows


def test_top1_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = {n: rng.normal(size=8).round(1).tolist() for n in range(120)}
    data[7] = data[3]  # a tie
    df = spark.createDataFrame([(n, v, "x") for n, v in data.items()] + [(None, data[0], "x"), (900, None, "x"), (901, [1.0], "x"), (902, [], "x")], "vec_id long, e array<double>, s string")
    got = dict(rows(vectors.top1(df.repartition(5), "vec_id", "e", df.where("vec_id % 10 = 0"))))
    want = {q: max((round(float(np.dot(data[q], v)), 9), -n) for n, v in data.items() if n != q)[1] * -1 for q in data if q % 10 == 0}
    assert got == want
    assert vectors.top1(df, "vec_id", "e", df.where("false")).count() == 0
