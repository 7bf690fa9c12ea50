"""The inverted file against all distances."""

import numpy as np
from pyspark.sql import functions as F

from vellumlake.operators import vectorindex, vectors


def test_lists(spark, tmp_path):
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 8)) * 6
    points = [(i, [float(v) for v in centers[i % 12] + r.normal(size=8)], "x") for i in range(1200)] + [(5000, None, "x"), (5001, [float(v) for v in centers[0]], "x"), (5002, [float(v) for v in centers[0]], "x")]
    rows = spark.createDataFrame(points, "id long, v array<float>, list_ string")
    vectorindex.build(rows, "v", str(tmp_path), lists=12)
    asked = [p[1] for p in points if p[0] % 20 == 0 and p[1]]
    opened, missed, total = [], 0, 0
    for q in asked[:12]:
        want = [tuple(x) for x in vectors.nearest(rows.where("v is not null"), "v", q, 10, ("id",)).select("id", "distance").collect()]
        found, n = vectorindex.search(spark, str(tmp_path), "v", q, 10, ("id",))
        assert [tuple(x) for x in found.select("id", "distance").collect()] == want
        opened.append(n)
        near, n = vectorindex.search(spark, str(tmp_path), "v", q, 10, ("id",), probe=2)
        assert n == 2
        missed += len({x.id for x in near.select("id").collect()} ^ {i for i, _ in want}) // 2
        total += len(want)
    assert np.mean(opened) < 9 and missed <= 0.1 * total  # recall of two lists at least 0.9
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 1202


def test_few_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, v array<float>")
    vectorindex.build(rows, "v", f"{tmp_path}/few")
    found, _ = vectorindex.search(spark, f"{tmp_path}/few", "v", [0.0, 0.0], 5, ("id",))
    assert [x.id for x in found.collect()] == [1, 2]
    vectorindex.build(rows.where("id > 5"), "v", f"{tmp_path}/none")
    assert vectorindex.search(spark, f"{tmp_path}/none", "v", [0.0, 0.0], 5, ("id",))[0].count() == 0
