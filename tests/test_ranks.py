"""Ranks over ranges, the first of each key, and the plans that use them."""

import random
import re

from pyspark.sql import functions as F

from vellumlake.operators import ranks
from vellumlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_ranks(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0.5, 0.5, 1.5, r.random(), None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double")
    got = {x.id: x["rank"] for x in ranks.ranked(df, [F.desc("score"), F.col("id")], parts=7).collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert ranks.ranked(df.where("false"), [F.col("id")]).count() == 0
    assert sorted(x["rank"] for x in ranks.ranked(df.select(F.lit(1).alias("id")), [F.col("id")], parts=3).collect()) == list(range(1, 3001))


def test_first_of_each(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randrange(5)}", -r.randrange(20), f"t{r.randrange(500)}") for _ in range(4000)]
    df = spark.createDataFrame(rows, "key string, n int, text string")
    got = {x.key: [tuple(v) for v in x["first"]] for x in ranks.first_of_each(df, "key", 3, [F.col("n"), F.col("text")]).collect()}
    assert got == {k: sorted((n, t) for kk, n, t in rows if kk == k)[:3] for k in {x[0] for x in rows}}


def test_no_window_over_all_rows(spark):
    text = lambda q: QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", text("q12_property_keys"))
    assert windows and all("_salt" in w for w in windows)
    for q in ("q06_recall_hybrid", "q06_recall_reranked"):
        plan = QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in re.findall(r"Window \[.*", plan):
            # ranks within a range, or of the nearest vectors, which a limit has cut
            assert "_range" in line or "distance" in line, line
