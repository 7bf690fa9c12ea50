"""The segmented text index against a fresh build."""

import random

from pyspark.sql import functions as F

from vellumlake.operators import textindex
from vellumlake.streaming import textfeed
from vellumlake.streaming.tables import Tables

WORDS = "hands resting rest Hand city cities runs running the of a licence under 漢字 éa".split()


def test_segments_equal_a_fresh_build(spark, tmp_path):
    r, alive = random.Random(4), {}
    index = textfeed.TextIndex(Tables(spark, f"{tmp_path}/index", textfeed.KEYS, buckets=4))
    for i in range(6):
        up = {f"n{r.randrange(12)}.md": None if r.random() < 0.1 else " ".join(r.choice(WORDS) for _ in range(r.randrange(40))) for _ in range(4)}
        gone = {f"n{r.randrange(12)}.md" for _ in range(2)} - set(up)
        alive = {k: v for k, v in (alive | up).items() if k not in gone}
        notes = spark.createDataFrame(list(up.items()), "path string, text string")
        index.apply(i, notes, spark.createDataFrame([(g,) for g in gone], "path string"))
    state = index.tables.manifest()["numbers"]
    assert state["n"] == len(alive) and any(s["name"].endswith("m") for s in state["segments"]) and len(state["segments"]) < 6
    built = f"{tmp_path}/built"
    textindex.build(spark.createDataFrame(list(alive.items()), "path string, text string"), F.coalesce("text", F.lit("")), built)
    for query, any_term in (("hands resting", False), ("cities running", True), ('"under rest"', False), ("", False)):
        rows = lambda df: sorted((x.path, round(x.score, 9)) for x in df.collect())
        assert rows(index.search(query, any_term)) == rows(textindex.search(spark, built, query, any_term=any_term)), query
    index.apply(5, notes, notes.select("path"))  # a batch that runs again
    assert index.tables.manifest()["numbers"]["n"] == len(alive)


def test_an_edit_touches_no_segment(spark, tmp_path):
    index = textfeed.TextIndex(Tables(spark, str(tmp_path), textfeed.KEYS, buckets=8))
    none = spark.createDataFrame([], "path string")
    index.apply(0, spark.range(200).select(F.format_string("n%d.md", "id").alias("path"), F.lit("some words of a note").alias("text")), none)
    parts = index.tables.manifest()["tables"]["terms@000000000000"]["parts"]
    index.apply(1, spark.createDataFrame([("n7.md", "other")], "path string, text string"), spark.createDataFrame([("n8.md",)], "path string"))
    after = index.tables.manifest()
    assert after["tables"]["terms@000000000000"]["parts"] == parts and after["numbers"]["n"] == 199 and after["numbers"]["words"] == 198 * 5 + 1
    assert index.search("words").count() == 198 and [x.path for x in index.search("other").collect()] == ["n7.md"]


def test_a_segment_is_written_without_a_sort(spark, tmp_path):
    from vellumlake.streaming.tables import Tables

    t = Tables(spark, str(tmp_path / "t"), {"terms": "term"})
    rows = spark.range(5000).selectExpr("cast(id % 700 as string) as term", "id")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    sorted_, was = [], type(rows).sortWithinPartitions
    type(rows).sortWithinPartitions = lambda self, *a: sorted_.append(a) or was(self, *a)
    try:
        made = t.ahead("terms@1", rows)
    finally:
        type(rows).sortWithinPartitions = was
    assert not sorted_ and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert sorted(map(tuple, t.rows(made).select("term", "id").collect())) == sorted(map(tuple, rows.collect()))
