"""The incremental link table against a rebuild, and tables that change together."""

import random

import pytest
from pyspark.sql import functions as F

from vellumlake.operators import links
from vellumlake.streaming.linkindex import KEYS, LinkIndex
from vellumlake.streaming.tables import Tables

NAMES = ["a", "b", "c", "x/a", "y/a", "x/b", "x/y/c", "z/x/a", "deep/er/b"]
TARGETS = ["a", "b", "c", "x/a", "../a", "y/c", "b.md", "pic.png", "pic", "../x/b", "nowhere", "A B"]


def batch(spark, r, alive):
    """Random upserts and deletes of notes with links, and of files."""
    changes, refs = {}, []
    for _ in range(r.randrange(1, 4)):
        if r.random() < 0.25:
            path, kind = r.choice(["pic.png", "x/pic.png", "y/pic.jpg"]), "file"
        else:
            path, kind = r.choice(NAMES) + ".md", "note"
        op = "delete" if r.random() < 0.35 else "upsert"
        changes[path] = (path, kind, op)
    for path, kind, op in changes.values():
        if op == "delete":
            alive.pop(path, None)
        else:
            alive[path] = (kind, {r.choice(TARGETS) for _ in range(r.randrange(4))} if kind == "note" else set())
            refs += [(path, t) for t in alive[path][1]]
    return spark.createDataFrame(list(changes.values()), "path string, kind string, op string"), spark.createDataFrame(refs, "source string, target string")


def rebuilt(spark, alive):
    refs = spark.createDataFrame([(p, t) for p, (_, ts) in alive.items() for t in ts], "source string, target string")
    paths = {k: spark.createDataFrame([(p,) for p, (kind, _) in alive.items() if kind == k], "path string") for k in ("note", "file")}
    return sorted(tuple(x) for x in links.resolved(refs, paths["note"], paths["file"]).collect())


@pytest.mark.parametrize("seed", [1])
def test_any_order_equals_a_rebuild(spark, tmp_path, seed):
    r, alive = random.Random(seed), {}
    index = LinkIndex(Tables(spark, str(tmp_path), KEYS, buckets=4))
    for i in range(5):
        index.apply(i, *batch(spark, r, alive))
        assert sorted(tuple(x) for x in index.links().collect()) == rebuilt(spark, alive)


def test_a_new_path_touches_few_buckets(spark, tmp_path):
    index = LinkIndex(Tables(spark, str(tmp_path), KEYS, buckets=64))
    n = 300
    paths = spark.range(n).select(F.format_string("n/%d.md", "id").alias("path"), F.lit("note").alias("kind"), F.lit("upsert").alias("op"))
    refs = spark.range(n).select(F.format_string("n/%d.md", "id").alias("source"), F.format_string("later %d", "id").alias("target"))
    assert index.apply(0, paths, refs)["refs"] > 60
    new = spark.createDataFrame([("q/later 7.md", "note", "upsert")], "path string, kind string, op string")
    none = refs.where("false")
    wrote = index.apply(1, new, none)
    assert wrote == {"paths": 1, "ends": 3, "refs": 1}  # its path, its three keys, the one link that waited
    assert index.links().where("source = 'n/7.md'").first().target == "q/later 7.md"
    assert index.apply(1, new, none) == {}
    assert index.apply(2, new, none) == {}  # nothing that was not there
    assert index.apply(3, new.withColumn("op", F.lit("delete")), none)["refs"] == 1
    assert index.links().where("source = 'n/7.md'").first().target == "later 7"


def test_a_commit_that_dies_leaves_all_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), {"a": "k", "b": "k"}, buckets=2)
    rows = lambda v: spark.range(10).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    tables.commit(0, {"a": (rows(1), None), "b": (rows(1), None)}, {"n": 10})

    class Killed(Exception):
        pass

    def dies(*_):
        raise Killed

    broken = Tables(spark, str(tmp_path), tables.keys, buckets=2)
    broken._put = dies
    with pytest.raises(Killed):
        broken.commit(1, {"a": (rows(2), None), "b": (rows(2), None)})
    assert [tables.read(t).agg(F.sum("v")).first()[0] for t in ("a", "b")] == [10, 10] and not tables.has(1)
    tables.commit(1, {"a": (rows(3), None)})
    assert [tables.read(t).agg(F.sum("v")).first()[0] for t in ("a", "b")] == [30, 10] and tables.manifest()["numbers"] == {"n": 10}
    tables.commit(2, {"a": (rows(4).where("false"), tables.touched("a", rows(4).where("k = 3")))})
    assert tables.read("a").where("k = 3").count() == 0 and tables.read("b").count() == 10
    assert len(tables._names("manifest")) == 2 and len(tables._names("data")) <= 4  # no orphan of the killed commit


def test_two_writers(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), {"a": "k"}, buckets=2)
    rows = spark.range(4).withColumnRenamed("id", "k")
    late = Tables(spark, str(tmp_path), {"a": "k"}, buckets=2)
    was = late._manifests()
    tables.commit(0, {"a": (rows, None)})
    late._manifests = lambda: was
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit(0, {"a": (rows.where("k < 2"), None)})
    assert tables.read("a").count() == 4


def test_buckets_follow_size(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), {"a": "k"}, buckets=2, bucket_bytes=2000)
    tables.commit(0, {"a": (spark.range(3000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), None)})
    n = tables.manifest()["tables"]["a"]["buckets"]
    assert n > 2 and tables.read("a").count() == 3000
    at = tables.touched("a", spark.createDataFrame([(5,)], "k long"))
    assert tables.read("a", at).where("k = 5").count() == 1 and tables.read("a", at).count() < 3000
