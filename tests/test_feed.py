"""The change feed over all derived tables, its rebuild, and vectors that follow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumlake.sources.vault import tables as derived
from vellumlake.streaming import feed, vectorfeed
from vellumlake.streaming.tables import Tables

BODIES = ["- [ ] write 📅 2026-02-01\nsee [[b]] and [[c]]", "## Food\n- **2026-01-03**: likes tea\nsee [[a]]", "---\ntitle: T\ntags: [x]\n---\nplain words", "", None, "---\n: broken: [\n---\nalone [[a]]"]


def changes_of(r, n, version):
    return [(f"{r.choice('abcde')}.md", "delete" if r.random() < 0.3 else "upsert", version + i, float(version + i), r.choice(BODIES[:3] * 3 + BODIES)) for i in range(n)]


def shown(df, *columns):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=str)


def test_all_tables_follow(spark, tmp_path):
    r, every = random.Random(53), []
    index = feed.Index(spark, str(tmp_path), buckets=4, with_text=True)
    for i in range(3):
        batch = changes_of(r, 5, 10 * i)
        every += batch
        index.apply(spark.createDataFrame(batch, feed.CHANGE), i)
    last = feed.last_changes(spark.createDataFrame(every, feed.CHANGE)).where("op <> 'delete'")
    rows = feed.parsed(last).drop("version", "deleted")
    others = spark.createDataFrame([], "path string, mtime_ms double, bytes long")
    want = derived(rows, others)
    fresh = feed.Index(spark, f"{tmp_path}/again", buckets=2, with_text=True)
    fresh.rebuild(last.select("path", "version", "mtime_ms", "text"), 0)
    for x in (index, fresh):
        assert shown(x.notes(), "path", "title", "body") == shown(rows, "path", "title", "body")
        assert shown(x.table("tasks"), "path", "line", "due") == shown(want["tasks"], F.col("note_path"), "line", "due")
        assert shown(x.table("entries"), "path", "section", "content_hash") == shown(want["entries"], F.col("file"), "section", "content_hash")
        assert shown(x.table("chunks"), "path", "chunk_index", "content_hash") == shown(want["chunks"], "path", "chunk_index", "content_hash")
        assert shown(x.links(), "source", "target") == shown(want["links"], "source", "target")
    assert index.table("tasks").count() and index.table("entries").count() and index.links().count()
    assert shown(index.search("see plain likes", True), "path", F.round("score", 9)) == shown(fresh.search("see plain likes", True), "path", F.round("score", 9)) != []


def test_a_killed_rebuild_leaves_the_old(spark, tmp_path):
    index = feed.Index(spark, str(tmp_path), buckets=2)
    index.apply(spark.createDataFrame([("a.md", "upsert", 1, 1.0, BODIES[0])], feed.CHANGE), 0)
    before = index.tables.manifest()
    notes = spark.createDataFrame([("b.md", 2, 2.0, BODIES[1]), ("c.md", 2, 2.0, BODIES[2])], "path string, version long, mtime_ms double, text string")
    put = index.tables._put
    index.tables._put = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        index.rebuild(notes, 1)
    assert index.tables.manifest() == before and shown(index.notes(), "path") == [("a.md",)] and index.table("tasks").count() == 1
    index.tables._put = put
    index.rebuild(notes, 1)
    assert shown(index.notes(), "path") == [("b.md",), ("c.md",)] and index.table("tasks").count() == 0 and shown(index.links(), "source", "target") == [("b.md", "a")]


def test_vectors_heal(spark, tmp_path):
    text = feed.Index(spark, f"{tmp_path}/notes", buckets=2, with_text=True)
    notes = [(f"n{i}.md", "upsert", 1, 1.0, f"note number{i} about {w}") for i, w in enumerate(["tea", "bread", "tea bread", "rivers"])]
    text.apply(spark.createDataFrame(notes, feed.CHANGE), 0)
    store = Tables(spark, f"{tmp_path}/vectors", vectorfeed.KEYS, buckets=2)
    model = vectorfeed.hashing_model()

    def dies(texts):
        if any("rivers" in t for t in texts):
            raise RuntimeError("the model died")
        return model(texts)

    broken = vectorfeed.VectorFeed(store, dies)
    with pytest.raises(Exception, match="the model died"):
        broken.heal(text.table("chunks"), 0)
    # text is there, vectors are not: search falls back to text
    assert broken.vectors() is None and broken.nearest("tea", 3) is None
    found = vectorfeed.hybrid(text.search("tea"), broken.nearest("tea", 3))
    assert {r.path for r in found.collect()} == {"n0.md", "n2.md"}
    good = vectorfeed.VectorFeed(store)
    assert good.heal(text.table("chunks"), 0) == {"embedded": 4, "dropped": 0}
    assert good.heal(text.table("chunks"), 1) == {"embedded": 0, "dropped": 0}
    assert [r.path for r in good.nearest("note number3 about rivers", 1).collect()] == ["n3.md"]
    text.apply(spark.createDataFrame([("n1.md", "upsert", 2, 2.0, "note now of mountains"), ("n2.md", "delete", 2, 2.0, None)], feed.CHANGE), 1)
    assert good.heal(text.table("chunks"), 2, spark.createDataFrame([("n1.md",), ("n2.md",)], "path string")) == {"embedded": 1, "dropped": 2}
    assert shown(good.vectors(), "path", "content_hash") == shown(text.table("chunks"), "path", "content_hash")
    assert vectorfeed.hybrid(text.search("mountains"), good.nearest("mountains", 3)).first().path == "n1.md"


def test_embedding_in_batches(spark):
    sizes = []

    def model(texts):
        sizes.append(len(texts))
        return np.zeros((len(texts), 2), np.float32)

    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(40)], "id int, text string").coalesce(1)
    assert vectorfeed.embedded(rows, "text", model).count() == 40
    short = lambda texts: np.zeros((1, 2), np.float32)
    with pytest.raises(Exception, match="1 vectors for 16 texts"):
        vectorfeed.embedded(rows, "text", short).count()
    v = vectorfeed.hashing_model(8)(["a b", "", "b a"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and np.array_equal(v[0], v[2])
