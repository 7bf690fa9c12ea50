import pytest
from pyspark.sql import functions as F

from vellumlake.sources import vault as V
from vellumlake.streaming import feed

NOTES = {
    "Projects/alpha.md": "---\ntitle: Alpha\ntags: [project, work/x]\nrelated: ['[[beta]]']\ncreated: 2026-01-01T10:00:00+01:00\nstatus: active\n---\n# Alpha\n- [ ] write 📅 2026-02-01\n- [x] read ✅ 2026-01-02\nsee [[beta]] and [[Nowhere]]\n",
    "Projects/beta.md": "---\ntype: project\n---\nback to [a](alpha.md)\n",
    "About Me/Prefs.md": "## Food\n- **2026-01-03**: likes tea\n- **2026-01-01**: likes bread\n",
    "Orphan Note.md": "---\n: broken: [\n---\nalone",
    ".hidden/x.md": "no",
}


@pytest.fixture
def root(tmp_path):
    for path, text in NOTES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "data.txt").write_text("plain text")
    (tmp_path / "b.canvas").write_text('{"nodes":[{"id":"1","text":"hello","x":0,"y":0}]}')
    return str(tmp_path)


def test_vault(spark, root):
    t = V.vault(spark, root)
    notes = {r.path: r for r in t["notes"].select("path", "title", "tags", "folder", "created", "related").collect()}
    assert set(notes) == set(NOTES) - {".hidden/x.md"}
    assert notes["Projects/alpha.md"].title == "Alpha" and notes["Projects/alpha.md"].tags == ["project", "work/x"] and notes["Projects/alpha.md"].created == "2026-01-01T10:00:00+01:00"
    assert notes["Orphan Note.md"].folder == "" and notes["Orphan Note.md"].title == "Orphan Note"
    assert sorted((r.line, r.status, r.due) for r in t["tasks"].collect()) == [(9, "todo", "2026-02-01"), (10, "done", None)]
    assert [r.entry_date for r in t["entries"].orderBy("entry_index").collect()] == ["2026-01-03", "2026-01-01"]
    assert {(r.source, r.target) for r in t["links"].collect()} == {("Projects/alpha.md", "Projects/beta.md"), ("Projects/alpha.md", "Nowhere"), ("Projects/beta.md", "Projects/alpha.md")}
    assert {r.path for r in t["files"].collect()} == {"data.txt", "b.canvas"}
    assert {r.path: r.content for r in V.text_files(spark, root).collect()} == {"data.txt": "plain text", "b.canvas": "hello"}
    assert t["errors"].count() == 0 and t["chunks"].count() == 4


def test_stream_equals_rebuild(spark, tmp_path):
    changes = [("a.md", "upsert", 1, 1.0, "one"), ("b.md", "upsert", 2, 2.0, "two"), ("a.md", "upsert", 5, 5.0, "# three"), ("b.md", "delete", 6, 6.0, None), ("c.md", "upsert", 7, 7.0, "four"), ("a.md", "upsert", 3, 3.0, "late")]
    source = tmp_path / "changes"
    for i in range(0, 6, 2):
        spark.createDataFrame(changes[i : i + 2], feed.CHANGE).coalesce(1).write.mode("append").parquet(str(source))
    index = feed.Index(spark, str(tmp_path / "index"))
    assert index.state() is None
    stream = spark.readStream.schema(feed.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(source))
    index.follow(stream, str(tmp_path / "cp")).awaitTermination()
    rebuilt = feed.last_changes(spark.createDataFrame(changes, feed.CHANGE)).where("op <> 'delete'")
    assert {(r.path, r.content) for r in index.notes().select("path", F.col("body").alias("content")).collect()} == {(r.path, r.text) for r in rebuilt.collect()} == {("a.md", "# three"), ("c.md", "four")}
    index.apply(spark.createDataFrame(changes[:1], feed.CHANGE), 0)  # a batch that runs again
    assert index.state().count() == 3


def test_manifest(spark):
    had = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "path string, mtime_ms double")
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 1.0)], "path string, mtime_ms double")
    assert {(r.path, r.op) for r in feed.manifest_changes(had, now).collect()} == {("b", "upsert"), ("c", "delete"), ("d", "upsert")}
    assert [r.path for r in feed.settled_changes(now, 1001.5, 1000.0).orderBy("path").collect()] == ["a", "d"]


def test_notes_are_parsed_in_bounded_frames(spark):
    import pandas as pd

    from vellumlake.sources.store import BATCH_BYTES, BATCH_ROWS, small_batches

    texts = ["# a\n" + "x" * 300_000, None, "", "y" * 2_500_000, *["z" * 400_000] * 9]
    frames = list(V.parse_batches(iter([(pd.Series([f"{i}.md" for i in range(len(texts))]), pd.Series(texts)), (pd.Series([], dtype=str), pd.Series([], dtype=str))])))
    assert max(sum(len(x or "") for x in f["body"][:-1]) for f in frames if len(f)) < V.PARSED_CHARS
    assert [x for f in frames for x in f["body"].where(f["body"].notna(), None)] == texts and len(frames) > 4
    small_batches(spark)
    sizes = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 20000) as t").mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= min(BATCH_ROWS, 2 * BATCH_BYTES // 20000) and sum(r.n for r in sizes) == 5000
