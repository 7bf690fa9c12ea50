import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from vellumlake.functions import markdown as M
from vellumlake.functions import predicates as P
from vellumlake.functions import ranking
from vellumlake.operators import edits, fulltext, links, metadata, vectors


def column(spark, values, schema, c):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(c).collect()]


def test_folder_and_tags(spark):
    assert column(spark, ["a/B/c.md", "A/b/d/e.md", "ab/x.md"], "p string", P.in_folder(F.col("p"), "A/b/")) == [True, True, False]
    assert column(spark, ["a/B/c.md", "A/b/d/e.md"], "p string", P.in_folder(F.col("p"), "A/b", recursive=False)) == [True, False]
    assert column(spark, [["Q/x"], ["q"], ["Q"], []], "t array<string>", P.has_tag(F.col("t"), "q")) == [True, True, False, False]


def test_properties(spark):
    v = F.parse_json("j")
    rows = ['{"a.b": 1, "x": true}', '{"x": ["t", 2, true]}', '{"x": "true"}', "{}"]
    assert column(spark, rows, "j string", P.property_has(v, "x", "1")) == [True, True, False, False]
    assert column(spark, rows, "j string", P.property_has(v, "x", "true")) == [False, False, True, False]
    assert column(spark, rows, "j string", P.property_equals(v, "a.b", 1)) == [True, False, False, False]
    assert column(spark, rows, "j string", P.property_equals(v, "x", True)) == [True, False, False, False]


def test_days(spark):
    assert column(spark, ["2024-01-01", None, "2024-02-01"], "d string", P.day_bounds(F.col("d"), {"before": "2024-02-01"})) == [True, None, False]
    with pytest.raises(ValueError):
        P.calendar_day("2024-02-30")
    assert P.statuses(["not_done", "todo"]) == ["todo", "in_progress"]
    assert column(spark, ["a/.b/c", "a/b"], "p string", P.visible(F.col("p"))) == [False, True]


def test_ranking(spark):
    assert column(spark, [0.066391, 12346.0, 0.0, -0.0012345], "x double", ranking.significant(F.col("x"))) == [0.06639, 12350.0, 0.0, -0.001235]
    got = column(spark, [1, 2, 3, 4], "r int", ranking.reciprocal_rank(F.col("r")))
    assert got == pytest.approx([1 / 61 + 0.05, 1 / 62 + 0.02, 1 / 63 + 0.02, 1 / 64])
    rows = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.5, 0.9), (3, 0.1, 0.5)], "id int, f double, r double")
    assert {r.id: r.score for r in vectors.reranked(rows, "f", "r", "id").collect()} == pytest.approx({1: 0.75, 2: 0.625, 3: 0.125})


def test_query_parts():
    assert fulltext.parse_query('plain "two words" blue-green AND (x)') == [["two", "words"], ["blue", "green"], ["plain"], ["x"]]
    assert fulltext.parse_query("what about the idiot", any_term=True) == [["idiot"]]
    assert fulltext.parse_query("*** ") == []


def test_bm25_matches_sqlite(spark):
    docs = ["alpha beta gamma", "beta beta delta", "alpha", "gamma delta alpha beta", "nothing here at all", "x y z", "p q r s"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(c, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("insert into t(rowid, c) values (?, ?)", enumerate(docs))
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, c string")
    for raw, match in (("alpha beta", "alpha beta"), ('"alpha beta"', '"alpha beta"')):
        want = {i: -s for i, s in con.execute("select rowid, rank from t where t match ?", (match,))}
        got = {r.id: r.score for r in fulltext.bm25(rows, F.col("c"), fulltext.parse_query(raw)).collect()}
        assert got == pytest.approx(want)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [0.0, 1.0])], "id int, note string, v array<float>")
    hits = vectors.nearest(rows, "v", [1.0, 0.0], 3, ("id",))
    assert [r.id for r in hits.collect()] == [1, 2, 3]
    assert {r.id for r in vectors.best_of_each(hits, "note", ("id",)).collect()} == {1, 3}
    kept = vectors.within_margin(spark.createDataFrame([(1, 0.1, False), (2, 0.3, False), (3, 0.9, True)], "id int, d double, l boolean"), "d", "l")
    assert {r.id for r in kept.collect()} == {1, 3}
    kept = vectors.adaptive_floor(spark.createDataFrame([(1, 0.3, False), (2, 0.02, False), (3, 0.0, True)], "id int, p double, l boolean"), "p", "l")
    assert {r.id for r in kept.collect()} == {1, 3}


def test_links(spark):
    paths = spark.createDataFrame([("a/b/c.md",), ("x/c.md",), ("d.md",), ("a/x.y.md",)], "path string")
    refs = spark.createDataFrame([("d.md", "c"), ("d.md", "b/c"), ("d.md", "d"), ("d.md", "gone"), ("d.md", "x.y")], "source string, target string")
    got = {r.target for r in links.resolved(refs, paths).collect()}
    assert got == {"x/c.md", "a/b/c.md", "d.md", "gone", "a/x.y.md"}


def test_task_sort_and_reconcile(spark):
    t = spark.createDataFrame([("n", 1, "todo", None, "2024-01-02", None, 1.0), ("n", 2, "done", "high", None, None, 1.0), ("n", 3, "todo", None, "2024-01-01", None, 1.0), ("m", 4, "todo", None, None, "2024-01-05", 2.0), ("o", 5, "todo", "lowest", None, None, 3.0)], "note_path string, line int, status string, priority string, due string, start string, mtime_ms double")
    t = t.withColumns({c: F.lit(None).cast("string") for c in ("scheduled", "created", "done", "cancelled", "heading")}).withColumn("tags", F.array().cast("array<string>"))
    by = lambda *a: [r.line for r in metadata.task_list(t, status=["all"], sort_by=a[0], direction=a[1] if len(a) > 1 else None)[1].collect()]
    total, page = metadata.task_list(t, status=["all"])
    assert total.first()[0] == 5 and [r.line for r in page.collect()] == [3, 1, 4, 5, 2]
    assert by("start") == [4, 3, 1, 5, 2] and by("due", "desc") == [1, 3, 4, 5, 2] and by("priority") == [2, 4, 1, 3, 5]
    assert by("note_mtime") == [5, 4, 1, 2, 3] and by("position", "desc") == [5, 3, 2, 1, 4]
    old = spark.createDataFrame([("f", "h", 0), ("f", "h", 1), ("f", "k", 2)], "file string, hash string, entry_index int")
    new = spark.createDataFrame([("f", "h", 0), ("f", "m", 1)], "file string, hash string, entry_index int")
    assert sorted((r.hash, r.action) for r in metadata.reconciled(old, new).collect()) == [("h", "delete"), ("h", "keep"), ("k", "delete"), ("m", "insert")]


def test_frontmatter():
    props, body = M.frontmatter("---\ntitle: A\ntags: [x, 'y z']\ndate: 2024-01-02\nok: yes\nlist:\n- a\n- b\nm:\n  k: 1\n---\nbody")
    assert props == {"title": "A", "tags": ["x", "y z"], "date": "2024-01-02", "ok": "yes", "list": ["a", "b"], "m": {"k": 1}} and body == "body"
    assert M.frontmatter("no\n---\n") == ({}, "no\n---\n")
    assert M.frontmatter("---\n- a\n---\nx")[0] == {}
    assert M.merged({"a": 1, "b": 2}, {"a": None, "c": 3}) == {"b": 2, "c": 3}


def test_headings_and_code():
    text = "# A\nx\n```\n# no\n```\n%%\n# no\n%%\n## B #\ny\nC\n---\nz"
    assert [(h["level"], h["text"]) for h in M.headings(M.lines_of(text))] == [(1, "A"), (2, "B"), (2, "C")]
    assert M.leading_callout("# T\n> [!Info] Hi\n> body\nx") == {"type": "info", "title": "Hi", "body": "body"}
    assert M.plain_text("## H\n[[a|b]] **c** [d](e)") == "H\nb c d"


def test_tasks():
    t = M.task("  - [/] do #a/b it 🔁 every week ⏫ 📅 2024-01-02 🛫 2024-02-30 #z ^id-1")
    assert (t["status"], t["priority"], t["due"], t["start"], t["recurrence"], t["block_id"], t["tags"]) == ("in_progress", "high", "2024-01-02", None, "every week", "id-1", ["a/b", "z"])
    t = M.task("1. [X] x [due:: 2024-01-02] (dependsOn:: a, b)")
    assert (t["status"], t["due"], t["depends_on"], t["description"]) == ("done", "2024-01-02", ["a", "b"], "x")
    assert M.task("- no task") is None
    assert [(x["line"], x["heading"]) for x in M.tasks("- [ ] a\n# H\n```\n- [ ] no\n```\n- [ ] b")] == [(1, None), (6, "H")]
    assert M.done_lanes("## L\n\n**Complete**\n- [x] a\n## M\n- [ ] b") == ["L"]


def test_entries_chunks_canvas():
    e = M.memory_entries("## S\n- **2024-01-01**: a\n  more\n\n- **2023-01-01**: b\n### sub\nx")
    assert [(x["date"], x["text"]) for x in e] == [("2024-01-01", "- **2024-01-01**: a\n  more"), ("2023-01-01", "- **2023-01-01**: b")]
    assert len(M.chunks("t", "w " * 499)) == 1 and len(M.chunks("t", "w " * 500)) == 2
    assert M.canvas_text('{"nodes":[{"id":"g","type":"group","label":"G","x":0,"y":0,"width":9,"height":9},{"id":"a","text":"in","x":1,"y":1,"width":1,"height":1},{"id":"b","text":"first","x":0,"y":-5,"width":1,"height":1}],"edges":[{"fromNode":"a","toNode":"b","label":"l"}]}') == "first\n\nG\n\nin\n\nin -> first: l"
    assert M.cut_bytes("aé", 2) == "a"
    assert M.java_pattern("YYYY-MM-DD [o'clock] dddd") == "yyyy-MM-dd 'o''clock' EEEE"
    with pytest.raises(ValueError):
        M.java_pattern("YYYY wo")


def test_link_targets():
    assert M.link_targets("[[A#h|b]] [x](y%20z.md#h) `[[no]]` [e](https://x.y) ![[i.png]]\n```\n[[no]]\n```") == ["A", "y z.md", "i.png"]
    assert M.property_links({"a": ["[[B|c]]"], "d": "[[E]]"}) == ["B", "E"]


def test_edits(spark):
    text = "# A\n\n## B\nx\n\n## C\ny"
    assert edits.patch(text, "B", "z") == "# A\n\n## B\nx\nz\n\n## C\ny"
    assert edits.patch(text, "B", "z", "replace") == "# A\n\n## B\nz\n\n## C\ny"
    with pytest.raises(ValueError):
        edits.patch("## B\n## B", "B", "z")
    assert edits.replace("a\n\nb\n\nc", "b", "") == "a\n\nc"
    assert edits.delete_span("1 <a> 2 <b> 3", "<a>", "<b>") == "1  3"
    assert edits.update_task("- [ ] a ^x", 1, "done", "2024-01-01") == "- [x] a ✅ 2024-01-01 ^x"
    once = edits.add_entry("## S\n- **2023-01-01**: b", "S", "2024-01-01", "a")
    assert once == "## S\n- **2024-01-01**: a\n- **2023-01-01**: b" and edits.add_entry(once, "S", "2024-01-01", "a") == once
    assert edits.relinked("[[a|x]] [t](a%20b.md#h) `c`", {"a": "d/a", "a b.md": "e.md"}) == "[[d/a|x]] [t](e.md#h) `c`"
    with pytest.raises(ValueError):
        edits.safe_path("../x")
    out = edits.apply_edit(spark.createDataFrame([("## B\nx",), ("none",)], "content string"), lambda t: edits.patch(t, "B", "z")).collect()
    assert out[0].content == "## B\nx\nz" and out[1].error
    assert not math.isnan(0.0)
