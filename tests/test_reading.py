"""Query terms, stems, the stored index, links to files, outlines, sections, windows, section names."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from vellumlake.functions import markdown as M
from vellumlake.functions.stems import marks, stem
from vellumlake.operators import fulltext, links, metadata, reading, textindex
from vellumlake.sources import vault as V


@pytest.mark.parametrize(
    ("raw", "parts"),
    [
        ("example.org", [["example", "org"]]),
        ("example.org mail inbox", [["example", "org"], ["mail"], ["inbox"]]),
        ("a/b someone@host.example x,y don't", [["a", "b"], ["someone", "host", "example"], ["x", "y"], ["don", "t"]]),
        ("end. really?!", [["end"], ["really"]]),
        ("?!.,", []),
        ("blue-green: search", [["blue", "green"], ["search"]]),
        ('one "two-three (x)" four.five-six AND six', [["two", "three", "x"], ["four", "five", "six"], ["one"], ["six"]]),
        ("snake_case café", [["snake", "case"], ["café"]]),
        ('""a" b', [["a"], ["b"]]),
        ('open "quote', [["open"], ["quote"]]),
    ],
)
def test_query_terms(raw, parts):
    assert fulltext.parse_query(raw) == parts


def test_stems_match_sqlite():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(c, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    r = random.Random(3)
    ends = ["", "s", "es", "ed", "ing", "ation", "ational", "izer", "ness", "fulness", "y", "ies", "ement", "ible", "al", "ll", "e", "eed", "logi", "ion"]
    words = ["".join(r.choice("abdeilnorstuyz") for _ in range(r.randint(1, 7))) + r.choice(ends) for _ in range(4000)] + ["caresses", "ponies", "relational", "hopping", "falling", "sky", "übung", "ñandú"]
    con.executemany("insert into t(rowid, c) values (?, ?)", enumerate(words))
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    plain = str.maketrans(*marks())
    assert {d: t for d, t in con.execute("select doc, term from v")} == {i: stem(w.translate(plain)) for i, w in enumerate(words)}


def test_stored_index_matches_sqlite(spark, tmp_path):
    r = random.Random(5)
    vocabulary = ["connect", "connected", "connection", "run", "running", "sail", "café", "cafe", "tree", "stone"]
    docs = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))) for _ in range(60)] + ["", "zebra zebra"]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(1000, None)], "path long, text string")
    textindex.build(notes, F.col("text"), str(tmp_path / "index"), buckets=8)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(c, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, c) values (?, ?)", [*enumerate(docs), (1000, "")])
    for query, match in (("connecting", "connecting"), ("Cafés zebra", '"Cafés" zebra'), ('"connection runs"', '"connection runs"'), ("zebras", "zebras"), ("nothing", "nothing")):
        got = {r[0]: r[1] for r in textindex.search(spark, str(tmp_path / "index"), query).collect()}
        want = dict(con.execute("select rowid, -bm25(t) from t where t match ?", (match,)))
        assert got == pytest.approx(want)
    assert textindex.search(spark, str(tmp_path / "index"), "?!").count() == 0


def test_links_by_all_rules(spark):
    notes = spark.createDataFrame([("a/x.md",), ("b/x.md",), ("a/deep/y.md",), ("y.md",), ("b/pic.md",)], "path string")
    files = spark.createDataFrame([("a/pic.png",), ("b/pic.png",), ("a/pic.png.canvas",), ("maps/Trip Route.canvas",), ("a/deep/z.csv",)], "path string")
    asked = [("a/n.md", "x"), ("b/n.md", "x"), ("c/n.md", "x"), ("a/n.md", "../b/x"), ("c/n.md", "y"), ("a/deep/n.md", "y"), ("b/n.md", "pic.png"), ("c/n.md", "pic.png"), ("c/n.md", "Trip Route"), ("a/n.md", "deep/z.csv"), ("c/n.md", "deep/z"), ("c/n.md", "pic"), ("c/n.md", "../../x"), ("c/n.md", "none.png"), ("c/n.md", "none.png")]
    got = links.resolved(spark.createDataFrame(asked, "source string, target string"), notes, files)
    want = [("a/n.md", "a/x.md"), ("b/n.md", "b/x.md"), ("c/n.md", "a/x.md"), ("a/n.md", "b/x.md"), ("c/n.md", "y.md"), ("a/deep/n.md", "y.md"), ("b/n.md", "b/pic.png"), ("c/n.md", "a/pic.png"), ("c/n.md", "maps/Trip Route.canvas"), ("a/n.md", "a/deep/z.csv"), ("c/n.md", "a/deep/z.csv"), ("c/n.md", "b/pic.md"), ("c/n.md", "../../x"), ("c/n.md", "none.png")]
    assert {(r.source, r.target) for r in got.collect()} == set(want)


def test_plain_text():
    text = "# Head #1\n> [!info] Note\n> quoted *really* __bold__\n[[a|shown]] [[b]] [text](url) [x] %%gone\nstill%% ***both*** end %% open\nTitle\n===\n    # code"
    assert M.plain_text(text) == "Head #1\nNote\nquoted really bold\nshown b text [x]  both end %% open\nTitle\n\n    # code"


def test_outline_sections_and_leading(spark):
    text = "---\ntitle: t\n---\n\n> [!info] State\n> on\n\nintro\n\n# One\na\n## Two\nbé\n```\n# no\n```\n# Three\n## Two\n"
    rows = V.note_rows(spark.createDataFrame([("n.md", 0.0, 1, text), ("e.md", 0.0, 0, "")], "path string, mtime_ms double, bytes long, text string"))
    got = [(r.level, r.text, r.bytes) for r in reading.outline(rows).orderBy("place").collect()]
    assert got[:2] == [(1, "One", len("# One\na\n## Two\nbé\n```\n# no\n```".encode())), (2, "Two", len("## Two\nbé\n```\n# no\n```".encode()))] and [x[1] for x in got] == ["One", "Two", "Three", "Two"]
    assert {r.path: r.content for r in reading.leading(rows).collect()} == {"n.md": "intro", "e.md": ""}
    one = lambda *a: {r.path: (r.text, r.error) for r in reading.sections(rows, *a).collect()}
    assert one("One")["n.md"][0].startswith("# One\na\n## Two") and one("One")["e.md"] == (None, "heading not found")
    assert one("Two")["n.md"] == (None, "2 headings of that text") and one("Two", 1)["n.md"][1] == "heading not found"


def test_line_windows(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\nc\n"), (2, "a"), (3, ""), (4, None), (5, "a\n\n")], "id int, text string")
    got = {r.id: (r.window, r.start_line, r.end_line, r.total_lines, r.error is not None) for r in reading.line_window(rows, "text", 2, 1).collect()}
    assert got[1] == ("b", 2, 2, 3, False) and got[2][3:] == (1, True) and got[3][3:] == (0, False) and got[4] == got[3] and got[5][:4] == ("", 2, 2, 2)
    with pytest.raises(ValueError):
        reading.line_window(rows, "text", 0)


def test_files_and_globs(spark):
    files = spark.createDataFrame([(p, 1) for p in ("a/x.md", "a/b/y.md", "z.md", ".h/x.md", "a/i.PNG", "a/none", "b/.k.csv", "b/k.tar.gz")], "path string, bytes long")
    notes = lambda **k: [r.path for r in reading.list_notes(files, **k).collect()]
    assert notes() == ["a/b/y.md", "a/x.md", "z.md"] and notes(folder="a/") == ["a/b/y.md", "a/x.md"]
    assert notes(glob="**/*.md") == ["a/b/y.md", "a/x.md", "z.md"] and notes(glob="a/*.md") == ["a/x.md"] and notes(glob="{z,a/?}.md") == ["a/x.md", "z.md"]
    page, counts = reading.list_files(files, limit=2)
    assert [(r.path, r.extension) for r in page.collect()] == [("a/i.PNG", ".png"), ("a/none", "(none)")]
    assert {r.extension: r.n for r in counts.collect()} == {".png": 1, "(none)": 1, ".gz": 1}


def test_section_names(spark):
    cases = [("Goals", "goals (newest first)", True), ("R&D plans", "R&amp;D plans", True), ("&#65;bc", "abc", True), ("x &amp;lt; y", "x < y", False), ("x &amp;lt; y", "x &AMP;lt; y", True), ("2025", "2026", False), ("Log 2025 items", "Log 2026 items", False), ("A", "B", False), ("Work", "Wrok", False), ("Work", "Works", True), ("Preferences", "Preferenecs", True), ("Preferences", "Projects", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    got = rows.select("a", "b", "want", reading.is_near(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got] == [(r.a, r.b, r.want) for r in got]
    r = spark.createDataFrame([("  Hello, World! ", "a</data >b", 'q"&')], "a string, b string, c string").select(reading.kebab(F.col("a")).alias("k"), reading.wrapped(F.col("b"), "data", {"of": F.col("c")}).alias("w"), reading.capped(F.col("b"), 3, "read").alias("c")).first()
    assert (r.k, r.w, r.c) == ("hello-world", '<data of="q&quot;&amp;">\na<&#x2F;data>b\n</data>', "a</\n\n…(truncated at 3 characters — use read for the full content)")


def test_property_keys_count_notes_once(spark):
    notes = spark.createDataFrame([("a", '{"k": ["x", "x", "y"], "n": 1}'), ("b", '{"k": "x", "e": []}'), ("c", '{"k": null}')], "path string, p string").select("path", F.parse_json("p").alias("properties"))
    got = {r.key: (r.n_notes, list(r.samples)) for r in metadata.property_keys(notes).collect()}
    assert got == {"k": (3, ["x", "y"]), "n": (1, ["1"]), "e": (1, [])}


def test_near_counts_make_forms_after_distinct_names(spark):
    df = spark.createDataFrame([("Hot  Gear",), ("hot gaer",), (None,), ("",), ("cold gear 1",), ("R&amp;D notes",)], "section string").crossJoin(spark.range(50)).select("section")
    out = reading.near_counts(df, ["hot gear", "HOT GEAR (newest first)", "r&d notes", "cold gear 2"])
    assert sorted(map(tuple, out.collect())) == [("Hot  Gear", 2), ("R&amp;D notes", 1), ("hot gaer", 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") : plan.index("LogicalRDD")]
    assert "regexp" not in below and "levenshtein" not in below and "regexp" in plan


def test_an_index_takes_words_of_any_length_and_keeps_lengths(spark, tmp_path):
    # as an array of fixed width the words would take 4 bytes x 2,000,000 x 5,000
    texts = [("a", "y" * 2_000_000 + " " + " ".join(f"w{i}" for i in range(5000))), ("b", None), ("c", "")]
    notes = spark.createDataFrame(texts, "path string, t string")
    textindex.build(notes, F.col("t"), str(tmp_path / "i"), buckets=2)
    lengths = spark.read.parquet(str(tmp_path / "i/postings")).where("term = ''")
    assert sorted((r.path, r.dl) for r in lengths.collect()) == [("a", 5001), ("b", 0), ("c", 0)]
    corpus = spark.read.parquet(str(tmp_path / "i/corpus")).first()
    assert (corpus["n"], corpus["average"]) == (3, 5001 / 3)
    assert [r.path for r in textindex.search(spark, str(tmp_path / "i"), "w77").collect()] == ["a"]
