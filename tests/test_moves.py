"""Links after moves, on random small trees: each leads where it led, and few texts change."""

import random

from pyspark.sql import functions as F

from vellumlake.operators import links, moves

NAMES = ["a.md", "b.md", "x/a.md", "y/a.md", "x/y/c.md", "z/c.md", "deep/er/d.md"]
TEXTS = ["a", "a.md", "x/a", "../a", "./a", "../x/a.md", "y/c", "c", "d", "deep/er/d", "nowhere", "er/d"]


def table(df):
    return {tuple(x) for x in df.collect()}


def test_random_moves(spark):
    r = random.Random(12)
    paths = spark.createDataFrame([(p,) for p in NAMES], "path string")
    for _ in range(4):
        old = r.sample(NAMES, 2)
        to = dict(zip(old, r.sample(["new/a.md", "q.md", "x/q.md", "y/y/c.md", "c.md"], 2), strict=True))
        refs = spark.createDataFrame([(p, t) for p in NAMES for t in r.sample(TEXTS, 5)], "source string, target string")
        moved = spark.createDataFrame(list(to.items()), "old string, new string")
        new_paths = moves.renamed(paths, "path", moved)
        written = moves.moved_links(refs, paths, moved)
        go = lambda p: to.get(p, p)
        asked = lambda df, at: {(x.source, x.target): x.path for x in links.answered(links.asked_keys(df, False), links.link_keys(at)).collect()}
        before, texts = asked(refs, paths), moves.rewrites(refs, paths, moved)
        changed = {(x.source, x.target): x.text for x in texts.collect()}
        unchanged = asked(moves.renamed(refs, "source", moved), new_paths)
        after = asked(written, new_paths)
        for (source, text), path in before.items():
            if path is None:
                assert (go(source), text) not in changed
                continue
            new = changed.get((go(source), text), text)
            assert after[(go(source), new)] == go(path)
            assert ((go(source), text) in changed) == (unchanged[(go(source), text)] != go(path))  # no text changes that need not


def test_forms(spark):
    paths = spark.createDataFrame([("a.md",), ("x/s.md",), ("x/n.md",)], "path string")
    refs = spark.createDataFrame([("x/s.md", t) for t in ("n", "n.md", "./n", "x/n", "../a")], "source string, target string")
    moved = spark.createDataFrame([("x/n.md", "y/z/m.md"), ("x/s.md", "k/s.md")], "old string, new string")
    got = {x.target: x.text for x in moves.rewrites(refs, paths, moved).collect()}
    assert got == {"n": "m", "n.md": "m.md", "./n": "../y/z/m", "x/n": "y/z/m"}
    pairs = spark.createDataFrame([("a/b/s.md", "a/c/t.md"), ("s.md", "t.md"), ("a/s.md", "t.md"), ("s.md", "a/t.md"), ("a/b/s.md", "a/b/t.md")], "s string, t string")
    assert [x.r for x in pairs.select(moves.relative(F.col("s"), F.col("t")).alias("r")).collect()] == ["../c/t.md", "./t.md", "../t.md", "./a/t.md", "./t.md"]
