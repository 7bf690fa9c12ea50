"""The best stretch of a text, against all stretches."""

import random

from pyspark.sql import functions as F

from vellumlake.operators import fulltext


def brute(words, asked, n):
    best = None
    for a in range(len(words)):
        for b in range(a, min(len(words), a + n)):
            found = set(words[a : b + 1]) & set(asked)
            if words[a] in asked and words[b] in asked and (best is None or (-len(found), b - a + 1, a) < best):
                best = (-len(found), b - a + 1, a)
    return None if best is None else (-best[0], best[1], best[2])


def test_best_window(spark):
    r = random.Random(6)
    texts = [[r.choice("abcdefghij") for _ in range(r.randrange(60))] for _ in range(150)] + [[], ["z"], ["a"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    for asked, n in ((["a", "b", "c"], 6), (["a", "a"], 3), (["a", "b", "c", "d", "e"], 30)):
        got = {x.id: x.b and tuple(x.b) for x in df.select("id", fulltext.best_window(F.col("w"), asked, n).alias("b")).collect()}
        assert got == {i: brute(w, asked, n) for i, w in enumerate(texts)}
    assert df.select(fulltext.best_window(F.col("w"), [], 5).alias("b")).where("b is not null").count() == 0


def test_snippets(spark):
    texts = ["one two three", "the " + "x " * 50 + "Cat, sat near (mat) " + "y " * 50, "", "no hit " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [x.s for x in df.select(fulltext.snippet(F.col("t"), ["the", "cat", "mat"], 10).alias("s")).collect()]
    assert got == ["one two three", "...x x x Cat, sat near (mat) y y y...", "", "no hit no hit no hit no hit no hit..."]


def test_words_are_compared_without_a_pattern_for_each(spark):
    texts = ["  -- The\tcat,\n\n(sat)  xé-Y ", "", "\n a --\x0b", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = fulltext.plain_words(F.col("t"))
    assert [x.w for x in df.select(plain.alias("w")).collect()] == [["", "the", "cat", "sat", "xéy"], [""], ["", "a", "", ""], ["one"]]
    plan = df.select(fulltext.best_window(plain, ["a"], 3).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(regexp_replace" not in plan
