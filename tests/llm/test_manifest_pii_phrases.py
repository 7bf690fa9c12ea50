"""Phrases, personal data, Merkle manifest: against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import edge_cases, frame, prose
from vellumlake.llm import merkle, phrases, pii

LETTERS = str.maketrans(phrases.UPPER, phrases.LOWER)


def phrase_brute(rows, top, least, percent):
    """All runs of all pieces, counted one by one."""
    f, total = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longest[p] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], score))
        out += [(lang, i, x[2].decode(), *x[3:6], total[lang], x[6]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "m", 1, "f") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, piece string, m int, phrase string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases(spark):
    r = random.Random(5)
    rows = [("en", " ".join(r.choice(["new", "york", "city", "Hall", "a", "b", "c"]) + r.choice(["", "", "", ",", ".\n"]) for _ in range(120))) for _ in range(40)]
    rows += [("de", "Straße\tLang  Ä Ö; Straße lang ä Ö")] * 20 + [(None, "x y z w x y z w " * 30), ("und", "x y. x y")] + [("fr", None), ("es", ""), ("it", " .,; \t ")] + [("en", "New York city")] * 300
    want = phrase_brute(rows, 40, 12, 80)
    assert rows_of(phrases.collocations(table(spark, rows), 40, 12, 80)) == want and {x[0] for x in want} == {"en", "de", "und"}
    assert rows_of(phrases.collocations(table(spark, rows[::-1] * 2), 40, 24, 80)) == phrase_brute(rows * 2, 40, 24, 80)
    assert phrases.collocations(table(spark, [])).count() == 0 and phrases.collocations(table(spark, [("en", "a b")])).count() == 0


def test_phrases_of_long_pieces_and_a_full_filter(spark, monkeypatch):
    rows = [("en", prose(1, 40_000, 30)), ("en", "again and again " * 5000)]
    monkeypatch.setattr(phrases, "LONGEST", 3)
    short = {x for x in phrase_brute(rows, 10**6, 30, 80)}
    monkeypatch.undo()
    got = rows_of(phrases.collocations(table(spark, rows), 10**6, 30, 80))
    assert got == phrase_brute(rows, 10**6, 30, 80) and short
    # a filter of 64 bits lets nearly all pass, and the counts are the same
    bits = phrases.bits_of(spark.createDataFrame([("en", f"w{i}", 1) for i in range(500)], phrases.RUN), 64)
    assert bits.tolist() == [2**64 - 1]


def test_phrases_equal_their_sql(spark):
    documents = table(spark, [("en", "a b c d. a b c! B a b") if i % 3 else (None, "a b c d") for i in range(90)]).toPandas()  # noqa: F841
    got = rows_of(phrases.collocations(spark.createDataFrame(documents)))
    assert got and got == sorted(duckdb.sql(phrases.SQL).fetchall())


def test_counts_of_many_buckets_are_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with phrases.Scratch(spark) as scratch:
            rows = scratch.keep(phrases.pieces(table(spark, [("en", " ".join(f"w{i}" for i in range(300)))] * 30)))
            levels = phrases.frequent_runs(scratch, rows, 30)
            assert [x.count() for x in levels] == [301, 299, 298, 297]
            assert all(len(x.inputFiles()) <= 4 for x in levels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


PII = [
    "a@b.c@d.e x_a@b.c_x@d.e a@b@c.d 🔺 é q@w.e.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3 4.5.6.7", "4111 1111 1111 1111 x 4111-1111-1111-1111 41111111111111110 4242424242424242 4242424242424241",
    "call +1 (826) 555-4081 190.137.223.204 or +4915112345678 +1 234 +", "IBAN DE89 3704 0044 0532 0130 00 THE GB82WEST12345698765432 GB82WEST12345698765433", "ssn 123-45-6789 and then, much further on in this text, the order 123-45-6789", "-@.-. ..@.. 1-1 +1-", "bank NL91 ABNA 0417 1643 00 AND",
]


def test_personal_data(spark):
    r = random.Random(2)
    noise = ["".join(r.choice("0123456789 .-+()@aé") for _ in range(r.randrange(1, 300))) for _ in range(300)]
    pairs = [*edge_cases(), *enumerate([*PII, *noise], 100)]
    found = pii.personal_data(frame(spark, pairs)).select("doc_id", "spans", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("all")).collect()
    assert len(found) == len(pairs) - 1
    got, texts = {x.doc_id: x for x in found}, {i: t or "" for i, t in pairs}
    for i, x in got.items():
        assert x.base == base_brute(texts[i]), texts[i]
        assert set(filter(None, x.base.split(","))) <= set(x["all"].split(",")) and [(s.start, s["rank"]) for s in x.spans] == sorted((s.start, s["rank"]) for s in x.spans)
    said = lambda i: [(s.kind, texts[i][s.start : s.end]) for s in got[i].spans if s.kind not in pii.BASE]
    assert said(102) == [("card_part", "4111-1111-1111-1111"), ("card_part", "4242424242424242")] or ("card", "4111 1111 1111 1111") in [(s.kind, texts[102][s.start : s.end]) for s in got[102].spans]
    assert said(103) == [("phone_part", "+1 (826) 555-4081")]
    assert said(104) == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")] and said(107) == [("iban", "NL91 ABNA 0417 1643 00")]
    assert said(105) == [("id_number", "123-45-6789")] and got[105].spans[0].start == 4
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_personal_data_context(spark):
    texts = ["pay by card 4111 1111 1111 1111", "order 4111 1111 1111 1111", "4111 1111 1111 1111", "server 8.8.4.4", "version 8.8.4.4", "192.168.0.1"]
    got = [r.spans[0].score for r in pii.personal_data(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got[1] < got[2] < got[0] and got[4] < got[3] and got[5] < 0.6


def test_personal_data_in_long_texts(spark):
    texts = {1: " a1@b.co" * 20_000, 2: "x" * 200_000, 3: "9" * 100_000, 4: "a@" + "b." * 60_000 + "c", 5: "1." * 60_000, 6: "+1" + " " * 100_000}
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, list(texts.items()))).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(8 * i + 1, 8 * i + 8) for i in range(20_000)]
    assert [len(got[i]) for i in range(2, 7)] == [0, 0, 1, 15_000, 0] and got[4][0].end == len(texts[4])
    redacted = {r.doc_id: r.text for r in pii.redacted(frame(spark, [(1, PII[3]), (2, None), (3, "none")])).collect()}
    assert redacted == {1: "call [phone_part] [ip] or [phone] +1 234 +", 2: "", 3: "none"}


def test_personal_data_stays_on_the_jvm(spark):
    plan = pii.personal_data(frame(spark, edge_cases()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def manifest_brute(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by = {}
    for r in rows:
        leaf = changed = digest("".join(map(field, r)))
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            changed = digest("".join(map(field, (*r[:4], r[4].translate(LETTERS)))))
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, changed, r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    trees = {x: levels([y[2] for y in sorted(by[x])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs]) if langs else []

    def path(tree, j):
        out = []
        for level in tree[:-1]:
            out.append(("".join(level[j // 8 * 8 : j]), "".join(level[j + 1 : j // 8 * 8 + 8])))
            j //= 8
        return out

    out = []
    for k, lang in enumerate(langs):
        for j, x in enumerate(sorted(by[lang])):
            p, h = path(trees[lang], j) + path(top, k), x[3]
            for a, b in p:
                h = digest(a + h + b)
            out.append((x[4], x[2], trees[lang][-1][0], top[-1][0], digest("".join(a + b for a, b in p)), h, h == top[-1][0]))
    return sorted(out, key=str)


MANIFEST = {
    "edges": [(1, "s", "en", 3, "ABC"), (1, "s", "en", 3, "ABC"), (2, None, None, None, None), (None, "s", "en", 1, "Q"), (None, None, None, None, None), (3, "x", "", 0, ""), (4, "x", "-", 1, "é A"), (5, "u", "=", 9, "b"), (12, "s", "é", 1, "É Z")],
    "one": [(1, "s", "en", 3, "ABC")],
    "none": [],
    "languages": [(i, "s", f"l{i % 75}", i % 7, f"Text {i} X") for i in range(500)] + [(1, "a", "solo", 1, "x")],
    "a large tree": [(i, "s", "en" if i % 3 else None, i % 7, f"Text {i} X") for i in range(9000)],
}


@pytest.mark.parametrize(("name", "high"), [("edges", 4), ("one", 4), ("none", 4), ("languages", 4), ("languages", 1), ("a large tree", 4), ("a large tree", 2)])
def test_manifest(spark, name, high):
    rows = MANIFEST[name]
    df = spark.createDataFrame([(*r, "t", 5, "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, leaf string")
    got = merkle.manifest(df, high)
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest_brute(rows)
    if rows and high == 4:
        documents = df.select("doc_id", "source", "lang", "n_chars", "text").toArrow()  # noqa: F841
        assert sorted(duckdb.sql(merkle.SQL).fetchall(), key=str) == manifest_brute(rows)


def test_manifest_finds_what_was_changed(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: r.verified for r in merkle.manifest(df).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(100)} and not all(got.values())
