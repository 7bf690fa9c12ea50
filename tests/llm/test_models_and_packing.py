"""Toxicity, pages, decontamination, packing, the pipeline: held-out accuracy, recall, round trips."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import changed, edge_cases, frame, prose
from vellumlake.llm import decontamination, html_extraction, packing, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_toxicity(spark):
    r = random.Random(1)
    pairs, labels = [], []
    for i in range(100, 500):
        bad = i % 5 == 0
        w = prose(i, 40, 200).split()
        for _ in range(2 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "grubbler", "snarkwad"]))
        pairs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    truth = dict(labels)
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(frame(spark, [*pairs, *edge_cases()]), known).collect()}
    held = [d for d in truth if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values()) and got[1].predicted == 0
    kept = {r.doc_id for r in toxicity.clean(frame(spark, pairs), known).collect()}
    assert len(kept & {d for d in truth if truth[d]}) < 5 and len(kept) >= 310


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.scored(frame(spark, edge_cases()), none).collect())
    assert toxicity.scored(frame(spark, []), none).count() == 0
    # the fixed voters work without labels
    pairs = [(i, prose(i, 40, 200) + (" you idiot, you pathetic moron" if i % 10 == 0 else "")) for i in range(200)]
    got = {r.doc_id: r.predicted for r in toxicity.scored(frame(spark, pairs), none).collect()}
    assert [d for d, p in sorted(got.items()) if p] == list(range(0, 200, 10))


def test_toxicity_comes_through_the_label_model(spark, monkeypatch):
    pairs = [(i, prose(i, 40, 200) + (" you idiot grubbler" if i % 5 == 0 else "")) for i in range(300)]
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    right = lambda: np.mean([r.predicted == (r.doc_id % 5 == 0) for r in toxicity.scored(frame(spark, pairs), known).collect() if r.held_out and r.doc_id % 5 == 0])
    assert right() > 0.9
    # voters that tell nothing, so that the posterior is the same for all votes
    monkeypatch.setattr(toxicity.LabelModel, "fit", lambda self, v, post, count: setattr(self, "table", [np.zeros((2, 3, 3))] * v.shape[1]))
    assert right() == 0  # without its posteriors nothing is learned


def test_label_model_accuracies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.9, 0.8, 0.6)] + [np.zeros(4000, int)], 1)
    votes[:, 3] = votes[:, 0]  # a copy of a voter is no more evidence
    model = toxicity.LabelModel(votes.astype(np.int8), np.where(np.arange(4000) < 400, y, -1), np.ones(4000))
    assert model.accuracy[:3] == pytest.approx([0.9, 0.8, 0.6], abs=0.06)
    assert model.parent[3] == 0 and model.information[0, 3] > 10 * model.information[0, 1]
    alone = toxicity.LabelModel(votes[:, :3].astype(np.int8), np.where(np.arange(4000) < 400, y, -1), np.ones(4000))
    assert model(votes.astype(np.int8)) == pytest.approx(alone(votes[:, :3].astype(np.int8)), abs=0.15)


def test_html(spark):
    pages = html_extraction.generated_pages(150, seed=11)
    rows = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(pages)] + [(1000, None, None), (1001, "u", ""), (None, "u", "<p>x"), (1002, "u", "<article><p>a &amp; b<br>c<p>d  e</article><script>x</script>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extracted(rows).collect()}
    assert None not in got and got[1000] == got[1001] == ""
    hit = miss = false = 0
    for i, (page, mark) in enumerate(pages):
        words = got[i].split()
        good = sum(mark in w for w in words)
        want = sum(mark in w for n in html_extraction.parse(page) for x in n.items if isinstance(x, str) for w in x.split())
        hit, miss, false = hit + good, miss + want - good, false + len(words) - good
    assert hit / (hit + miss) > 0.95 and hit / (hit + false) > 0.95


def test_blocks():
    nodes = html_extraction.parse("<div><h1>T &lt;x&gt;</h1><p><b>one<br>two <i>th</i>ree<p>four<ul><li>a<li>b</ul>tail</div><style>no</style><!-- no -->")
    assert html_extraction.blocks(nodes[0], [True] * len(nodes)) == ["T <x>", "one two three", "four", "a", "b", "tail"]


def test_unclosed_silent_elements():
    shown = lambda page: html_extraction.blocks((n := html_extraction.parse(page))[0], [True] * len(n))
    for start in ("<html><head><title>t</title><style>p {}</style><body>", "<head><script>'<p>no</p>'</script><meta charset='x'>", "<svg width='1' />", "<svg/>", "<button>", "<select>", "<object data='x'>", "<canvas>", "<head><title>t</title></head>"):
        got = shown(start + "<article><p>one <b>two</b></p><p>three</p></article>")
        assert got == ["one two", "three"], start
    assert shown("<p>a</p><svg><text>no</text></svg><button>no</button><p>b</p><header>c</header>") == ["a", "b", "c"]
    assert shown("<p>a</p><script>no <p>no") == shown("<p>a</p><!-- <p>no") == ["a"]
    assert shown("<button><article><p>a</p></article><button>no</button>") == ["a"] and shown("<object>a <math>b</math></object>") == ["a b"]
    assert shown("<head><noscript><p>no</p></noscript><title>no</title></head><p>a</p>") == shown("<head><title>no</title>a") == ["a"]
    assert shown("<svg/><p>a</p><svg><text>no</text></svg>") == ["a"]


def test_decoding_is_consistent():
    nodes = html_extraction.parse("<div><p>aaaa</p><p>bbbb</p></div><footer><p>cccc</p></footer>")
    stays = html_extraction.decode(nodes, np.array([0.1, 2.0, 1.0, -0.1, -3.0, 0.2]))
    assert stays[1] and stays[2] and stays[3] and not stays[4] and not stays[5]


@pytest.mark.parametrize("kind", ["replace", "put in", "leave out", "mixed"])
def test_decontamination_recall(kind):
    import pyarrow as pa

    r = random.Random(4)
    texts = [prose(9000 + i, 20 + i % 40) for i in range(150)]
    items = decontamination.Items(list(range(150)), texts, 0.2, 24, 2)
    docs = []
    for i, t in enumerate(texts):
        w = t.split()
        for _ in range(int(0.2 * len(w))):
            how, j = r.choice(["replace", "put in", "leave out"]) if kind == "mixed" else kind, r.randrange(len(w))
            w[j : j + (how != "put in")] = [] if how == "leave out" else [f"x{r.randrange(10**9)}"]
        docs.append(f"{prose(50 + i, 60)} {' '.join(w)} {prose(70000 + i, 50)}")
    h, _, at, _ = decontamination.words(pa.array(docs), marks=False)
    rows, found, _, _ = decontamination._matches(items, h, at)
    assert sum((i, i) in set(zip(rows, found, strict=True)) for i in range(150)) >= 0.95 * 150


def test_decontamination_of_nested_items(spark):
    whole = prose(1, 60)
    inner, last = " ".join(whole.split()[10:35]), " ".join(whole.split()[-20:])
    bench = spark.createDataFrame([(1, whole, "c"), (2, inner, "c"), (3, last, "c"), (4, last, "c"), (4, last, "c")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.start_word, r.distance) for r in decontamination.contaminated(frame(spark, [(7, f"{prose(2, 30)} {whole} {prose(3, 30)}"), (7, "other")]), bench).collect()}
    assert got == {(7, 1, 30, 0), (7, 2, 40, 0), (7, 3, 70, 0), (7, 4, 70, 0)}


def test_decontamination(spark):
    items = [(i, prose(5000 + i, 20 + i % 15)) for i in range(30)] + [(900, None), (901, ""), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs, want = list(edge_cases()), set()
    for i, t in items[:30]:
        for edits in range(4):
            doc = 1000 + 10 * i + edits
            pairs.append((doc, prose(doc, 80) + " " + changed(t, doc, edits).upper() + " " + prose(doc + 1, 60)))
            want.add((doc, i))
    clean = [(5000 + i, prose(i + 70000, 200)) for i in range(50)]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame(spark, pairs + clean), bench).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    assert all(got[k].distance == k[0] % 10 or got[k].distance < 4 for k in got)
    assert all((1000 + 10 * i, i) in got and got[1000 + 10 * i, i].start_word == 80 for i in range(30))
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    word = spark.createDataFrame([(1, "End!"), (2, "漢字 🔺")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, edge_cases()), word).collect()} == {(7, 1), (7, 2)}
    assert decontamination.contaminated(frame(spark, pairs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_within_runs_of_known_pairs(spark):
    inner, long = prose(1, 20), prose(2, 60).split()
    outer = " ".join([*long[:30], inner, *long[30:]])
    first, second = prose(3, 25), prose(4, 25)
    seam = f"{first.split()[-1]} {second.split()[0]}"  # joins first and second by a known pair
    common = " ".join([*prose(5, 10).split(), seam, *prose(6, 10).split(), second.split()[0]])
    ahead = common.split()[:12]  # known pairs right before a passage
    bench = spark.createDataFrame(list(enumerate([inner, outer, first, second, common])), "item_id long, text string")
    texts = [outer, f"{first} {second}", " ".join([*ahead, second]), first + " x", second]
    got = {(r.doc_id, r.item_id): (r.start_word, r.distance) for r in decontamination.contaminated(frame(spark, list(enumerate(texts))), bench).collect()}
    assert got == {(0, 0): (30, 0), (0, 1): (0, 0), (1, 2): (0, 0), (1, 3): (25, 0), (2, 3): (12, 0), (3, 2): (0, 0), (4, 3): (0, 0)}


def test_beginnings_are_all_windows_with_enough_pairs():
    r = np.random.default_rng(0)
    at = np.array([0, 40, 40, 45, 100])
    row = np.repeat(np.arange(4), np.diff(at))
    for least, span in ((1, 1), (2, 4), (3, 3), (5, 9), (30, 80)):
        known = (r.random(100) < 0.4) & ~np.isin(np.arange(100), at[1:] - 1)
        want = [s for s in range(100) if known[s : min(s + span, at[row[s] + 1])].sum() >= least]
        assert decontamination.beginnings(np.flatnonzero(known), least, span, row, at).tolist() == want


def test_edit_distance():
    a = np.array([1, 2, 3, 4], np.uint64)
    for text, d in (([9, 1, 2, 3, 4, 9], 0), ([1, 2, 4], 1), ([1, 7, 3, 4], 1), ([1, 2, 8, 3, 4], 1), ([9, 9], 4)):
        assert decontamination.edit_distance_within(a, np.array(text, np.uint64))[0] == d


def test_words_encode_as_texts():
    coder = packing.WordCache(packing.word_bpe())
    for t in ["", "Hello, WORLD!! it's  we'll'x 12ab", "É̀ café x\x0by\x1cz　k", "ǅ ß ﬁ İ ı <|endoftext|> </w>", prose(1, 50), "́a ́b x́", "a_b-c d.e %%% ### ..."]:
        assert coder.encode(t).tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    pairs = [p for p in edge_cases() if p[0] is not None] + [(20 + i, prose(i, 10 + 37 * i)) for i in range(40)] + [(100, "a " * 9000)]
    coder = packing.WordCache.at(packing.word_bpe())
    rows = packing.packed(frame(spark, [*pairs, (None, "x")]), packing.word_bpe(), window=512, group_tokens=20000).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    texts = dict(pairs)
    for doc, part in by_doc.items():
        if doc == 6:
            continue  # given twice
        ids = np.append(coder.encode(texts[doc] or ""), np.uint32(2)).astype("<u4")
        at = 0
        for r in sorted(part, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc) == len(texts) and len(by_doc[6]) == 2
    assert packing.packed(frame(spark, []), packing.word_bpe()).count() == 0


def test_best_fit_is_tightest():
    r = np.random.default_rng(3)
    lengths = np.sort(r.integers(1, 100, 300))[::-1]
    where, offsets = packing.best_fit(lengths, 100)
    room, brute = [], []
    for n in lengths.tolist():
        fit = [x for x in room if x >= n]
        left = min(fit) if fit else 100
        if fit:
            room.remove(left)
        room.append(left - n)
        brute.append(100 - left)
    assert offsets.tolist() == brute and where.max() + 1 == len(room)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    kept = [ids]
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept[4] == kept[3] and 0.5 * len(ids) < len(kept[4]) < len(ids)
    assert not any("token = \"" in t for t in texts.values())
    last = c.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == kept[4]
    assert last.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_sorted_keys_take_less_than_their_bytes():
    import numpy as np

    from vellumlake.llm import lm_scoring

    r = np.random.default_rng(4)
    for n in (0, 1, 7, 20_000):
        x = np.unique(r.integers(0, 1 << 32, n, np.uint64)).astype("<u4")
        assert (lm_scoring.opened(lm_scoring.shut(x)) == x).all()
    assert len(lm_scoring.shut(x)) < 3 * len(x)
    ends = np.array([0, (1 << 32) - 1], "<u4")
    assert (lm_scoring.opened(lm_scoring.shut(ends)) == ends).all()
