"""N-gram Jaccard join with prefix filters under several global token orders.

Texts with equal shingle sets are one class.  Two sets whose Jaccard similarity is
at least t share a token among the first n - ceil(t n) + 1 tokens of either, under
*any* order of all tokens; where the first shared token stands bounds the overlap.
The first order (frequent tokens last) finds candidates by a join of prefixes.  A
candidate goes on only if counts of hashed tokens leave enough room for overlap, and
then only if the two prefixes under each further order share a token too; for this
the prefixes alone are moved, as 32-bit hashes, which can keep a pair too many but
never lose one.  What passes every filter is verified on the whole sets.

Groups of copies never become pairs of all with all.  First each class is
verified against one hub of each prefix token; the classes that this connects
need no more links among themselves.  Only tokens whose classes are still in
several components give further pairs, between components, so all components are
exact: any linked pair shares a token, and is either connected already or tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP, U, Scratch, documents, importable, mapped, mix, only, pieces, shingles, signed
from .components import components

#: Counters for the frequency classes that the orders begin with; a fixed size, whatever the input.
CLASSES = 1 << 16
ORDERS = 3
#: Longs of eight 8-bit counters each, which go along with every token of a class.
SKETCH = 8
#: Tokens to a counter of the fuller counts, which are looked up for candidates.
EACH = 4


def _sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    sets = shingles(texts, n)
    key = np.array([int(np.bitwise_xor.reduce(mix(s + U(STEP)))) ^ (int(s.sum(dtype=U)) * 3 & 0xFFFFFFFFFFFFFFFF) if len(s) else 0 for s in sets], U)
    return sets, key


def counted(s: np.ndarray, cells: int) -> np.ndarray:
    """How many tokens of a set fall into each of a power of two of cells, by hash; 255 stands for more.

    Sums of the differences of two sets' counts are at most the tokens that only one of them has.
    """
    return np.minimum(np.bincount((s >> U(64 - cells.bit_length() + 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def cells_of(size: int) -> int:
    return max(64, 1 << (size // EACH).bit_length())


def classes(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, class, cells): documents with equal shingle sets have equal classes; cells counts the set's tokens by hash, the more cells the larger the set."""

    def one(batch: pa.RecordBatch) -> dict[str, object]:
        sets, key = _sets(batch.column("text"), n)
        return {"doc_id": batch.column("doc_id"), "n_shingles": np.array([len(s) for s in sets], np.int64), "class": signed(key), "cells": pa.array([counted(s, cells_of(len(s))).tobytes() for s in sets], pa.binary())}

    return mapped(documents(docs), one, "doc_id long, n_shingles long, class long, cells binary")


def apart(x: bytes, y: bytes) -> int:
    """The least number of tokens that only one of two sets has, by their cells."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(x) != len(y):  # counts of 255 say too little once they are added up
        if (max(x.max(initial=0), y.max(initial=0))) == 255:
            return 0
        size = min(len(x), len(y))
        x, y = x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)
    return int(np.abs(x - y).sum())


#: Every other byte of a long, and the bit above each of them.
BYTES, ABOVE = 0x00FF00FF00FF00FF, 0x0100010001000100


def differing(x: list[Column], y: list[Column], total_x: Column, total_y: Column) -> Column:
    """apart(), of sketches and their totals, on the JVM: twice what x has more than y, cell by cell, less what it has more in all.

    Four counters of a long are compared at once, in lanes of 16 bits.
    """
    lanes = F.lit(0).cast("long")
    half = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(BYTES))
    for a, b in zip(x, y, strict=True):
        for i in range(2):
            d = half(a, i).bitwiseOR(F.lit(ABOVE)) - half(b, i)
            lanes = lanes + d.bitwiseAND(F.shiftrightunsigned(d.bitwiseAND(F.lit(ABOVE)), 8) * 255)
    more = lanes % 0xFFFF  # the sum of the lanes, as 2**16 is 1 modulo 0xFFFF
    return 2 * more - total_x + total_y


def token_classes(docs: DataFrame, n: int) -> np.ndarray:
    """How frequent tokens are, by hash modulo CLASSES, in half powers of two; one byte each."""

    def run(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in pieces(batches):
            sets = shingles(batch.column("text"), n)
            if any(len(s) for s in sets):
                total += np.bincount((np.concatenate(sets) % U(CLASSES)).astype(np.int64), minlength=CLASSES)
        if total.any():
            for i in range(16):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.reshape(16, -1)[i].astype("<u4").tobytes()])], names=["part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES // 16, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "counts"])

    parts = documents(docs).mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((16, CLASSES // 16), np.int64)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return np.rint(2 * np.log2(1 + out.ravel())).astype(np.uint8)


def prefix(s: np.ndarray, rank: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The first tokens of a set under an order: rarer classes first, then by a scramble of the order's own."""
    keep = len(s) - -(-percent * len(s) // 100) + 1
    salted = mix(s + U((order + 1) * STEP & 0xFFFFFFFFFFFFFFFF))
    key = (rank[(s % U(CLASSES)).astype(np.int64)].astype(U) << U(56)) | (salted >> U(8))
    if keep < len(s):
        first = np.argpartition(key, keep - 1)[:keep]
        s, key = s[first], key[first]
    return s[np.argsort(key)]


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): components of documents linked by Jaccard similarity >= percent/100 of their n-word shingles.

    component_id is the smallest doc_id that links lead to, the document itself
    included.  n_links counts the verified links of the document's class to other
    classes (connections that follow from others are not all counted) and the
    other documents of its class.  Empty sets link with nothing; a null text is
    empty; rows without a doc_id are left out; rows that repeat a doc_id count as
    that one document with all their texts' links, one row each; an empty table
    gives no rows; other columns are ignored.
    """
    importable(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_components(documents(docs), n, percent, scratch))


def _components(d: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    by_doc = scratch.keep(classes(d, n))
    full = by_doc.where("n_shingles > 0")
    reps = scratch.keep(full.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    rank = token_classes(d, n)
    longs = [f"s{i}" for i in range(SKETCH)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies go on once from each task
        for batch in pieces(batches):
            sets, key = _sets(batch.column("text"), n)
            fresh = [i for i, k in enumerate(key.tolist()) if len(sets[i]) and k not in seen and not seen.add(k)]
            if len(seen) > 2_000_000:
                seen.clear()
            if fresh:
                pre = [prefix(sets[i], rank, percent, 0) for i in fresh]
                k = np.array([len(p) for p in pre])
                columns = [signed(np.concatenate(pre)), signed(np.repeat(key[fresh], k)), np.repeat(np.array([len(sets[i]) for i in fresh], np.int32), k), np.concatenate([np.arange(x, dtype=np.int32) for x in k])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "n", "pos"])

    raw = d.mapInArrow(entries, "token long, class long, n int, pos int")
    # tokens of two classes at least; most tokens are of one and go no further
    shared = raw.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
    own = scratch.keep(raw.join(shared, "token", "left_semi").groupBy("token", "class").agg(F.max("n").alias("n"), F.max("pos").alias("pos")))
    # the hub of a token is the class that shares most tokens: an original rather than a changed copy
    shares = own.groupBy("class").agg(F.count("*").alias("shares"))
    hubs = own.join(shares, "class").groupBy("token").agg(F.max(F.struct("shares", "class", "n", "pos")).alias("hub"))
    posts = scratch.keep(own.join(hubs, "token").select("token", "class", "n", "pos", F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")))
    scratch.drop(own)

    def close(n, m, i, j):
        """May two sets of n and m tokens link, if the first that they share is the i-th and the j-th of them?  What stands before is in one of them only."""
        n, m, i, j = map(F.col, (n, m, i, j))
        least = F.ceil((n + m) * percent / F.lit(100 + percent))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (i + j <= n + m - 2 * least)

    star = scratch.keep(posts.where((F.col("class") != F.col("hub")) & close("n", "hub_n", "pos", "hub_pos")).select(F.greatest("class", "hub").alias("a"), F.least("class", "hub").alias("b")).distinct())

    def near(batches):
        for batch in batches:
            good = [apart(x, y) * (100 + percent) <= (n + m) * (100 - percent) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def heads(batch: pa.RecordBatch) -> dict[str, object]:
        """Of each text: its class, itself, compressed, and its prefixes under the further orders."""
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        sets, key = _sets(batch.column("text"), n)
        out = {"class": signed(key), "z": pa.array([z.compress(x) for x in batch.column("text").cast(pa.large_binary()).to_pylist()], pa.binary())}
        for o in range(1, ORDERS):
            out[f"p{o}"] = pa.array([np.unique((prefix(s, rank, percent, o) >> U(32)).astype("<u4")).tobytes() for s in sets], pa.binary())
        return out

    def met(batches):
        """The pairs whose prefixes share a token under every further order."""
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for o in range(1, ORDERS):
                for i, (x, y) in enumerate(zip(batch.column(f"x{o}").to_pylist(), batch.column(f"y{o}").to_pylist(), strict=True)):
                    good[i] = good[i] and np.intersect1d(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), assume_unique=True).size > 0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    def verify(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                whole = {}  # each text of these pairs once
                for c, k in (("x", "a"), ("y", "b")):
                    whole |= dict(zip(part.column(k).to_pylist(), part.column(c).to_pylist(), strict=True))
                sets = dict(zip(whole, shingles(pa.array([z.decompress(x) if x else b"" for x in whole.values()], pa.large_binary()), n), strict=True))
                good = []
                for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                    good.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def paired(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        """pairs with the columns of a's class as x..., and of b's as y..."""
        side = lambda k, to: of.select(F.col("class").alias(k), *[F.col(c).alias(to + c) for c in columns])
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that pass the counts, the other orders' filters and the verification."""
        ids = lambda: pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        cells = scratch.keep(full.join(ids(), "class", "left_semi").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("cells").alias("cells")))
        both = paired(pairs, cells, "n", "cells").select("a", "b", F.col("xn").alias("n"), F.col("yn").alias("m"), F.col("xcells").alias("x"), F.col("ycells").alias("y"))
        pairs = scratch.keep(both.mapInArrow(near, "a long, b long"))
        scratch.drop(cells)
        need = ids().join(reps, "class").select(F.col("rep").alias("doc_id"), "class")
        kinds = "class long, z binary" + "".join(f", p{o} binary" for o in range(1, ORDERS))
        texts = mapped(only(d.select("doc_id", "text"), need.select("doc_id"), scratch=scratch), heads, kinds)
        texts = scratch.keep(texts.join(ids(), "class", "left_semi").groupBy("class").agg(*[F.first(c).alias(c) for c in ("z", *[f"p{o}" for o in range(1, ORDERS)])]))
        heads_of = [f"p{o}" for o in range(1, ORDERS)]
        both = paired(pairs, texts, *heads_of).select("a", "b", *[F.col(f"{x}p{o}").alias(f"{x}{o}") for x in "xy" for o in range(1, ORDERS)])
        met_ = scratch.keep(both.mapInArrow(met, "a long, b long"))
        out = scratch.keep(paired(met_, texts, "z").select("a", "b", F.col("xz").alias("x"), F.col("yz").alias("y")).mapInArrow(verify, "a long, b long"))
        scratch.drop(pairs, texts, met_)
        return out

    links = linked(star)
    label = components(links)
    mine = scratch.keep(posts.join(label.withColumnRenamed("node", "class"), "class", "left").select("token", "class", "n", "pos", F.coalesce("component", "class").alias("component"), "hub"))
    scratch.drop(posts)
    mixed = mine.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    # the hub has been tried with all the others; counts are looked up once for each class
    rest = scratch.keep(mine.where(F.col("class") != F.col("hub")).join(mixed, "token", "left_semi").select("token", "class", "n", "pos", "component"))
    scratch.drop(mine)
    few = rest.select("class").distinct()

    def sketches(batches):
        for batch in batches:
            cells = [np.frombuffer(x, np.uint8).astype(np.int64).reshape(8 * SKETCH, -1).sum(1) for x in batch.column("cells").to_pylist()]
            s = np.minimum(np.array(cells).reshape(-1, 8 * SKETCH), 255).astype(np.uint8).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(s.view(np.uint8).sum(1, dtype=np.int64)), *(pa.array(np.ascontiguousarray(s[:, i])) for i in range(SKETCH))], names=["class", "total", *longs])

    small = scratch.keep(full.join(few, "class", "left_semi").groupBy("class").agg(F.first("cells").alias("cells")).mapInArrow(sketches, "class long, total long, " + ", ".join(f"{c} long" for c in longs)))
    # columns that can't be null give short code, which the JVM compiles
    sure = rest.join(small, "class").select("token", "class", "component", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "pos", "total", *longs)])
    # sizes of linked sets lie in one stretch of sizes or in neighbouring ones, so only these meet
    width = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 0
    sure = sure.withColumn("stretch", F.floor(F.log("n") / width) if width else F.col("n").cast("long"))
    x, y = sure.alias("x"), sure.withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") - 1))).alias("y")
    side = lambda k: [F.col(f"{k}.{c}") for c in longs]
    room = differing(side("x"), side("y"), F.col("x.total"), F.col("y.total")) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    less = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class"))
    more = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.stretch") == F.col("y.stretch")) & less & (F.col("x.component") != F.col("y.component")) & close("x.n", "y.n", "x.pos", "y.pos") & room)
    more = more.select(F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")).distinct()
    more = scratch.keep(more.join(star, ["a", "b"], "left_anti"))
    scratch.drop(rest, small, star)
    links = links.union(linked(more))
    label = components(links).select(F.col("node").alias("class"), "component")
    degree = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("degree"))
    found = reps.join(label, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
    found = found.select("class", "rep", "component", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    first = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(first, "component").select("class", "component_id", "n_links")
    out = full.join(found, "class").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = by_doc.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document left of each component, the one with the smallest doc_id; rows without a doc_id stay."""
    gone = jaccard_components(docs, n, percent).where("doc_id <> component_id").select("doc_id")
    return only(docs, gone, "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """jaccard_components() of the whole table documents by three words and 0.9; see there for nulls, empty and repeated rows."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90).drop("n_links")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i]||' '||ws[i + 1]||' '||ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS u, doc_id AS m FROM n UNION SELECT e.u, r.m FROM e JOIN r ON e.v = r.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n"""
