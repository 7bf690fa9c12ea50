"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit distance.

Texts and benchmark items are sequences of lower-case words without marks.  A CGK walk reads a sequence with
one pointer, which each step moves on or leaves by a random bit of (step, word);
edit distance becomes Hamming distance of what the walk reads.  Each repetition has
a walk of its own and samples a few of its steps; windows of a text as long as an
item that agree with it on all of them are candidates, and repetitions are enough for
the target recall (with 2 steps and 24 repetitions over 0.95 of places with a fifth of
their words replaced, put in or left out; shorter and longer windows find no more).  A
candidate counts if an exact edit distance confirms it.

A place with at most k edits keeps all but 2 k of an item's pairs of neighbouring
words, so for each length of items only windows with that many pairs from items of
this length are embedded, wherever they begin; this loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, documents, mapped, mix, words

#: Benchmark words that one pass over the texts looks for; larger benchmarks take several passes.
BLOCK_WORDS = 2_000_000
#: Windows that are embedded at once.
WINDOWS = 20_000


class Items:
    """Benchmark items of one block, and the LSH tables over them."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, repetitions: int, samples: int):
        self.edits, self.repetitions = edits, repetitions
        h, _, at, _ = words(pa.array(texts, pa.string()), marks=False)
        self.ids = [i for i, a, b in zip(ids, at, at[1:], strict=False) if b > a]
        self.words = [h[a:b] for a, b in zip(at, at[1:], strict=False) if b > a]
        self.pairs = np.unique(np.concatenate([np.zeros(0, U), *(pairs(w) for w in self.words)]))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.pairs & U((1 << 22) - 1)).astype(np.int64)] = True
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        # the lengths of the items that hold each pair: lengths self.of[self.of_at[i] : self.of_at[i + 1]] for pair i
        held = [np.unique(np.searchsorted(self.pairs, np.concatenate([pairs(self.words[i]) for i in np.flatnonzero(self.lengths == m)]))) for m in np.unique(self.lengths)]
        which = np.concatenate([np.zeros(0, np.int64), *held])
        self.of = np.repeat(np.unique(self.lengths), [len(x) for x in held])[np.argsort(which, kind="stable")]
        self.of_at = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(self.pairs)))))
        self.tables: dict[int, tuple] = {}
        for m in np.unique(self.lengths).tolist():
            members = np.flatnonzero(self.lengths == m)
            rng = np.random.default_rng(m)
            steps = 3 * m
            data = np.concatenate([self.words[i] for i in members])
            starts = np.arange(len(members), dtype=np.int64) * m
            odd = rng.integers(0, 1 << 63, (repetitions, steps), np.int64).astype(U) * U(2) + U(1)
            # of the steps that are still inside the item most likely: a walk ends near 2 m
            take = np.array([np.isin(np.arange(steps), rng.choice(2 * m, min(samples, 2 * m), replace=False)) for _ in range(repetitions)])
            keys = walk(data, starts, m, odd, take)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables[m] = (odd, take, np.take_along_axis(keys, order, 1), members[order])

    def allowed(self, m: int) -> int:
        return int(self.edits * m)


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U(3) + h[1:])


def walk(data: np.ndarray, starts: np.ndarray, m: int, odd: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Keys (a row for each repetition) of the windows data[start : start + m]: hashes of what the walks read at their sampled steps."""
    at = np.repeat(starts[None, :], len(odd), axis=0)
    ends, keys = starts + m, np.zeros(at.shape, U)
    last = len(data) - 1
    for step in range(int(np.flatnonzero(take.any(0))[-1]) + 1):
        read = data[np.minimum(at, last)]
        read[at >= ends] = 0
        if (some := take[:, step]).any():
            keys[some] = mix(keys[some] * U(31) + read[some] + U(1))
        at += ((read * odd[:, step, None]) >> U(63)).view(np.int64)
        np.minimum(at, ends, out=at)
    return keys


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edits that turn item into some run of text, end of the first such run)."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != U(w)))
        row = np.concatenate(([i], new))
        row = np.minimum.accumulate(row - steps) + steps  # insertions along the row
    end = int(row.argmin())
    return int(row[end]), end


def beginnings(spot: np.ndarray, least: int, span: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All places from which span pairs, as far as the text goes, include `least` of those at spot (in order)."""
    first, last = spot[: max(0, len(spot) - least + 1)], spot[least - 1 :]
    low = np.maximum(last - (span - 1), np.concatenate(([0], first[:-1] + 1))) if len(first) else first
    low = np.maximum(low, at[row[first]])
    n = np.where(row[first] == row[last], np.maximum(first - low + 1, 0), 0)
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _matches(items: Items, h: np.ndarray, at: np.ndarray) -> tuple[list, list, list, list]:
    rows, found, begins, distances = [], [], [], []
    if not len(h) or not items.ids:
        return rows, found, begins, distances
    two = pairs(h)
    known = items.bitmap[(two & U((1 << 22) - 1)).astype(np.int64)]
    known[at[(at > 0) & (at < len(h))] - 1] = False  # no pair spans two texts
    where = np.flatnonzero(known)
    place = np.minimum(np.searchsorted(items.pairs, two[where]), max(0, len(items.pairs) - 1))
    if len(where):
        same = items.pairs[place] == two[where]
        where, place = where[same], place[same]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # each known pair once for each length of items that hold it
    times = items.of_at[place + 1] - items.of_at[place] if len(where) else place
    length = items.of[np.repeat(items.of_at[place] - np.cumsum(times) + times, times) + np.arange(times.sum())] if len(where) else place
    order = np.argsort(length, kind="stable")
    spot, length = np.repeat(where, times)[order], length[order]
    seen = set()
    for m, (odd, take, keys, members) in items.tables.items():
        k = items.allowed(m)
        if m == 1:  # no pairs: the word itself
            starts = np.flatnonzero(np.isin(h, np.concatenate([items.words[i] for i in np.flatnonzero(items.lengths == 1)])))
        else:
            starts = beginnings(spot[np.searchsorted(length, m, "left") : np.searchsorted(length, m, "right")], m - 1 - 2 * k, m + k - 1, row, at)
        if not len(starts):
            continue
        pad = np.append(h, np.zeros(m, U))
        for some in np.split(starts, range(WINDOWS, len(starts), WINDOWS)):
            for got, own, who in zip(walk(pad, some, m, odd, take), keys, members, strict=True):
                lo, hi = np.searchsorted(own, got, "left"), np.searchsorted(own, got, "right")
                for j in np.flatnonzero(hi > lo).tolist():
                    s = int(some[j])
                    r = int(row[s])
                    s -= s % (k + 1)  # nearby windows are verified together
                    for i in who[lo[j] : hi[j]].tolist():
                        if (r, i, s) in seen:
                            continue
                        seen.add((r, i, s))
                        a, b = max(int(at[r]), s - k), min(int(at[r + 1]), s + m + 2 * k + 1)
                        if np.isin(items.words[i], h[a:b]).sum() < m - k:
                            continue  # more words are missing than edits allow
                        d, end = edit_distance_within(items.words[i], h[a:b])
                        if d <= k:
                            rows.append(r)
                            found.append(items.ids[i])
                            begins.append(max(0, a + end - m - int(at[r])))
                            distances.append(d)
    return rows, found, begins, distances


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of at most about BLOCK_WORDS words; usually one."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (5 * BLOCK_WORDS)))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, repetitions: int = 24, samples: int = 2) -> DataFrame:
    """(doc_id, item_id, start_word, distance): where documents hold an item with at most edits * its words changed.

    distance is the least found, start_word the start of that place (the first of
    equals).  Empty items match nothing; rows that repeat a doc_id report together.
    """
    d, out = documents(docs).withColumn("text", F.lower("text")), None
    for block in blocks(benchmark):
        rows = block.orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], edits, repetitions, samples)

        def scan(batch: pa.RecordBatch, items=items) -> dict[str, object] | None:
            h, _, at, _ = words(batch.column("text"), marks=False)
            rows, found, begins, distances = _matches(items, h, at)
            if not rows:
                return None
            return {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": pa.array(found, pa.int64()), "start_word": pa.array(begins, pa.int64()), "distance": pa.array(distances, pa.int64())}

        part = mapped(d, scan, "doc_id long, item_id long, start_word long, distance long", limit=2_000_000)
        out = part if out is None else out.union(part)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.start_word", "best.distance")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() of the whole table documents by the table benchmark; see there for nulls, empty and repeated rows."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
