"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts elsewhere.
Every such window has one anchor: the first of its k-byte strings with the smallest
hash, which depends on the window's bytes alone.  Windows that are equal have equal
anchors at equal offsets, so only places with equal anchors need to meet.  All the
windows of an anchor form its region; regions that are equal as a whole (by a digest of
128 bits of their bytes) count each other, and only different regions of an anchor are compared: their suffixes at the
anchor are merge-sorted, a comparison finding the common extension by binary search
over prefix polynomial hashes, and the same to the left; the bytes themselves then
confirm what was found.  Anchors with many different regions, which near copies make,
compare window hashes instead of pairs, and those with very many deal their windows
out by hash, to any number of tasks.

The same comparison tells shorter repeats, of `passage` bytes or more: anchors are
chosen by windows of that length, and regions reach on for windows of `length` bytes.
Such passages are counted and stay in the text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, documents, importable, joined, mapped, mix, powers, signed

ANCHOR = 48
#: Different regions of an anchor that are compared pair by pair, and that one task takes; with more, windows are dealt by hash.
TOGETHER, ONE_TASK = 96, 8192
#: Bits for a place in a text; a Spark string holds fewer bytes.
PLACE = 32
#: About 40 words.
PASSAGE = 240


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return sums


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Of x[i : i + width] for each i that has so many."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def regions(texts: pa.Array, length: int, passage: int | None = None) -> tuple:
    """Of all anchors: row, key, digest of the region, place of the anchor in its text, bytes of the region before and from it.

    Anchors are those of windows of `passage` bytes; a region reaches from the first of an
    anchor's windows to where a window of `length` bytes that begins with the last would end.
    """
    passage = min(length, passage or length)
    none = (np.zeros(0, np.int64), np.zeros(0, U), [], *(np.zeros(0, np.int64),) * 3)
    data, starts = joined(texts)
    if len(data) < passage:
        return none
    width = passage - ANCHOR + 1
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    gram = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    order = (gram >> U(PLACE)) << U(PLACE) | np.arange(len(gram), dtype=U)
    best = (sliding_min(order, width) & U((1 << PLACE) - 1)).astype(np.int64)  # the anchor of the window at each byte
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.arange(len(best))
    s = first[first + passage <= starts[1:][row[: len(best)]] - 1]
    if not len(s):
        return none
    a = best[s]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))))
    lo, last, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
    r = row[lo]
    hi = np.minimum(last + length, starts[1:][r] - 1)
    whole = memoryview(data)
    own = [hashlib.blake2b(whole[i:j], digest_size=16, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(lo.tolist(), hi.tolist(), (a - lo).tolist(), strict=True)]
    return r, gram[a], own, a - starts[r], a - lo, hi - a


def extension(sums: np.ndarray, up: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
    """How many bytes from a and b on (or to the left of them) are equal, at most `most`, by binary search on prefix hashes."""
    lo, hi = np.zeros(a.shape, np.int64), most.astype(np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        if left:
            same = (sums[a] - sums[a - mid]) * up[b] == (sums[b] - sums[b - mid]) * up[a]
        else:
            same = (sums[a + mid] - sums[a]) * up[b] == (sums[b + mid] - sums[b]) * up[a]
        lo = np.where(same & (lo < hi), mid, lo)
        hi = np.where(same, hi, np.minimum(hi, mid - 1))
    return lo


def suffix_order(data: np.ndarray, sums: np.ndarray, up: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The merge-sorted order of each row's suffixes data[at : ends]; at is (groups, a power of two), -1 for none, which sorts last."""
    groups, size = at.shape
    order = np.broadcast_to(np.arange(size), at.shape).copy()
    base = np.arange(groups)[:, None]

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j, of the same group; ties by number."""
        a, b = at[base, i], at[base, j]
        most = np.where((a >= 0) & (b >= 0), np.minimum(ends[base, i] - a, ends[base, j] - b), 0)
        n = extension(sums, up, np.maximum(a, 0), np.maximum(b, 0), most)
        x = np.where(n < ends[base, i] - a, data[np.minimum(a + n, len(data) - 1)].astype(np.int64), -1)
        y = np.where(n < ends[base, j] - b, data[np.minimum(b + n, len(data) - 1)].astype(np.int64), -1)
        x, y = np.where(a < 0, 999, x), np.where(b < 0, 999, y)
        return np.where(x == y, i < j, x < y)

    run = 1
    while run < size:
        # each suffix finds by binary search how many of the sibling run come before it
        spot = np.arange(size)
        sibling = (spot // run ^ 1) * run
        lo, hi = np.zeros(at.shape, np.int64), np.full(at.shape, run)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            probe = order[base, np.minimum(sibling + mid, size - 1)]
            less = before(probe, order)
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        target = spot // (2 * run) * (2 * run) + spot % run + lo
        merged = np.empty_like(order)
        np.put_along_axis(merged, target, order, 1)
        order = merged
        run *= 2
    return order


def window_hashes(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the region, the place in it, and two hashes."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sums, (up, down) = prefix_sums(data), powers(len(data) + 1)
    other = np.zeros(len(data) + 1, U)
    np.cumsum(mix(data.astype(U) + U(9)) * up[: len(data)], out=other[1:])
    sizes = np.array([len(x) for x in blobs], np.int64)
    counts = sizes - length + 1
    region = np.repeat(np.arange(len(blobs)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    s = (np.cumsum(sizes) - sizes)[region] + place
    return region, place, *(mix((x[s + length] - x[s]) * down[s]) for x in (sums, other))


def equal_windows(blobs: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(region, first, end) of one group, by sorting the hashes of all windows; regions shorter than a window have none."""
    long = [i for i, b in enumerate(blobs) if len(b) >= length]
    if len(long) < len(blobs):
        return [(long[r], x, y) for r, x, y in equal_windows([blobs[i] for i in long], length)] if long else []
    region, place, one, two = window_hashes(blobs, length)
    _, first, at, n = np.unique(one ^ mix(two + U(3)), return_index=True, return_inverse=True, return_counts=True)
    hit = n[at] > 1
    twin = first[at]
    edge = np.flatnonzero(hit & ~(np.append(False, hit)[:-1] & (np.append(-1, region)[:-1] == region)))
    stop = np.flatnonzero(hit & ~(np.append(hit, False)[1:] & (np.append(region, -1)[1:] == region)))
    out = []
    for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
        same = all(blobs[region[i]][place[i] : place[i] + length] == blobs[region[twin[i]]][place[twin[i]] : place[twin[i]] + length] for i in (a, b))
        if not same:  # the hashes collide: compare the bytes of all windows
            return equal_by_bytes(blobs, length)
        out.append((int(region[a]), int(place[a]), int(place[b]) + length))
    return out


def equal_by_bytes(blobs: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """As equal_windows(), without hashes of our own."""
    count = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    return [(r, i, i + length) for r, b in enumerate(blobs) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1]


def shared_windows(group: np.ndarray, blobs: list[bytes], back: np.ndarray, length: int, together: int = TOGETHER, passage: int | None = None) -> list[tuple[int, int, int, bool]]:
    """(region, first, end, long) of the bytes of each region whose windows another region of its group has too; group is sorted.

    Windows have `passage` bytes; long says that windows of `length` bytes are shared as well.
    """
    passage = min(length, passage or length)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    begin = np.cumsum(sizes) - sizes
    anchor, end = begin + back, begin + sizes
    sums, (up, _) = prefix_sums(data), powers(len(data) + 1)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    counts = np.diff(np.append(starts, len(group)))
    out = []
    for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c > together:
            for n in {length, passage}:
                out += [(a + r, x, y, n == length) for r, x, y in equal_windows(blobs[a : a + c], n)]
    counts = np.where(counts > together, 1, counts)
    for size in {1 << int(c - 1).bit_length() for c in counts.tolist() if c > 1}:
        some = np.flatnonzero((counts > 1) & (counts <= size) & (counts > size // 2))
        slots = np.arange(size)[None, :]
        there = slots < counts[some][:, None]
        region = np.where(there, starts[some][:, None] + slots, 0)
        at = np.where(there, anchor[region], -1)
        order = suffix_order(data, sums, up, at, np.where(there, end[region], -1))
        ranked = np.take_along_axis(region, order, 1)
        valid = np.take_along_axis(there, order, 1)
        # common extension of neighbours to the right; of any two the least between them
        for gap in range(1, size):
            i, j = ranked[:, :-gap], ranked[:, gap:]
            ok = valid[:, :-gap] & valid[:, gap:]
            near = extension(sums, up, anchor[ranked[:, :-1]], anchor[ranked[:, 1:]], np.where(valid[:, :-1] & valid[:, 1:], np.minimum(end[ranked[:, :-1]] - anchor[ranked[:, :-1]], end[ranked[:, 1:]] - anchor[ranked[:, 1:]]), 0)) if gap == 1 else near
            right = near.copy() if gap == 1 else np.minimum(right[:, :-1], near[:, gap - 1 :])
            hit = np.argwhere(ok & (right > 0))
            if not len(hit):
                break
            x, y, r = i[tuple(hit.T)], j[tuple(hit.T)], right[tuple(hit.T)]
            left = extension(sums, up, anchor[x], anchor[y], np.minimum(back[x], back[y]), left=True)
            for p, q, a, b in zip(x.tolist(), y.tolist(), left.tolist(), r.tolist(), strict=True):
                if a + b >= passage:
                    u, v = anchor[p] - a, anchor[q] - a
                    if data[u : u + a + b].tobytes() == data[v : v + a + b].tobytes():  # no collision
                        out += [(p, int(u - begin[p]), int(u - begin[p]) + a + b, a + b >= length), (q, int(v - begin[q]), int(v - begin[q]) + a + b, a + b >= length)]
    return out


def repeats(docs: DataFrame, length: int, passage: int, together: int, one_task: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, spans): the byte ranges [start, end) of each text that strings of passage bytes which start more than once cover; long says that strings of length bytes do so, too.

    Rows that repeat a doc_id are texts of their own, equal rows included.  The
    second result is (doc_id, text_hash, z): all texts, compressed.
    """
    importable(docs.sparkSession)
    d = documents(docs).withColumn("text_hash", F.xxhash64("text"))

    def find(batch: pa.RecordBatch) -> dict[str, object] | None:
        r, key, own, place, back, ahead = regions(batch.column("text"), length, passage)
        if not len(r):
            return None
        rows = pa.array(r)
        return {"doc_id": batch.column("doc_id").take(rows), "text_hash": batch.column("text_hash").take(rows), "key": signed(key), "region": pa.array(own, pa.binary()), "place": place.astype(np.int64), "back": back.astype(np.int32), "ahead": ahead.astype(np.int32)}

    found = scratch.keep(mapped(d, find, "doc_id long, text_hash long, key long, region binary, place long, back int, ahead int"))
    kinds = scratch.keep(found.groupBy("key", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place", "back", "ahead")).alias("at")))
    # equal regions: all of each
    whole = found.join(kinds.where("n > 1").select("key", "region"), ["key", "region"]).select("doc_id", "text_hash", (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"), (F.col("back") + F.col("ahead") >= length).alias("long"))
    # different regions of one anchor: their bytes meet
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    need = kinds.join(several, "key").select("at.*", "key", "n", "m").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "n", "m", "place", "back", "ahead")).alias("want"))

    def squeeze(batch: pa.RecordBatch) -> dict[str, object]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "z": pa.array([z.compress(x) for x in batch.column("text").cast(pa.large_binary()).to_pylist()], pa.binary())}

    small = mapped(d, squeeze, "doc_id long, text_hash long, z binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                out: dict[str, list] = {k: [] for k in ("key", "n", "m", "doc_id", "text_hash", "start", "back", "bytes")}
                for doc, text_hash, packed, want in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "z", "want")), strict=True):
                    data = z.decompress(packed) if packed else b""
                    for w in want:
                        lo = w["place"] - w["back"]
                        for k, x in zip(out, (w["key"], w["n"], w["m"], doc, text_hash, lo, w["back"], data[lo : w["place"] + w["ahead"]]), strict=True):
                            out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("back", pa.int32()), ("bytes", pa.binary())]))

    one_each = small.join(need, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    blobs = scratch.keep(one_each.select("doc_id", "text_hash", "z", "want").mapInArrow(cut, "key long, n long, m long, doc_id long, text_hash long, start long, back int, bytes binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]):
            hits = shared_windows(np.array([r[0] for r in rows]), [r[5] for r in rows], np.array([r[4] for r in rows], np.int64), length, together, passage)
            hits = [(rows[p], a, b, long) for p, a, b, long in sorted(set(hits)) if rows[p][6] == 1]
            columns = [pa.array([f(r, a, b) for r, a, b, _ in hits], pa.int64()) for f in (lambda r, a, b: r[1], lambda r, a, b: r[2], lambda r, a, b: r[3] + a, lambda r, a, b: r[3] + b)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([bool(x[3]) for x in hits], pa.bool_())], names=["doc_id", "text_hash", "start", "end", "long"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text_hash", "start", "back", "bytes", "n")), strict=True):
                if size > 1 << 20 and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    spans = "doc_id long, text_hash long, start long, end long, long boolean"
    part = blobs.where(F.col("m") <= one_task).repartition("key").sortWithinPartitions("key").mapInArrow(compare, spans)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for size in {length, passage}:
                    rows = batch.slice(i, 256)
                    rows = rows.filter(pc.greater_equal(pc.binary_length(rows.column("bytes")), size))
                    if not rows.num_rows:
                        continue
                    row, off, one, two = window_hashes(rows.column("bytes").to_pylist(), size)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two)), rows.column("doc_id").take(take), rows.column("text_hash").take(take), pa.array(rows.column("start").to_numpy()[row] + off), rows.column("n").take(take), pa.array([size] * len(row), pa.int32())], names=["w1", "w2", "doc_id", "text_hash", "start", "n", "size"])

    # equal windows of different regions of one anchor, each region once
    dealt = blobs.where(F.col("m") > one_task).select("doc_id", "text_hash", "start", "n", "bytes").mapInArrow(windows, "w1 long, w2 long, doc_id long, text_hash long, start long, n long, size int")
    twice = dealt.groupBy("w1", "w2", "size").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2", "size")
    runs = dealt.where("n = 1").join(twice, ["w1", "w2", "size"]).select("doc_id", "text_hash", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("size") == length).alias("long"))
    every = whole.union(part).union(runs)
    return every.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end", "long")).alias("spans")), small


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, length: int = 400, together: int = TOGETHER, one_task: int = ONE_TASK, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_repeated): every row's text without the bytes that strings of length bytes which also start elsewhere cover, as UTF-8 bytes (a character may lose a part).

    n_repeated counts the bytes that strings of passage bytes (by default of length
    bytes) cover in the same way.  A null or empty text has no bytes; rows without a
    doc_id are left out; rows that repeat are texts of their own and so repeat each
    other; an empty table gives no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_deduplicated(docs, length, min(length, passage or length), together, one_task, scratch))


def _deduplicated(docs: DataFrame, length: int, passage: int, together: int, one_task: int, scratch: Scratch) -> DataFrame:
    spans, small = repeats(docs, length, passage, together, one_task, scratch)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                for packed, gone in zip(part.column("z").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    data = z.decompress(packed) if packed else b""
                    runs = covered([(g["start"], g["end"]) for g in gone or () if g["long"]])
                    repeated = covered([(g["start"], g["end"]) for g in gone or ()])
                    kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True))
                    for column, x in zip(out, (len(data), sum(b - a for a, b in runs), len(runs), kept, sum(b - a for a, b in repeated)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.binary() if i == 3 else pa.int64()) for i, x in enumerate(out))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated"])

    both = small.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "z", "spans")
    return both.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated long")


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """deduplicated() of the whole table documents by 400 bytes; n_repeated by 240 bytes; see there for nulls, empty and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        out = _deduplicated(docs, 400, PASSAGE, TOGETHER, ONE_TASK, scratch)
        return scratch.result(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated"))
