"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Words and pairs of neighbouring words are counted over all training documents and
dealt by hash into blocks, as many as the text needs.  A count c is quantised to
q = 1 + floor(log2 c), and the n-gram goes into its block's filter q times, with
1, ..., q: a reader probes 1, 2, ... until one is missing.  All words and pairs are in
the filter, whose size follows the counts.  So it grows with the corpus, and nothing
bounds what a broadcast would carry: a part for each block stays in the shared folder,
and n-grams are asked of their part.  A caller who knows the corpus to be small may name
a bound (most_bits) up to which the whole filter is broadcast and probed where the texts
are; both ways read the same bits, so they give the same scores.

Within its block an n-gram is a 32-bit key: two n-grams of a block share one about as
seldom as the filter's own false hits allow for many times over.  The base score needs
exact counts of words; these are kept by their whole hashes, in the same blocks.

A pair's probability is its count over that of its first word, smoothed by PULL
pseudo-counts of the second word's own probability.

Texts are scored in batches of bounded size.  A batch asks each block once for all its
distinct n-grams, so that frequent words cost no more than rare ones, and the answers
come back to the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, Scratch, U, buckets, crc_mod, documents, importable, mix, pieces, words

END, BEGIN = U(0xE4D0F7E87), U(0xBE619C0DE)
PULL = 50.0
#: Bits of the filter for each insertion, and probes for each membership test.
PER, PROBES = 8, 3
#: Bytes of text to a hash block, and to a batch (a longer text alone).
BLOCK_BYTES, BATCH_BYTES = 16_000_000, 4_000_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, the hashes of each token with the one before, and where texts start."""
    h, _, at, _ = words(texts)
    out = np.insert(h, at[1:], END)
    starts = at + np.arange(len(at))
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1]] = BEGIN
    return out, mix(before * U(STEP) + mix(out)), starts


def summed(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often they occur (n times each)."""
    if n is None:
        x, n = np.unique(x, return_counts=True)
        return x, n.astype(np.int64)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(n, first) if len(x) else n


def small(n: np.ndarray) -> bytes:
    """Counts in 1, 4 or 8 bytes each."""
    most = n.max(initial=0)
    return n.astype("<u1" if most < 256 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def large(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {1: "<u1", 4: "<u4", 8: "<u8"}[len(b) // n] if n else "<u1").astype(np.int64)


def shut(x: np.ndarray) -> bytes:
    """Ascending 32-bit keys as compressed steps from one to the next, byte by byte of their places."""
    steps = np.diff(x.astype("<u4"), prepend=np.zeros(1, "<u4")).astype("<u4")
    return packed_bytes(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def opened(b: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked_bytes(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype="<u4")


def packed_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_bytes(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def key32(x: np.ndarray) -> np.ndarray:
    return (mix(x + U(STEP)) >> U(32)).astype("<u4")


def dealt(x: np.ndarray, parts: int) -> np.ndarray:
    """Of n-gram hashes: the block, and the key within it, as one number that sorts by block."""
    return (x % U(parts)) << U(32) | key32(x).astype(U)




def level(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


class Filter:
    """A log-frequency Bloom filter, whole or one block's part of it: bits, and where each block's begin and how many they are."""

    def __init__(self, bits: bytes, begins: np.ndarray, sizes: np.ndarray):
        self.bits, self.begins, self.sizes = np.frombuffer(bits, np.uint8), begins.astype(np.int64), sizes.astype(np.int64)

    @staticmethod
    def places(key: np.ndarray, q: int, size: np.ndarray | int) -> list[np.ndarray]:
        h = mix(key.astype(U) + U(q * STEP & 0xFFFFFFFFFFFFFFFF))
        step = (h >> U(32)) | U(1)
        return [(((h & U(0xFFFFFFFF)) + U(j) * step) % np.asarray(size).astype(U)).astype(np.int64) for j in range(PROBES)]

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray) -> "Filter":
        """The filter of one block."""
        q = level(count)
        size = -(-PER * int(q.sum()) // 8) * 8
        bits = np.zeros(size, bool)
        for i in range(1, int(q.max(initial=0)) + 1):
            for p in cls.places(key[q >= i], i, size):
                bits[p] = True
        return cls(np.packbits(bits, bitorder="little").tobytes(), np.zeros(1), np.array([size]))

    def levels(self, code: np.ndarray) -> np.ndarray:
        """The level of each n-gram's count, by what dealt() gives (or keys alone, of one block); 0 where the first probe misses."""
        block, key = (code >> U(32)).astype(np.int64), code & U(0xFFFFFFFF)
        q, alive = np.zeros(len(code), np.uint8), np.flatnonzero(self.sizes[block] > 0)
        for i in range(1, 64):
            if not len(alive):
                break
            b = block[alive]
            there = np.ones(len(alive), bool)
            for p in self.places(key[alive], i, self.sizes[b]):
                p += self.begins[b]
                there &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            q[alive] = i
        return q


MODEL = pa.schema([("block", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("size", pa.int64()), ("total", pa.int64()), ("kinds", pa.int64())])


def model_of(docs: DataFrame, parts: int) -> DataFrame:
    """(block, words, counts, bits, size, total, kinds), a row for each hash block: the exact counts of its words, and the filter of its words and pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def flush():
            one, two = (summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) for found in held)
            order = np.argsort(one[0] % U(parts), kind="stable")
            one = one[0][order], one[1][order]
            a, b = np.searchsorted(one[0] % U(parts), np.arange(parts + 1).astype(U)), np.searchsorted(two[0], np.arange(parts + 1).astype(U) << U(32))
            rows = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])).tolist()
            cut = lambda x, at, f: pa.array([f(x[at[i] : at[i + 1]]) for i in rows], pa.binary())
            raw = lambda x: x.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), cut(one[0], a, raw), cut(one[1], a, small), cut((two[0] & U(0xFFFFFFFF)).astype("<u4"), b, shut), cut(two[1], b, small)], names=["block", "words", "counts", "pairs", "times"])
            for found in held:
                found.clear()

        for batch in pieces(batches):
            one, two, _ = tokens(batch.column("text"))
            for found, x in zip(held, (one, dealt(two, parts)), strict=True):
                found.append(summed(x))
                size += len(found[-1][0])
            if size > 4_000_000:
                yield from flush()
                size = 0
        if held[0]:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [(np.zeros(0, t), np.zeros(0, np.int64)) for t in (U, "<u4")]
        held: list[list] = [[], []]

        def add(i: int):
            whole[i] = summed(np.concatenate([whole[i][0], *(h[0] for h in held[i])]), np.concatenate([whole[i][1], *(h[1] for h in held[i])]))
            held[i].clear()

        for batch in batches:
            for i, (x, n, t) in enumerate((("words", "counts", U), ("pairs", "times", "<u4"))):
                for k, c in zip(batch.column(x).to_pylist(), batch.column(n).to_pylist(), strict=True):
                    k = np.frombuffer(k, t) if t is U else opened(k)
                    held[i].append((k, large(c, len(k))))
                    if sum(len(h[0]) for h in held[i]) > max(1_000_000, len(whole[i][0])):
                        add(i)
        for i in (0, 1):
            add(i)
        (one, n), (two, m) = whole
        own = Filter.of(np.concatenate([key32(one), two]), np.concatenate([n, m]))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key[0].as_py(), one.tobytes(), small(n), own.bits.tobytes(), int(own.sizes[0]), int(n.sum()), len(n)), MODEL.types, strict=True)], schema=MODEL)

    counted = docs.select("doc_id", "text").mapInArrow(count, "block int, words binary, counts binary, pairs binary, times binary")
    return counted.groupBy("block").applyInArrow(merge, "block int, words binary, counts binary, bits binary, size long, total long, kinds long")


def expected(q: np.ndarray) -> np.ndarray:
    """About how often an n-gram of each level was counted."""
    return np.where(q > 0, 1.5 * 2.0 ** (q.astype(float) - 1) - 0.5 * (q == 1), 0.0)


def log_sums(c: np.ndarray, c2: np.ndarray, starts: np.ndarray, whole: float) -> np.ndarray:
    """Each text's sum of log10 of its tokens' probabilities, by the counts of the tokens and of their pairs with the ones before."""
    n = np.diff(starts)
    before = np.empty(len(c))
    before[1:] = c[:-1]
    before[starts[:-1]] = 0  # how often a text begins is not in the filter
    p = (c + 0.5) / whole
    p = (np.minimum(c2, before) + PULL * p) / (before + PULL)
    return np.bincount(np.repeat(np.arange(len(n)), n), np.log10(np.minimum(p, 1)), len(n))


def scored(docs: DataFrame, most_bits: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, token_score, n_elsewhere) of every row.

    Training documents are those whose crc32(doc_id) mod 5 is not 1.  token_score is
    score / n_tokens; n_elsewhere counts tokens whose pair with the one before the
    filter has more often than once (in a held-out text: at all), so that the pairs of
    a text that occurs twice are all in it.  A null or empty text is one end; rows
    without a doc_id are left out; rows that repeat are scored one by one, with equal
    results; without training documents all counts are 0; an empty table gives no
    rows; other columns are ignored.  Texts of any length are scored whole.
    """
    importable(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_scored(documents(docs), most_bits, scratch))


def _scored(d: DataFrame, most_bits: int, scratch: Scratch) -> DataFrame:
    spark = d.sparkSession
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(buckets(spark), -(-size // BLOCK_BYTES))
    model = scratch.keep(model_of(d.where(crc_mod() != 1), parts))
    sums = model.agg(F.sum("total"), F.sum("kinds"), F.sum("size")).first()
    N, V, bits = (x or 0 for x in sums)
    whole = N + 0.5 * (V + 1)
    shared = None
    if bits <= most_bits:
        begins, sizes, data = np.zeros(parts, np.int64), np.zeros(parts, np.int64), bytearray()
        for r in model.select("block", "bits", "size").toLocalIterator():
            begins[r["block"]], sizes[r["block"]] = 8 * len(data), r["size"]
            data += r["bits"]
        shared = spark.sparkContext.broadcast((bytes(data), begins, sizes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                out.write_batch(batch)
            blob = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)]), pa.array([blob], pa.binary())], names=["batch", "blob"])

    # the batches as they were first made: whoever reads them again finds the same ones
    packed = scratch.keep(d.select("doc_id", "text").mapInArrow(pack, "batch long, blob binary"))

    def grams(blob: bytes) -> tuple:
        """A batch's rows, where texts start, the distinct words and pairs (both sorted by block), and which each token is."""
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        one, two, starts = tokens(rows.column("text").combine_chunks())
        w, at = np.unique(one, return_inverse=True)
        order = np.argsort(w % U(parts), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, pair_at = np.unique(dealt(two, parts), return_inverse=True)
        return rows.column("doc_id").combine_chunks(), starts, w[order], rank[at], pairs, pair_at

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("batch").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                _, _, w, _, pairs, _ = grams(blob)
                if shared:
                    pairs = pairs[:0]
                a, b = np.searchsorted(w % U(parts), np.arange(parts + 1).astype(U)), np.searchsorted(pairs, np.arange(parts + 1).astype(U) << U(32))
                keys = (pairs & U(0xFFFFFFFF)).astype("<u4")
                blocks = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(blocks), pa.int64()), pa.array(blocks, pa.int32()), pa.array([w[a[i] : a[i + 1]].tobytes() for i in blocks], pa.binary()), pa.array([shut(keys[b[i] : b[i + 1]]) for i in blocks], pa.binary())], names=["batch", "block", "words", "pairs"])

    def look_up(key: tuple[pa.Scalar, ...], asked: pa.Table, part: pa.Table) -> pa.Table:
        there = part.num_rows > 0
        x = np.frombuffer(part.column("words")[0].as_py() if there else b"", U)
        n = large(part.column("counts")[0].as_py() if there else b"", len(x))
        own = Filter(part.column("bits")[0].as_py() if there else b"", np.zeros(1), np.array([part.column("size")[0].as_py() if there else 0]))
        out: dict[str, list] = {"counts": [], "levels": [], "pair_levels": []}
        for w, p in zip(asked.column("words").to_pylist(), asked.column("pairs").to_pylist(), strict=True):
            w, p = np.frombuffer(w, U), opened(p)
            at = np.minimum(np.searchsorted(x, w), max(0, len(x) - 1))
            out["counts"].append(packed_bytes((np.where(x[at] == w, n[at], 0) if len(x) else np.zeros(len(w))).astype("<u8").tobytes()))
            out["levels"].append(packed_bytes((np.zeros(0, np.uint8) if shared else own.levels(key32(w).astype(U))).tobytes()))
            out["pair_levels"].append(packed_bytes(own.levels(p.astype(U)).tobytes()))
        return pa.table({"batch": asked.column("batch"), "block": asked.column("block")} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    def score(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        said = {}  # batches that are equal asked the same
        for block, *found in zip(*(answers.column(c).to_pylist() for c in ("block", "counts", "levels", "pair_levels")), strict=True):
            said[block] = found
        counts, levels, pair_levels = (b"".join(unpacked_bytes(said[k][i]) for k in sorted(said)) for i in range(3))
        tables = []
        for blob in texts.column("blob").to_pylist():
            docs, starts, w, at, pairs, pair_at = grams(blob)
            n = np.diff(starts)
            row = np.repeat(np.arange(len(n)), n)
            exact = np.frombuffer(counts, "<u8").astype(np.int64)
            if shared:
                own = Filter(*shared.value)
                q, q2 = own.levels(dealt(w, parts)), own.levels(pairs)
            else:
                q, q2 = np.frombuffer(levels, np.uint8), np.frombuffer(pair_levels, np.uint8)
            held = np.array([_held_out(i) for i in docs.to_pylist()])
            total = log_sums(expected(q)[at], expected(q2)[pair_at], starts, whole)
            add = lambda x: np.bincount(row, x, len(n))
            tables.append(pa.table({"doc_id": docs, "n_tokens": n, "n_known": add(exact[at] > 0).astype(np.int64), "base_score": add(np.log10((exact + 0.5) / whole)[at]), "score": total, "n_elsewhere": add(q2[pair_at] + held[row] > 1).astype(np.int64)}))
        return pa.concat_tables(tables)

    asked = packed.mapInArrow(ask, "batch long, block int, words binary, pairs binary")
    need = model.select("block", "words", "counts", *([F.lit(b"").alias("bits"), F.lit(0).cast("long").alias("size")] if shared else ["bits", "size"]))
    answers = asked.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(look_up, "batch long, block int, counts binary, levels binary, pair_levels binary")
    out = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_elsewhere long")
    return out.select("doc_id", (crc_mod() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("token_score"), "n_elsewhere")


def _held_out(doc_id: int) -> bool:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """scored() of the whole table documents; see there for nulls, empty and repeated rows."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
