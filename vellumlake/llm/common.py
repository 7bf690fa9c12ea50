"""Shared pieces: reading documents, bounded Arrow batches, hashes of words.

Words are maximal runs of bytes other than ASCII white space, with A-Z lowered;
both rules look at ASCII bytes only, so they work on UTF-8 without decoding.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 1_000_000
#: An odd multiplier, its inverse modulo 2**64, for hashes of byte strings.
STEP = 0x9E3779B97F4A7C15
UNSTEP = pow(STEP, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, *extra), without nulls in doc_id and text."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


#: For Python workers: freed arrays go back to the system at once.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and take little memory: Arrow batches of at most 1000 rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.sparkContext.environment.update(WORKER_ENV)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what spark.checkpoint.dir names; on one machine without it, one of our own."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator in the shared folder, where a lost executor leaves them whole.

    keep() computes a table once and returns it as read again; drop() deletes one that is
    no longer needed, and the end of the block deletes all but those of result().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            remove(self.spark, path)
        self.paths = {}

    def keep(self, df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        self.paths[id(out)] = path
        self._alive = [*getattr(self, "_alive", []), out]  # ids stay unique
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                remove(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as Parquet, so that later readers get only the columns that they use."""
    return _stored(df)[0]


#: Ids that are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", scratch: Scratch | None = None) -> DataFrame:
    """docs whose doc_id is in ids (or is not, with left_anti); the ids are counted, and broadcast only if they are few."""
    ids = (scratch.keep if scratch else written)(ids.where("doc_id is not null").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how).select([f"`{c}`" for c in docs.columns])


def buckets(spark: SparkSession) -> int:
    """Parts that a shuffle by hash is dealt into: the session's number, which is set for the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches, in slices with about limit bytes of text (a longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        lengths = np.fromiter((0 if x is None else x for x in pc.binary_length(col).to_pylist()), np.int64, len(col))
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, object]], schema: str, text: str | None = "text", limit: int = CHUNK_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow with f on slices of bounded size; f returns columns (arrays) of any equal length; done() is called at a task's end."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit, text) if text else batches:
            out = f(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))
        if done:
            done()

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64 for i < n at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, U(STEP)), np.full(size, U(UNSTEP))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 1 << 21:  # of a long text: not kept
            return up, down
        _powers[0] = have = (up, down)
    return have


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes with a line feed after each, and where each text starts (one entry more than texts)."""
    parts = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), starts


def words(texts: pa.Array, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: a hash of each word, the row of each word, first word of each row (one entry more than rows), and each word's first byte within its text.

    Without marks a word is a run of ASCII letters, digits and bytes of other characters.
    """
    data, starts = joined(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    lower = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
    if marks:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    else:
        inside = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))  # the last byte is white space
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((lower.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[last] - sums[first]) * down[first] + U(7) * (last - first).astype(U))
    row = np.searchsorted(starts, first, side="right") - 1
    return h, row, np.searchsorted(row, np.arange(len(starts))), first - starts[row]


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word runs; of all its words if they are fewer."""
    h, _, at, _ = words(texts)
    if len(h) >= n:
        runs = np.zeros(len(h) - n + 1, U)
        for i in range(n):
            runs = mix(runs * U(STEP) + h[i : len(h) - n + 1 + i])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            x = np.zeros(1, U)
            for i in range(a, b):
                x = mix(x * U(STEP) + h[i])
            out.append(mix(x + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_mod(doc_id: str = "doc_id", by: int = 5):
    """crc32 of the id as text, modulo by."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))
