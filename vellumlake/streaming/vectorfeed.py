"""Vectors that follow the notes at their own pace.

Text is indexed at once; vectors come later, in a folder with a pointer of its own.  What
lacks a vector is asked of the tables themselves (chunks without a vector of their
present text), not of a queue, so a batch that died between the two is made good by the
next heal(), and heal() again changes nothing.  A search uses the vectors that are
there, and text alone where there are none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import vectors
from vellumlake.streaming.feed import to_embed
from vellumlake.streaming.tables import Tables

KEYS = {"vectors": "path"}
VECTORS = "path string, chunk_index int, content_hash string, embedding array<float>"
#: Texts of one call of the model.
BATCH = 16


def hashing_model(dims: int = 64, seed: int = 7) -> Callable[[list[str]], np.ndarray]:
    """A model without training: each word adds or takes one in a dimension, both by its hash; vectors have length one, an empty text's is 0."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(w, seed)
                out[i, h % dims] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embedded(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], batch: int = BATCH) -> DataFrame:
    """rows without text, with embedding: the model sees `batch` texts at a time; fewer vectors than texts are an error."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                got = model([x or "" for x in part.column(text).to_pylist()])
                if len(got) != part.num_rows:
                    raise ValueError(f"the model gave {len(got)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([list(map(float, v)) for v in got], pa.list_(pa.float32()))], names=[*kept, "embedding"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "embedding array<float>"]))


class VectorFeed:
    """Vectors of chunks (path, chunk_index, chunk_text, content_hash), in a folder of tables."""

    def __init__(self, tables: Tables, model: Callable[[list[str]], np.ndarray] | None = None):
        self.tables, self.model = tables, model or hashing_model()

    def vectors(self) -> DataFrame | None:
        return self.tables.read("vectors")

    def heal(self, chunks: DataFrame, batch_id: int, paths: DataFrame | None = None) -> dict[str, int]:
        """Embeds the chunks that lack a vector of their present text and drops the vectors of chunks that are gone; of `paths` alone, or of all.

        Returns how many rows came and went; where nothing did, only the pointer moves.
        """
        t = self.tables
        at = None if paths is None else t.touched("vectors", paths.select("path"))
        had = t.read("vectors", at) if at != [] else None
        had = t.spark.createDataFrame([], VECTORS) if had is None else had
        mine = chunks if paths is None else chunks.join(paths.select("path").distinct(), "path", "left_semi")
        key = ["path", "chunk_index", "content_hash"]
        mine = mine.select(F.col("path"), F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", "content_hash")
        missing = t.keep(embedded(to_embed(mine, had).select(*key, "chunk_text"), "chunk_text", self.model))
        stale = had if paths is None else had.join(paths.select("path").distinct(), "path", "left_semi")
        stale = t.keep(stale.join(mine, key, "left_anti").select(*key))
        n = {"embedded": missing.count(), "dropped": stale.count()}
        writes = {}
        if any(n.values()):
            changed = t.touched("vectors", missing.select("path").union(stale.select("path")))
            rows = (t.read("vectors", changed) if t.read("vectors") is not None else had).join(stale, key, "left_anti").unionByName(missing)
            writes["vectors"] = (rows, changed)
        t.commit(batch_id, writes)
        return n

    def nearest(self, query: str, k: int, where: Column | None = None) -> DataFrame | None:
        """(path, distance) of the k nearest chunks' notes, the best chunk of each; None where no vector is there, or the query holds no word."""
        have = self.vectors()
        q = self.model([query])[0]
        if have is None or have.isEmpty() or not np.any(q):
            return None
        hits = vectors.nearest(have, "embedding", [float(x) for x in q], k, ("path", "chunk_index"), "cosine", where)
        return vectors.best_of_each(hits, "path", ("chunk_index",)).select("path", "distance")


def hybrid(text_hits: DataFrame, near: DataFrame | None, limit: int = 20) -> DataFrame:
    """(path, score): both lists fused; text hits (path, score) by their own score where no vectors are there."""
    text = text_hits.orderBy(F.desc(F.round("score", 6)), "path").limit(vectors.candidates(limit))
    if near is None:
        return text.orderBy(F.desc(F.round("score", 6)), "path").limit(limit)
    both = vectors.fused([text, near], "path", [[F.desc("score"), F.col("path")], [F.col("distance"), F.col("path")]])
    return both.orderBy(F.desc(F.round("score", 6)), "path").limit(limit)
