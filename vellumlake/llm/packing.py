"""Best-fit decreasing packing of tokenized documents into fixed windows.

Documents are cut into full windows first; what is left of each (shorter than a
window) goes by best fit, longest first: a segment tree over remaining capacities
finds the open window with the least room that still holds the piece.  Packing
works on groups of a fixed number of tokens, dealt by a hash, so that any number
of documents packs in parallel; each group leaves part of one window or so empty.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, importable, mapped

#: White space to every tokenizer here; texts are cut there before words are looked up.
SPACE = " \t\n\r"
_encoders: dict[str, "WordCache"] = {}


class WordCache:
    """Token ids of texts, word by word, for a tokenizer whose tokens never span white space.

    Its normalizer and splitter treat white-space-separated words independently, so
    ids of a text are the ids of its words in order; each worker remembers the words
    it has seen, up to a bound.  A word of letters and ASCII marks after them is two
    parts to the splitter, so its letters are looked up without the marks.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the tokenizer cuts its added tokens out of a text before it looks at words
        added = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.keep, self.known, self.cores = keep, {}, {}

    @classmethod
    def at(cls, path: str) -> "WordCache":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        """Lets go of the words seen, which an idle worker would hold beside the next stages."""
        self.known, self.cores = {}, {}

    def encode(self, text: str) -> np.ndarray:
        if self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        for c in SPACE[1:]:
            text = text.replace(c, " ")
        words = text.split(" ")
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                new = set(words)
            odd = []
            for w in new:
                core = w.rstrip(string.punctuation)
                if core.isalpha() and (core.isascii() or core == core.lower() and unicodedata.is_normalized("NFC", core)):
                    known[w] = self.letters(core.lower()) + (self.tail(w[len(core) :]) if len(core) < len(w) else b"")
                elif w:
                    odd.append(w)
                else:
                    known[w] = b""
            for i in range(0, len(odd), 4096):
                for w, e in zip(odd[i : i + 4096], self.tokenizer.encode_batch_fast(odd[i : i + 4096], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")

    def letters(self, core: str) -> bytes:
        """Ids of lower-case letters in normal form, which the splitter leaves in one part."""
        got = self.cores.get(core)
        if got is None:
            if len(self.cores) > self.keep:
                self.cores.clear()
            part = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTES)
            got = self.cores[core] = struct.pack(f"<{len(t := self.model.tokenize(part))}I", *[x.id for x in t])
        return got

    def tail(self, marks: str) -> bytes:
        got = self.cores.get(marks)
        if got is None:
            got = self.cores[marks] = np.array(self.tokenizer.encode(marks, add_special_tokens=False).ids, "<u4").tobytes()
        return got


#: The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the rest follow from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: i + 256 for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut into full windows and a rest."""
    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        coder = WordCache.at(tokenizer)
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(coder.encode(text), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                for column, x in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                    column.append(x)
        return {k: pa.array(x, pa.int64()) for k, x in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), out, strict=True)}

    return mapped(documents(docs), cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", done=lambda: WordCache.at(tokenizer).forget())


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, in the order given (longest first).

    The segment tree has a leaf for each remaining capacity and counts its open
    windows; the leftmost occupied leaf at or beyond the length is the best fit.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    rooms: list[list[int]] = [[] for _ in range(size)]
    where, offsets, opened = [], [], 0
    for length in lengths.tolist():
        i = size + length
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up until a right sibling is occupied
                i >>= 1
            if i > 1:
                i += 1
                while i < size:  # down to its leftmost leaf
                    i = 2 * i if tree[2 * i] else 2 * i + 1
        if i > 1:
            room = i - size
            number = rooms[room].pop()
            while i:
                tree[i] -= 1
                i >>= 1
        else:
            room, number, opened = window, opened, opened + 1
        where.append(number)
        offsets.append(window - room)
        left = room - length
        if left:
            rooms[left].append(number)
            i = size + left
            while i:
                tree[i] += 1
                i >>= 1
    return np.array(where, np.int64), np.array(offsets, np.int64)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, group_tokens: int = 1 << 24, group_pieces: int = 1 << 18) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Empty texts are a piece of the end id alone; an empty table packs into no rows;
    rows that repeat a doc_id are packed one by one.  Pieces of equal length go by
    doc_id and start.  A group holds about group_tokens tokens and group_pieces pieces
    at most, whatever the input.  A null text is empty; rows without a doc_id are left
    out; a text of any length is cut whole; other columns are ignored.
    """
    importable(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_packed(docs, tokenizer, end_id, window, group_tokens, group_pieces, scratch))


def _packed(docs: DataFrame, tokenizer: str, end_id: int, window: int, group_tokens: int, group_pieces: int, scratch: Scratch) -> DataFrame:
    cut = scratch.keep(token_pieces(docs, tokenizer, end_id, window))
    rest = cut.where(F.col("length") < window)
    total, count = rest.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total or 0) // group_tokens), -(-count // group_pieces))

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit(table.column("length").to_numpy(), window)
        table = table.drop_columns(["group"]).append_column("sequence_id", pa.array(number * groups + key[0].as_py())).append_column("offset", pa.array(offset))
        yield from table.to_batches()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # dealt by where a row stands in the written table, so that equal rows spread too
    left = rest.withColumn("group", F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(groups)))
    left = left.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "group").groupBy("group").applyInArrow(pack, schema)
    # full windows take the negative numbers, one for each: -1 - (a number of the row, which a scan of the written table gives again if it is repeated)
    full = cut.where(F.col("length") == window).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return left.union(full.select(left.columns))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """packed() of the whole table documents; see there for nulls, empty and repeated rows."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
