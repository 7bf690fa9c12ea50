"""A stored full-text index, so that a search reads the few terms that it asks for.

build() writes two tables: `postings`, a row for each stem and note and one of the empty
stem with each note's length, dealt by a hash of the stem into folders (bucket=...) and sorted by it, and `corpus`, one row with the number
of notes and their average length.  A search names its buckets and stems as literals, so
the scan opens a few folders and skips what lies between; scores need nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions.stems import marks, stem
from vellumlake.operators.fulltext import B, FLOOR, K1, parse_query, tokens
from vellumlake.sources.store import small_batches

#: Folders that stems are dealt into.
BUCKETS = 64


def plain_tokens(text: Column) -> Column:
    """Lower-case words, Latin letters without their marks; a text of ASCII alone has none."""
    lower = F.lower(text)
    return tokens(F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.translate(lower, *marks())))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bounded(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in slices with about so many words (a longer note alone)."""
    for batch in batches:
        ends = batch.column("words").offsets.to_numpy()[1:].astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else batch.column("words").offsets[0].as_py()
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def postings(notes: DataFrame, text: Column, key: str = "path", with_lengths: bool = False) -> DataFrame:
    """(term, key, tf, dl, places): for each stem of each note how often and where it stands, and the note's length in words.

    A null text has no words; rows that repeat a key are notes of their own.  With
    lengths, each note has a row with its length for the term "" too, words or none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words = batch.column("words")
            if with_lengths and len(words):
                yield pa.RecordBatch.from_arrays([pa.array([""] * len(words)), batch.column(key), pa.array(np.zeros(len(words), np.int32)), pa.array(np.diff(words.offsets.to_numpy()).astype(np.int32)), pa.array([[]] * len(words), pa.list_(pa.int32()))], names=["term", key, "tf", "dl", "places"])
            if not len(words) or not len(words.flatten()):
                continue
            sizes = np.diff(words.offsets.to_numpy())  # flatten() holds what the offsets of a slice span
            coded = words.flatten().dictionary_encode()
            # as objects: an array of fixed width would be as wide as the longest word
            stems, of = np.unique(np.array([stem(w) for w in coded.dictionary.to_pylist()], object), return_inverse=True)
            term, row = of[coded.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((place, term, row))
            term, row, place = term[order], row[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1]))))
            tf = np.diff(np.append(first, len(term)))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()).take(pa.array(term[first])), batch.column(key).take(pa.array(row[first])), pa.array(tf, pa.int32()), pa.array(sizes[row[first]], pa.int32()), places], names=["term", key, "tf", "dl", "places"])

    small_batches(notes.sparkSession)
    kind = dict(notes.dtypes)[key]
    return notes.select(key, plain_tokens(text).alias("words")).mapInArrow(run, f"term string, `{key}` {kind}, tf int, dl int, places array<int>")


def build(notes: DataFrame, text: Column, folder: str, key: str = "path", buckets: int = BUCKETS) -> None:
    """Writes the index of notes to folder; a bucket with a stem that most notes have is split over several files."""
    rows = postings(notes, text, key, with_lengths=True).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    # the lengths are postings of the empty term, so no text is read again
    lengths = notes.sparkSession.read.schema(rows.schema).parquet(f"{folder}/postings").where((F.col("bucket") == bucket_of(F.lit(""), buckets)) & (F.col("term") == ""))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/corpus")


def parts_of(query: str, any_term: bool) -> tuple[list[list[str]], list[str]]:
    """The stems of each part of a query, and all of them."""
    parts = [[stem(w) for w in part] for part in parse_query(query, any_term)]
    return parts, sorted({w for part in parts for w in part})


def scored(rows: DataFrame, parts: list[list[str]], asked: list[str], n: float, average: float, key: str = "path", any_term: bool = False) -> DataFrame:
    """(key, score) of the postings of the asked stems: notes that match all parts (any, with any_term), and their BM25 among n notes of average length."""
    notes = rows.groupBy(key).agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{i}") for i, w in enumerate(asked)])
    at = {w: F.col(f"p{i}") for i, w in enumerate(asked)}

    def frequency(part: list[str]) -> Column:
        hits = F.filter(at[part[0]], lambda x: reduce(lambda a, b: a & b, [F.array_contains(at[w], x + j) for j, w in enumerate(part[1:], 1)], F.lit(True)))
        return F.greatest(F.lit(0), F.coalesce(F.size(hits if len(part) > 1 else at[part[0]]), F.lit(0)))

    counted = notes.select(key, "dl", *[frequency(p).alias(f"f{i}") for i, p in enumerate(parts)])
    if not parts:
        return counted.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    stats = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(parts))])
    hit = reduce((lambda a, b: a | b) if any_term else (lambda a, b: a & b), [F.col(f"f{i}") > 0 for i in range(len(parts))])

    def weight(i: int) -> Column:
        df, f = F.col(f"df{i}"), F.col(f"f{i}")
        idf = F.greatest(F.lit(FLOOR), F.log((n - df + 0.5) / (df + 0.5)))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / average))

    score = reduce(lambda a, b: a + b, map(weight, range(len(parts))))
    return counted.where(hit).join(F.broadcast(stats)).select(key, score.alias("score"))  # one row of statistics


def search(spark: SparkSession, folder: str, query: str, key: str = "path", any_term: bool = False) -> DataFrame:
    """(key, score): the notes that match all parts of the query (any, with any_term), words by their stems, and their BM25."""
    corpus = spark.read.parquet(f"{folder}/corpus").first()  # one row
    parts, asked = parts_of(query, any_term)
    dealt = [r[0] for r in spark.createDataFrame([(w,) for w in asked], "term string").select(bucket_of(F.col("term"), corpus["buckets"])).distinct().collect()] if asked else []
    rows = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(dealt) & F.col("term").isin(asked))
    return scored(rows, parts, asked, corpus["n"], corpus["average"], key, any_term)
