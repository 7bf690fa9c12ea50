"""Phrase collocations: frequent word runs within pieces of text, scored by their weakest cut.

Identical pieces are one row with a multiplicity.  Runs of 1 to 4 words are counted level
by level: tasks add up what their pieces hold, rows are dealt by a hash of the run, and
each bucket is counted out-of-core in duckdb, which keeps what reaches the least
frequency.  A run is only proposed where the two runs within it, each shorter by a word,
may be frequent: a bit for each hash of those, in a filter of a fixed size, says so.  It
spares rows alone; what it lets pass is counted exactly, on words and not on hashes.

Counts stay where they are: candidates ask for their parts by requests that a shuffle
leads to the part's count, and answers go back by candidate.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP, Scratch, U, buckets, importable, mix, signed, words

#: Words of the longest phrase.
LONGEST = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter: 8 MB at any size of the input.
FILTER_BITS = 1 << 26
#: Text that a task counts at once, and memory of one bucket's count; what goes beyond it is spilled by duckdb.
TASK_BYTES, BUCKET_MEMORY = 4_000_000, "300MB"
RUN = "lang string, phrase string, f long"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): each different piece of a language, as words with one space between, and how often it occurs."""
    given = F.coalesce("text", F.lit(""))
    # of ASCII alone, lower() does the same and is faster
    text = F.when(F.octet_length(given) == F.char_length(given), F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    each = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "[.,;:!?\n\x0b\f\r]")).alias("piece"))
    ragged = F.contains("piece", F.lit("\t")) | F.contains("piece", F.lit("  "))
    plain = F.trim(F.when(ragged, F.regexp_replace("piece", "[ \t]+", " ")).otherwise(F.col("piece")))
    return each.select("lang", plain.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of batches in tables with about limit bytes of text (one longer text alone)."""
    have, size = [], 0
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else []
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(batch.num_rows, max(at + (not have), int(np.searchsorted(ends, before + limit - size, "right"))))
            if stop > at:
                have.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1] - before)
            if stop < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(have).combine_chunks()
                have, size = [], 0
            at = stop
    if have:
        yield pa.Table.from_batches(have).combine_chunks()


def coded(table: pa.Table, column: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a table's texts: the different words, their number at each place, the row of each place, and the first place of each row (one entry more)."""
    parts = pc.split_pattern(table[column].combine_chunks(), " ")
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    starts = parts.offsets.to_numpy().astype(np.int64)
    code = parts.flatten().dictionary_encode()
    return code.dictionary, code.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(parts)), np.diff(starts)), starts - starts[0]


def hashes(dictionary: pa.Array, place: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, and of their language; for places where n words follow."""
    h = words(dictionary)[0] if len(dictionary) else np.zeros(0, U)
    return chained(h[place], lang, n)


def chained(h: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    out = lang[: len(h) - n + 1].copy()
    for i in range(n):
        out = mix(out * U(STEP) + h[i : len(h) - n + 1 + i])
    return out


def lang_hashes(langs: pa.ChunkedArray) -> np.ndarray:
    """A hash of each row's language."""
    code = pc.dictionary_encode(langs.combine_chunks())
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    each = np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ len(x) for x in code.dictionary.to_pylist()], U)
    return mix(each[code.indices.to_numpy()]) if len(each) else np.zeros(0, U)


def runs_of(table: pa.Table, n: int, passes: Callable[[np.ndarray], np.ndarray] | None) -> pa.RecordBatch | None:
    """(lang, phrase, f): each different run of n words of the table's pieces whose parts pass, and how often it occurs."""
    dictionary, code, row, starts = coded(table, "piece")
    if len(code) < n:
        return None
    m = table["m"].to_numpy()
    inside = np.arange(len(code) - n + 1)
    inside = inside[row[: len(code) - n + 1] == row[n - 1 :]]
    if passes is not None:
        good = passes(hashes(dictionary, code, lang_hashes(table["lang"])[row], n - 1))
        inside = inside[good[inside] & good[inside + 1]]
    if not len(inside):
        return None
    langs = pc.dictionary_encode(table["lang"].combine_chunks())
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    key = langs.indices.to_numpy().astype(np.int64)[row[inside]]
    for i in range(n):  # numbers of different runs, word by word: exact, and below 2**31
        _, first, key = np.unique((key << 32) | code[inside + i], return_index=True, return_inverse=True)
    at = inside[first]
    f = np.zeros(len(first), np.int64)
    np.add.at(f, key, m[row[inside]])
    phrase = dictionary.take(pa.array(code[at]))
    if n > 1:
        phrase = pc.binary_join_element_wise(phrase, *[dictionary.take(pa.array(code[at + i])) for i in range(1, n)], " ")
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(langs.indices.to_numpy()[row[at]])), phrase, pa.array(f)], names=["lang", "phrase", "f"])


def proposed(rows: DataFrame, n: int, bits=None) -> DataFrame:
    """(lang, phrase, f) of all runs of n words of (lang, piece, m) that the filter lets pass, added up within tasks; of single words also all together, as the phrase ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bits.value if bits is not None else None
        passes = (lambda h: (filter_[(h >> U(6)) & U(len(filter_) - 1)] >> (h & U(63))) & U(1) == 1) if filter_ is not None else None
        for table in gathered(batches, "piece", TASK_BYTES):
            out = runs_of(table, n, passes)
            if out is None:
                continue
            yield out
            if n == 1:
                by = pa.Table.from_batches([out]).group_by("lang").aggregate([("f", "sum")])
                yield pa.RecordBatch.from_arrays([by["lang"].combine_chunks(), pa.array([""] * len(by)), by["f_sum"].combine_chunks()], names=["lang", "phrase", "f"])

    return rows.mapInArrow(run, RUN)


def counted(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) with the sums of f that reach `least`, and of "" all: each bucket of a hash of the run is counted out-of-core.

    What a bucket spills lies in the task's own temporary folder, which goes with it; no
    other task reads it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        with tempfile.TemporaryDirectory(prefix="runs-") as spill, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "temp_directory": spill, "threads": 1, "preserve_insertion_order": False}) as db:
            rows = pa.RecordBatchReader.from_batches(kind, (b.cast(kind) for b in batches))
            db.register("rows", rows)
            found = db.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM rows GROUP BY lang, phrase HAVING sum(f) >= {least} OR phrase = ''")
            yield from found.to_arrow_reader(100_000)

    return rows.repartition(buckets(rows.sparkSession), "lang", "phrase").mapInArrow(count, RUN)


def bits_of(runs: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """The filter: a bit for the hash of each run, in size / 64 words; that many rows at most reach the driver, whatever the input."""

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "phrase", TASK_BYTES):
            dictionary, code, row, starts = coded(table, "phrase")
            w, lang = words(dictionary)[0][code], lang_hashes(table["lang"])
            n = int(starts[1] - starts[0])  # all runs of a level have as many words
            h = chained(w, lang[row], n)[::n]
            place = (h >> U(6)) & U(size // 64 - 1)
            order = np.argsort(place)
            first = np.flatnonzero(np.concatenate(([True], np.diff(place[order]) != 0)))
            bits = np.bitwise_or.reduceat(U(1) << (h[order] & U(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(signed(place[order][first])), pa.array(signed(bits))], names=["place", "bits"])

    found = runs.select("lang", "phrase").mapInArrow(ones, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, U)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def frequent_runs(scratch: Scratch, rows: DataFrame, least: int) -> list[DataFrame]:
    """(lang, phrase, f) of the runs of 1, 2, ... words that occur at least so often; with the words comes "", which counts them all."""
    context = importable(rows.sparkSession).sparkContext
    out: list[DataFrame] = []
    for n in range(1, LONGEST + 1):
        bits = context.broadcast(bits_of(out[-1].where("phrase <> ''"))) if out else None
        # few rows are left of a bucket: files go by size and not by bucket, as an executor starts three processes for each
        out.append(scratch.keep(counted(proposed(rows, n, bits), least).hint("rebalance", "lang", "phrase")))
        if bits is not None:
            bits.unpersist()
    return out


def first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)



def weakest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, f, l, r, score) of candidates (lang, phrase, f, n): each asks for both parts of its cuts, and the lowest score counts, of equals the first cut's.

    A part that many candidates ask for is one row of counts, whose requests a skewed join may split.
    """
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), first_words(F.col("phrase"), k).alias("left"), last_words_from(F.col("phrase"), k).alias("right")) for k in range(1, LONGEST)]), lambda c: c["k"] < F.col("n"))
    each = candidates.select("lang", "phrase", "f", F.explode(cuts).alias("c")).select("lang", "phrase", "f", "c.*")
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("part")), F.struct(F.lit("r").alias("side"), F.col("right").alias("part")))
    asked = each.select("lang", F.col("phrase").alias("whole"), F.col("f").alias("a"), "k", F.explode(sides).alias("s")).select("lang", "whole", "a", "k", "s.*")
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cut = told.groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cut = cut.withColumn("score", F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    return cut.groupBy("lang", F.col("whole").alias("phrase"), F.col("a").alias("f")).agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "f", "c.l", "c.r", "c.score")


def last_words_from(phrase: Column, k: int) -> Column:
    """What follows the first k words."""
    return F.substr(phrase, F.char_length(first_words(phrase, k)) + 2)


def kept(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one contains with at least so many hundredths of their frequency."""
    phrase, n = F.col("phrase"), F.col("n")
    within = [(first_words(last_words_from(phrase, a) if a else phrase, size), a + size) for size in range(2, LONGEST) for a in range(LONGEST - size + 1)]
    inner = F.filter(F.array_distinct(F.array(*[F.when((end <= n) & (size < n), p) for (p, end), size in zip(within, [s for s in range(2, LONGEST) for _ in range(LONGEST - s + 1)], strict=True)])), lambda p: p.isNotNull())
    most = candidates.where("n > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (exact("longest") * 100 < exact("f") * percent)).drop("longest")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A null text has no words, and a null language is "und"; rows that repeat count each;
    phrases with equal score and frequency go by their bytes; a text or piece of any
    length is taken whole; a language without candidates, and an empty table, give no
    rows; doc_id is not asked for; other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(pieces(docs))
        levels = frequent_runs(scratch, rows, least)
        scratch.drop(rows)
        candidates = None
        for n, level in enumerate(levels[1:], 2):
            level = level.withColumn("n", F.lit(n))
            candidates = level if candidates is None else candidates.unionByName(level)
        counts = levels[0]
        for level in levels[1:-1]:
            counts = counts.unionByName(level)
        scored = scratch.keep(weakest_cuts(kept(candidates, percent), counts))
        order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
        # a bounded number of rows of each language meets in one task
        some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        total = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
        out = best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
        return scratch.result(out)


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """collocations() of the whole table documents; see there for nulls, empty and repeated rows."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB: all runs, counted at once.
SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inner_ AS (SELECT DISTINCT lang, phrase, a, array_to_string(w[i : i + s - 1], ' ') AS part FROM c, (SELECT unnest([2, 3]) AS s), (SELECT unnest([1, 2, 3]) AS i) WHERE s < k AND i + s - 1 <= k),
longest AS (SELECT lang, part, max(a) AS a FROM inner_ GROUP BY ALL),
left_ AS (SELECT c.* FROM c LEFT JOIN longest b ON b.lang = c.lang AND b.part = c.phrase WHERE b.a IS NULL OR 100 * b.a < 80 * c.a),
halves AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM left_ CROSS JOIN (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scores AS (
  SELECT h.lang, h.phrase, h.a, h.j, x.f AS l, y.f AS r, (2000000 * h.a) // (x.f + y.f) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.tail),
cuts AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cuts WHERE o = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
