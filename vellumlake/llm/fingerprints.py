"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph hashes to a wide vector and a document is the sum of its paragraphs'
vectors modulo powers of two.  So order does not matter, equal multisets have equal
sums, and a paragraph is put in or taken out by adding or subtracting its vector.

A vector has two parts.  IDENTITY lanes of 32 bits are hashes of the whole paragraph,
each pair of lanes with a seed of its own: they decide equality.  LIKENESS longs of two
counters each add up the hash bits of the paragraph's three-word runs, as a SimHash
does before it takes signs; runs count as often as they occur, whatever paragraph they
stand in, so these sums are homomorphic too.  The cosine of two such sums about their
means estimates the cosine of the documents' runs.

A fingerprint is the text of both: the identity lanes, and each counter about its mean
as one of 15 steps of the largest.  How alike two fingerprints are is computed from
what stands in them.

Only DataFrame functions run here, all of them on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

IDENTITY = 16
#: Longs of two counters each.
LIKENESS = 64
LOW = 0xFFFFFFFF
PAIR = 0x0000000100000001
#: Neighbouring ids that lie in one group when each document meets the next.
GROUP = 256


def features(text: Column) -> Column:
    """An array of (paragraph or null, hash of a three-word run or null) of one text; a paragraph is a line that is not blank."""
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)

    none = F.lit(None)

    def runs(words: Column) -> Column:
        whole = F.array(F.xxhash64(words))
        three = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.transform(F.when(F.size(words) < 3, whole).otherwise(three), lambda h: F.struct(none.cast("string").alias("p"), h.alias("h")))

    def of(p: Column) -> Column:
        words = F.transform(F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        # an array of one array, so that the words are computed once for all their runs
        return F.concat(F.array(F.struct(p.alias("p"), none.cast("long").alias("h"))), F.flatten(F.transform(F.array(words), runs)))

    return F.flatten(F.transform(paragraphs, of))


def sums() -> list[Column]:
    """The lanes, as sums over rows (p, h) of features()."""
    out = []
    for i in range(IDENTITY // 2):
        x = F.xxhash64(F.lit(i), "p")  # what comes first seeds the hash of what follows
        for half, part in ((0, x.bitwiseAND(F.lit(LOW))), (1, F.shiftrightunsigned(x, 32))):
            out.append(F.coalesce(F.sum(F.when(F.col("p").isNotNull(), part)), F.lit(0)).bitwiseAND(F.lit(LOW)).alias(f"i{2 * i + half}"))
    for i in range(LIKENESS):
        h = F.col("h") if i < 32 else F.col("g")
        out.append(F.coalesce(F.sum(F.shiftrightunsigned(h, i % 32).bitwiseAND(F.lit(PAIR))), F.lit(0)).alias(f"c{i}"))
    return out


def lanes() -> Column:
    return F.array(*[F.col(f"i{i}") for i in range(IDENTITY)], *[F.col(f"c{i}") for i in range(LIKENESS)], F.col("runs"))


def vectors(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and vector (array of long: lanes, then the number of runs) of each group of rows; texts of one group add up."""
    each = rows.select(*keys, F.explode_outer(features(F.col(text))).alias("f")).select(*keys, "f.p", "f.h")
    each = each.withColumn("g", F.when(F.col("h").isNotNull(), F.xxhash64("h")))
    return each.groupBy(*keys).agg(*sums(), F.count("h").alias("runs")).select(*keys, lanes().alias("vector"))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of a with the paragraphs of b put in (or, with sign -1, taken out)."""
    n = IDENTITY + LIKENESS
    wrap = lambda x, y, i: F.when(i < IDENTITY, (x + sign * y).bitwiseAND(F.lit(LOW))).otherwise(x + sign * y)
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.transform(F.slice(both, 1, n + 1), lambda z, i: wrap(z["x"], z["y"], i))


def counters(v: Column) -> Column:
    """The likeness counters about their means, as doubles; without runs all are 0."""
    runs = F.element_at(v, -1).cast("double")
    return F.transform(F.slice(v, IDENTITY + 1, LIKENESS), lambda c: F.struct((2 * c.bitwiseAND(F.lit(LOW)) - runs).alias("a"), (2 * F.shiftrightunsigned(c, 32) - runs).alias("b")))


def steps(v: Column) -> Column:
    """The counters about their means in 15 steps, -7 to 7, of the largest."""
    flat = F.flatten(F.transform(counters(v), lambda s: F.array(s["a"], s["b"])))

    def scaled(every: Column) -> Column:
        # an array of one, so that the largest is found once and not for each counter
        largest = F.array(F.array_max(F.transform(every, lambda x: F.abs(x))))
        return F.element_at(F.transform(largest, lambda most: F.transform(every, lambda x: F.when(most == 0, 0).otherwise(F.round(7 * x / most)).cast("int"))), 1)

    # an array of one array, so that the counters are computed once
    return F.element_at(F.transform(F.array(flat), scaled), 1)


def digest(v: Column) -> Column:
    """The fingerprint: the identity lanes in hexadecimal, then a digit for each counter, 7 being its mean."""
    ident = F.array_join(F.transform(F.slice(v, 1, IDENTITY), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    return F.concat(ident, F.array_join(F.transform(steps(v), lambda s: F.lower(F.hex((s + 7).cast("long")))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: 1 for equal ones, else the cosine of their counters, where positive; 0 where one has no runs."""
    digits = lambda f: F.transform(F.slice(F.split(F.substr(f, F.lit(8 * IDENTITY + 1)), ""), 1, 2 * LIKENESS), lambda c: F.instr(F.lit("0123456789abcde"), c) - 8)

    def cosine(z: Column) -> Column:
        dot = lambda p, q: F.aggregate(z, F.lit(0), lambda t, s: t + s[p] * s[q])
        size = F.sqrt((dot("x", "x") * dot("y", "y")).cast("double"))
        return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot("x", "y") / size)))

    both = F.zip_with(digits(a), digits(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(a == b, 1.0).otherwise(F.element_at(F.transform(F.array(both), cosine), 1))


def following(ids: DataFrame, bits: int = 16) -> DataFrame:
    """(id, next): for each distinct id the next smaller one, after the smallest the largest (one row, which is joined to all).

    Ids are ranked in groups of 2**bits neighbours; only the last of a group needs
    the first of the next, which is found the same way among groups.
    """
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("id"))

    def within(rows: DataFrame, left: int) -> DataFrame:
        if left <= bits:
            return rows.select("id", F.lead("id").over(w()).alias("next"))
        rows = rows.withColumn("group", F.shiftright("id", bits))
        near = rows.select("group", "id", F.lead("id").over(w("group")).alias("next"))
        firsts = rows.groupBy("group").agg(F.max("id").alias("first"))
        groups = within(firsts.select(F.col("group").alias("id")), left - bits).withColumnRenamed("id", "group")
        far = groups.join(firsts.select(F.col("group").alias("next"), "first"), "next").select("group", "first")
        out = near.join(far, "group", "left")
        return out.select("id", F.coalesce("next", "first").alias("next"))

    ids = ids.distinct()
    top = ids.agg(F.max("id").alias("top"))
    return within(ids, 64).join(F.broadcast(top)).select("id", F.coalesce("next", "top").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document, by descending doc_id, after the last the
    first.  Rows that repeat a doc_id are documents of their own, ordered by text; a
    null text is empty, and an empty text stays empty; rows without a doc_id are left
    out; an empty table gives no rows; texts of any length are taken whole; other
    columns are ignored.
    Result: doc_id, n_chars, edited_sha256, vector, edited_vector, next_vector.

    Documents meet in groups of GROUP neighbouring ids, to each of which the first
    document of the next group comes as a guest, so each text moves once.
    """
    d = documents(docs).withColumn("group", F.shiftright("doc_id", GROUP.bit_length() - 1))
    firsts = written(d.groupBy("group").agg(F.max("doc_id").alias("first")))
    after = following(firsts.select(F.col("group").alias("id")))
    guests = written(after.select(F.col("id").alias("host"), F.col("next").alias("group")).join(firsts, "group").select("host", F.col("first").alias("doc_id")))
    guests = d.select("doc_id", "text").join(guests, "doc_id").select(F.col("host").alias("group"), "doc_id", "text", F.lit(True).alias("guest"))
    rows = d.select("group", "doc_id", "text", F.lit(False).alias("guest")).union(guests)
    order = Window.partitionBy("group").orderBy("guest", F.desc("doc_id"), "text")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("then"), F.char_length("text").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("then", half))
    # of the guests the first is enough
    rows = rows.select("group", "guest", "doc_id", "place", "n_chars", "text", F.when(~F.col("guest"), edited).alias("edited"))
    keys = ["group", "guest", "doc_id", "place", "n_chars", "edited_sha256", "which"]
    both = F.filter(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))), lambda s: s["text"].isNotNull())
    each = rows.select("group", "guest", "doc_id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(both).alias("s")).select("group", "guest", "doc_id", "place", "n_chars", "edited_sha256", "s.which", "s.text")
    v = vectors(each, keys)
    one = v.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("which") == 0, F.col("vector"))).alias("vector"), F.max(F.when(F.col("which") == 1, F.col("vector"))).alias("edited_vector"))
    step = Window.partitionBy("group").orderBy("place")
    one = one.withColumn("next_vector", F.lead("vector").over(step)).where(~F.col("guest"))
    return one.select("doc_id", "n_chars", "edited_sha256", "vector", "edited_vector", "next_vector")


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """edited_fingerprints() of the whole table documents, as text; see there for nulls, empty and repeated rows."""
    v = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    f = v.select("doc_id", "n_chars", "edited_sha256", digest(F.col("vector")).alias("fingerprint"), digest(F.col("edited_vector")).alias("edited_fingerprint"), digest(F.col("next_vector")).alias("next_fingerprint"))
    return f.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
