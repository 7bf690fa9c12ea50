"""Secret scans with multipart credential linking.

Strong patterns report by themselves.  Weak parts (logins, endpoints, random-looking
strings without a name) report only when an interval join finds a complementary
part near them in the same scope: a secret near who or where it is for.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, mapped

#: The patterns of the strong kinds, with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "login", "endpoint", "random")
LOGIN = re.compile(r"""(?<![A-Za-z0-9])(?<!secret_)(?<!secret-)(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}", re.A)
#: Whole runs of at least 20 characters with a letter and a digit; '=' may come before one, but a run with '=' and more after it is a name.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", re.A)
SCOPE = re.compile(r"\n[ \t]*\n")
#: What a part is to a credential.
ROLE = {"assign": "secret", "hex": "secret", "random": "secret", "access": "who", "login": "who", "endpoint": "where"}
SPAN = "array<struct<kind:string,start:long,end:long,scope:long>>"


def covered(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that spans cover, in order, none overlapping another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def parts(text: str) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, int, int, int]]]:
    """The strong and the weak parts of one text: (kind, start, end, scope), scopes being what blank lines part."""
    strong = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        strong += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "=" in text or ":" in text:
        strong += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        weak = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
        weak += [("login", m.start(), m.end()) for m in LOGIN.finditer(text)]
    else:
        weak = []
    if weak or any(k == "access" for k, _, _ in strong):  # a nameless string needs a who or where
        taken = covered((a, b) for _, a, b in strong)
        begins = [a for a, _ in taken]
        for m in RANDOM.finditer(text):
            i = bisect.bisect_left(begins, m.end())  # of the runs that begin before its end the last ends last
            if not i or taken[i - 1][1] <= m.start():
                weak.append(("random", m.start(), m.end()))
    if not strong and not weak:
        return [], []
    cuts = np.array([m.start() for m in SCOPE.finditer(text)], np.int64)
    put = lambda found: [(k, a, b, int(np.searchsorted(cuts, a, "right"))) for k, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))]
    return put(strong), put(weak)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, strong, weak): all parts of each row."""

    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        found = [parts(x) for x in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))
        rows = lambda i: pa.array([[dict(zip(("kind", "start", "end", "scope"), x, strict=True)) for x in f[i]] for f in found], kind)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "strong": rows(0), "weak": rows(1)}

    return mapped(documents(docs).withColumn("text_hash", F.xxhash64("text")), scan, f"doc_id long, text_hash long, strong {SPAN}, weak {SPAN}")


def linked(scan: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_hash, links): the weak parts that a complementary part lies near, at most reach characters away in the same scope.

    The interval join deals parts by text, scope and stretch of reach characters; a
    part lies in its own stretches and the next, so a long text with many parts is
    spread over many small groups.
    """
    keys = ["doc_id", "text_hash"]
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    some = scan.where(F.size("weak") > 0).dropDuplicates(keys)
    each = some.select(*keys, F.explode(F.concat("strong", "weak")).alias("p")).select(*keys, "p.*").withColumn("role", role[F.col("kind")])
    stretch = lambda c: F.floor(c / reach)
    x = each.where(F.col("kind").isin("login", "endpoint", "random")).withColumn("bin", F.explode(F.sequence(stretch(F.col("start") - reach), stretch(F.col("end") + reach)))).alias("x")
    y = each.withColumn("bin", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end"))))).alias("y")
    same = F.lit(True)
    for k in [*keys, "scope", "bin"]:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    near = (F.col("x.start") <= F.col("y.end") + reach) & (F.col("y.start") <= F.col("x.end") + reach)
    whole = F.when(F.col("x.role") == "secret", F.col("y.role") != "secret").otherwise(F.col("y.role") == "secret")
    hits = x.join(y, same & near & whole, "left_semi").select(*keys, "kind", "start", "end", "scope").distinct()
    return hits.groupBy(*keys).agg(F.collect_list(F.struct("kind", "start", "end", "scope")).alias("links"))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, text_hash, base, spans): the strong parts of each row, and all reported parts, as arrays of (kind, start, end, scope) in code points.

    A null or empty text has none; rows without a doc_id are left out; rows that repeat
    a doc_id are scanned each by itself; parts that start together go by kind as
    KINDS lists them; texts of any length are scanned whole; an empty table gives no
    rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        scan = scratch.keep(scanned(docs))
        out = scan.join(linked(scan, reach), ["doc_id", "text_hash"], "left")
        return scratch.result(out.select("doc_id", "text_hash", F.col("strong").alias("base"), F.concat("strong", F.coalesce("links", F.array().cast(SPAN))).alias("spans")))


def masked(docs: DataFrame, reach: int = 200, mask: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced by mask, and n_chars (if there) counted anew; other columns, and rows without spans, stay as they are."""
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    key, text_hash, spans = free + "id", free + "hash", free + "spans"
    found = secrets(docs, reach).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans))

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None:
                return text
            out, at = [], 0
            for a, b in sorted((s["start"], s["end"]) for s in found):
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join(out) + text[at:]

        return texts.combine(spans, one)

    both = docs.join(found, (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cover("text", spans))
    fresh = {"text": text} | ({"n_chars": F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return both.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    """secrets() of the whole table documents; see there for nulls, empty and repeated rows."""
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
