"""A Merkle manifest of a dataset: a tree of digests for each language, and one over them.

Leaves get their places by ranges of (tree, order), so that no task sees a whole tree.
Aligned blocks of FANOUT ** HEIGHT nodes are contiguous numpy matrices of 64-byte
hexadecimal digests: a level is the matrix reshaped by the fanout and hashed row by row,
and the siblings of any node are rows whose numbers are arithmetic on its own.  A block
gives one node to the next matrix, until one block is left; on the way back each block
hands its siblings to the blocks below it, and leaves fold theirs into the root.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets, importable

FANOUT = 8
#: Levels of one block.
HEIGHT = 4
DIGEST = 64
PATH = "path array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the subroots.
TOP = "top"


def leaf(*fields: Column) -> Column:
    """The digest of fields, each written as its length in bytes, a colon and its value, or "-" if null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): a row for each row of docs; tampered is the leaf of the changed text, null where nothing is changed."""
    text = F.col("text")
    fields = lambda t: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), fields(text).alias("leaf"), F.when(changed, fields(F.translate(text, UPPER, LOWER))).alias("tampered"))


def placed(scratch: Scratch, rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, counted from 0 within tree by order, nulls first; rows that are equal in all of these stand in any order.

    Ranges of (tree, order) are counted, and each row is numbered within its range.
    """
    spark = rows.sparkSession
    dealt = scratch.keep(rows.withColumn("tie", F.monotonically_increasing_id()))
    part = scratch.keep(dealt.repartitionByRange(buckets(spark), *tree, *order, "tie").withColumn("part", F.spark_partition_id()))
    sizes = part.groupBy("part", *tree).agg(F.count("*").alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy(*tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", *[F.col(t).alias(f"of_{t}") for t in tree], start.alias("start")).withColumnRenamed("part", "of_part")
    same = F.col("part") == F.col("of_part")
    for t in tree:
        same = same & F.col(t).eqNullSafe(F.col(f"of_{t}"))
    number = F.row_number().over(Window.partitionBy("part", *tree).orderBy(*order, "tie")) - 1
    out = part.withColumn("number", number).join(starts, same).withColumn("place", (F.col("start") + F.col("number")).cast("long"))
    out = scratch.keep(out.select(*rows.columns, "place"))
    scratch.drop(dealt, part)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """The digests of a column as rows of bytes."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, DIGEST)


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level: each FANOUT rows' digest, the last of what is left."""
    whole = len(nodes) // FANOUT * FANOUT
    rows = [r.tobytes() for r in np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT * DIGEST)]
    if whole < len(nodes):
        rows.append(nodes[whole:].tobytes())
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, DIGEST)


def levels(nodes: np.ndarray, height: int) -> list[np.ndarray]:
    out = [nodes]
    for _ in range(height):
        out.append(parents(out[-1]))
    return out


def height(count: int, most: int) -> int:
    """Levels that a block hashes, of a tree of so many nodes: until one is left, `most` at most."""
    h = 0
    while count > 1 and h < most:
        count, h = -(-count // FANOUT), h + 1
    return h


def siblings(rows: list[np.ndarray], i: int) -> list[tuple[str, str]]:
    """What stands left and right of the node i, and of each of its ancestors, in their runs."""
    out = []
    for level in rows[:-1]:
        a = i // FANOUT * FANOUT
        b = min(a + FANOUT, len(level))
        out.append((level[a:i].tobytes().decode(), level[i + 1 : b].tobytes().decode()))
        i //= FANOUT
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and its siblings lead to."""
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def block_of(nodes: DataFrame, high: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", (FANOUT.bit_length() - 1) * high))


def climbed(nodes: DataFrame, high: int) -> DataFrame:
    """(tree, place, digest, count) of the next matrix: one node for each block of (tree, place, digest, count)."""

    def hashed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        count = table["count"][0].as_py()
        top = levels(matrix(table["digest"]), height(count, high))[-1]
        return pa.table({"tree": [table["tree"][0].as_py()], "place": [table["block"][0].as_py()], "digest": [top.tobytes().decode()], "count": [-(-count // FANOUT**high)]})

    return block_of(nodes, high).groupBy("tree", "block").applyInArrow(hashed, "tree string, place long, digest string, count long")


def cogrouped(nodes: DataFrame, above: DataFrame, high: int, f, schema: str) -> DataFrame:
    """f(nodes' rows in order, their levels, the row of above) of each block; above has a row (tree, place, path, subroot, root) for each."""

    def block(key: tuple, table: pa.Table, up: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return f(table, levels(matrix(table["digest"]), height(table["count"][0].as_py(), high)), up.to_pylist()[0])

    return block_of(nodes, high).groupBy("tree", "block").cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(block, schema)


def descended(nodes: DataFrame, above: DataFrame, high: int) -> DataFrame:
    """(tree, place, path, subroot, root) of all nodes: their siblings within the block, then those of the block."""

    def handed(table: pa.Table, rows: list[np.ndarray], up: dict) -> pa.Table:
        paths = [[{"left": a, "right": b} for a, b in siblings(rows, i)] + up["path"] for i in range(table.num_rows)]
        same = lambda k: pa.array([up[k]] * table.num_rows, pa.string())
        return pa.table({"tree": table["tree"], "place": table["place"], "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), "subroot": same("subroot"), "root": same("root")})

    return cogrouped(nodes, above, high, handed, f"tree string, place long, {PATH}, subroot string, root string")


def proved(nodes: DataFrame, above: DataFrame, high: int) -> DataFrame:
    """Of all leaves (tree, place, digest, count, doc_id, start) the proof, and the root that `start` folds into."""

    def proof(table: pa.Table, rows: list[np.ndarray], up: dict) -> pa.Table:
        rest = [(x["left"], x["right"]) for x in up["path"]]
        proofs, roots = [], []
        for i, start in enumerate(table["start"].to_pylist()):
            path = siblings(rows, i) + rest
            proofs.append(hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest())
            roots.append(folded(start, path))
        same = lambda k: [up[k]] * table.num_rows
        return pa.table({"doc_id": table["doc_id"], "leaf": table["digest"], "subroot": same("subroot"), "root": same("root"), "proof_sha256": proofs, "folded_root": roots, "verified": [x == up["root"] for x in roots]})

    return cogrouped(nodes, above, high, proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def matrices(scratch: Scratch, nodes: DataFrame, high: int) -> list[DataFrame]:
    """The matrices of all trees from nodes (tree, place, digest, count) up, the last with one node for each tree."""
    out = [nodes]
    most = nodes.agg(F.max("count")).first()[0] or 1
    while most > 1:
        out.append(scratch.keep(climbed(out[-1], high)))
        most = -(-most // FANOUT**high)
    return out


def counted(nodes: DataFrame) -> DataFrame:
    """nodes with the number of nodes in their tree; counts are added up before they meet."""
    sizes = nodes.groupBy("tree").agg((F.max("place") + 1).alias("count"))
    return nodes.join(sizes, "tree")


def manifest(docs: DataFrame, high: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of docs.

    Leaves of a language ascend by doc_id, rows without one first; rows that repeat a
    doc_id ascend by their leaf, and rows that are equal altogether stand in any order.
    Null languages have a tree of their own; nulls in any column are "-" in the leaf;
    only text that holds A-Z is changed by tampering, so other leaves stay verified; a
    text of any length is hashed whole; an empty table gives no rows; other columns are
    ignored.
    """
    importable(docs.sparkSession)
    # a prefix keeps the tree without a language apart from any other
    name = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    with Scratch(docs.sparkSession) as scratch:
        rows = placed(scratch, leaves(docs), ["lang"], ["doc_id", "leaf"])
        nodes = scratch.keep(counted(rows.select(name.alias("tree"), "place", F.col("leaf").alias("digest"), "doc_id", F.coalesce("tampered", "leaf").alias("start"))))
        scratch.drop(rows)
        trees = matrices(scratch, nodes.select("tree", "place", "digest", "count"), high)
        subroots = scratch.keep(trees[-1].select("tree", F.col("digest").alias("subroot")))
        lang = F.when(F.col("tree") != "-", F.substr("tree", F.lit(2)))
        order = placed(scratch, subroots.select("tree", lang.alias("lang"), "subroot", F.lit(TOP).alias("all")), ["all"], ["lang"])
        heads = scratch.keep(counted(order.select(F.lit(TOP).alias("tree"), "place", F.col("subroot").alias("digest"), F.col("tree").alias("below"))))
        tops = matrices(scratch, heads.select("tree", "place", "digest", "count"), high)
        root = scratch.keep(tops[-1].select(F.col("digest").alias("root")))  # one row, none of an empty table
        none, unknown = F.array().cast(PATH.split(" ", 1)[1]), F.lit(None).cast("string")
        above = tops[-1].select("tree", "place", none.alias("path"), unknown.alias("subroot"), unknown.alias("root"))
        for level in reversed(tops[:-1]):
            above = descended(level, above, high)
        # a tree's last matrix has one node, at place 0
        above = heads.join(above.select("tree", "place", "path"), ["tree", "place"]).join(F.broadcast(root))
        above = scratch.keep(above.select(F.col("below").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"))
        for level in reversed(trees[1:-1]):
            above = scratch.keep(descended(level, above, high))
        return scratch.result(proved(nodes, above, high))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """manifest() of the whole table documents; see there for nulls, empty and repeated rows."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB: levels, paths and folds by recursion, crc32 by its bits.
_FIELDS = "concat({})".format(", ".join("coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')".format(c) for c in ("doc_id", "source", "lang", "n_chars", "TEXT")))
SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, sha256({_FIELDS.replace("TEXT", "text")}) AS leaf, sha256({_FIELDS.replace("TEXT", f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 3 = 0 AS changed
  FROM documents),
d AS (SELECT doc_id, lang, leaf, CASE WHEN changed THEN lowered ELSE leaf END AS start, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
t(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM d
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, level, i // 8, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM t WHERE n = 1),
u(level, i, h, n) AS (
  SELECT 0, j, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY level, i // 8, n),
p AS (
  SELECT d.lang, d.i, t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < d.i >> (3 * t.level)), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > d.i >> (3 * t.level)), '') AS r
  FROM d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND t.i >> 3 = d.i >> (3 * t.level + 3) WHERE t.n > 1 GROUP BY ALL
  UNION ALL
  SELECT d.lang, d.i, 100 + u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < s.j >> (3 * u.level)), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > s.j >> (3 * u.level)), '')
  FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN u ON u.i >> 3 = s.j >> (3 * u.level + 3) WHERE u.n > 1 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY level) AS step, count(*) OVER (PARTITION BY lang, i) AS steps FROM p),
f(lang, i, step, h) AS (
  SELECT lang, i, 0, start FROM d
  UNION ALL
  SELECT f.lang, f.i, f.step + 1, sha256(q.l || f.h || q.r) FROM f JOIN q ON q.lang IS NOT DISTINCT FROM f.lang AND q.i = f.i AND q.step = f.step + 1),
proof AS (SELECT lang, i, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, max(step) AS steps FROM q GROUP BY lang, i)
SELECT d.doc_id, d.leaf, s.subroot, u.h AS root, coalesce(proof.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN u ON u.n = 1
LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM d.lang AND proof.i = d.i
JOIN f ON f.lang IS NOT DISTINCT FROM d.lang AND f.i = d.i AND f.step = coalesce(proof.steps, 0)
"""
