"""The link table kept up to date: links written before their target find it when it comes.

Two inverted indexes lie in buckets by key: `ends`, from each text that may lead to a
path to that path, and `asked`, from the same texts to the links that ask for them.  New
and gone paths change the best path of a few keys; the links that ask for those, and no
others, are led anew.  After any order of changes the table is what a rebuild would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import links
from vellumlake.streaming.tables import Tables

#: Tables and the columns whose hash deals their rows.
KEYS = {"paths": "path", "ends": "key", "asked": "key", "refs": "source"}
PATHS, ENDS, ASKED, REFS = "path string, kind string", "key string, tier int, n int, path string", "key string, source string, target string", "source string, target string, path string"


def _stored(tables: Tables, name: str, schema: str, some: list[int] | None) -> DataFrame:
    found = None if some == [] else tables.read(name, some)
    return tables.spark.createDataFrame([], schema) if found is None else found


def link_writes(tables: Tables, paths: DataFrame, references: DataFrame) -> dict[str, tuple[DataFrame, list[int]]]:
    """What a batch changes in the four tables, for Tables.commit().

    paths: (path, kind, op) of changed notes ("note") and other files ("file"), a row for
    each path, op being upsert or delete; references: (source, target) of the changed
    sources, in place of all that these had.  A source that is deleted has none.
    """
    changed = tables.keep(paths.select("path", "kind", "op"))
    new_refs = tables.keep(references.select("source", "target").where("target is not null").distinct())

    # paths that were not there, and paths that go
    at = tables.touched("paths", changed)
    had = _stored(tables, "paths", PATHS, at)
    both = changed.join(had.select("path", F.col("kind").alias("was")), "path", "left")
    fresh = tables.keep(both.where("op <> 'delete' and was is null").select("path", "kind"))
    gone = tables.keep(both.where("op = 'delete' and was is not null").select("path", F.col("was").alias("kind")))
    writes = {}
    if not (fresh.isEmpty() and gone.isEmpty()):
        writes["paths"] = (had.join(gone, "path", "left_anti").unionByName(fresh), at)

    # keys whose best path changes with them
    of = lambda df: links.path_keys(df.where("kind = 'note'"), df.where("kind = 'file'"))
    plus, minus = tables.keep(of(fresh)), tables.keep(of(gone))
    keys = tables.keep(plus.select("key").union(minus.select("key")).distinct())
    in_ends = tables.touched("ends", keys)
    before = _stored(tables, "ends", ENDS, in_ends)
    after = before.join(gone, "path", "left_anti").unionByName(plus)
    if in_ends:
        after = tables.keep(after)
        writes["ends"] = (after, in_ends)
    best = lambda df: links.best_of(df.join(keys, "key", "left_semi"))
    moved = best(after).select("key", F.col("path").alias("now")).join(best(before).select("key", F.col("path").alias("had")), "key", "full").where(~F.col("now").eqNullSafe(F.col("had"))).select("key")
    moved = tables.keep(moved)

    # links of changed sources, in place of what these had
    sources = changed.select(F.col("path").alias("source")).union(new_refs.select("source")).distinct()
    in_refs = tables.touched("refs", sources)
    old_refs = tables.keep(_stored(tables, "refs", REFS, in_refs).join(sources, "source", "left_semi"))
    left = old_refs.select("source", "target").join(new_refs, ["source", "target"], "left_anti")
    come = new_refs.join(old_refs.select("source", "target"), ["source", "target"], "left_anti")
    off, on = tables.keep(links.asked_keys(left, True)), tables.keep(links.asked_keys(come, True))
    in_asked = tables.touched("asked", off.select("key").union(on.select("key")))
    if in_asked:
        asked = _stored(tables, "asked", ASKED, in_asked).join(off, ["key", "source", "target"], "left_anti").unionByName(on.distinct())
        writes["asked"] = (asked, in_asked)

    # of the other links those that ask for a key that leads elsewhere now
    waiting = _stored(tables, "asked", ASKED, tables.touched("asked", moved)).join(moved, "key", "left_semi").select("source", "target")
    waiting = waiting.join(left, ["source", "target"], "left_anti")
    again = tables.keep(waiting.union(come).distinct())
    asks = tables.keep(links.asked_keys(again, True))
    others = [b for b in tables.touched("ends", asks) if b not in in_ends]
    answers = links.answered(asks, links.best_of(after.unionByName(_stored(tables, "ends", ENDS, others)).join(asks.select("key").distinct(), "key", "left_semi")))
    in_refs = tables.touched("refs", again.select("source").union(left.select("source")))
    if in_refs:
        pair = ["source", "target"]
        refs = _stored(tables, "refs", REFS, in_refs).join(left, pair, "left_anti").join(again, pair, "left_anti").unionByName(answers)
        writes["refs"] = (refs, in_refs)
    return writes


class LinkIndex:
    """A link table of its own; a feed that keeps further tables puts link_writes() in its own commit."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def apply(self, batch_id: int, paths: DataFrame, references: DataFrame) -> dict:
        """Takes in a batch once; returns how many buckets of each table it wrote."""
        if self.tables.has(batch_id):
            return {}
        return self.tables.commit(batch_id, link_writes(self.tables, paths, references))

    def links(self) -> DataFrame:
        """(source, target) as links.resolved() gives them."""
        return _stored(self.tables, "refs", REFS, None).select("source", F.coalesce("path", "target").alias("target")).distinct()
