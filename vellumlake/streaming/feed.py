"""Incremental maintenance: a stream of changes keeps tables of notes up to date.

A change is (path, op, version, mtime_ms, text), op being upsert or delete.  Each
micro-batch takes the last change of each path that is newer than what is indexed and
parses it once; notes, tasks, entries, chunks, links and the text index then change in
one commit (streaming.tables), so readers see one state or the next, and a batch that
runs again leaves what it left before.  Vectors follow by themselves (streaming.vectorfeed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.sources.vault import note_rows
from vellumlake.streaming import linkindex, textfeed
from vellumlake.streaming.tables import Tables

CHANGE = "path string, op string, version long, mtime_ms double, text string"


def last_changes(batch: DataFrame) -> DataFrame:
    """One change of each path: the one with the greatest version."""
    best = batch.groupBy("path").agg(F.max(F.struct("version", "op", "mtime_ms", "text")).alias("c"))
    return best.select("path", "c.*")


def settled_changes(changes: DataFrame, now_ms: float, quiet_ms: float = 2000.0) -> DataFrame:
    """Changes of files that have been quiet for so long."""
    return changes.where(F.col("mtime_ms") <= now_ms - quiet_ms)


def manifest_changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, op) by comparing (path, mtime_ms) of what is indexed with what is there: new and edited files, and those that are gone."""
    both = current.select("path", F.col("mtime_ms").alias("now")).join(indexed.select("path", F.col("mtime_ms").alias("had")), "path", "full")
    op = F.when(F.col("now").isNull(), "delete").when(F.col("had").isNull() | (F.col("now") > F.col("had")), "upsert")
    return both.select("path", op.alias("op")).where("op is not null")


def parsed(changes: DataFrame) -> DataFrame:
    """Changes as rows of the index: path, version, deleted and what the note's text holds."""
    rows = note_rows(changes.select("path", "mtime_ms", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.coalesce("text", F.lit("")).alias("text")))
    return rows.join(changes.select("path", "version", (F.col("op") == "delete").alias("deleted")), "path")


#: What a note's text gives besides its own row: each table's rows, from parsed notes that are alive.
DERIVED = {
    "tasks": lambda d: d.select("path", "mtime_ms", F.explode("tasks").alias("t")).select("path", "mtime_ms", "t.*"),
    "entries": lambda d: d.select("path", F.explode("entries").alias("e")).select("path", "e.*"),
    "chunks": lambda d: d.select("path", F.posexplode("chunks").alias("chunk_index", "chunk_text")).withColumn("content_hash", F.sha2("chunk_text", 256)),
}


class Index:
    """Notes and all that is derived from them, in tables that one manifest commits together: notes, tasks, entries, chunks, links and, if asked for, the text index."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, with_text: bool = False):
        keys = {"notes": "path"} | dict.fromkeys(DERIVED, "path") | linkindex.KEYS | textfeed.KEYS
        self.spark, self.with_text, self.tables = spark, with_text, Tables(spark, folder, keys, buckets)

    def state(self) -> DataFrame | None:
        """Rows of notes, those of deleted ones as marks."""
        return self.tables.read("notes")

    def notes(self) -> DataFrame:
        """The parsed notes as they are now: stored rows, read column by column."""
        return self.state().where(~F.col("deleted")).drop("version", "deleted")

    def table(self, name: str) -> DataFrame:
        """tasks, entries or chunks as they are now."""
        return self.tables.read(name)

    def links(self) -> DataFrame:
        return linkindex.LinkIndex(self.tables).links()

    def search(self, query: str, any_term: bool = False) -> DataFrame:
        return textfeed.TextIndex(self.tables).search(query, any_term)

    def apply(self, batch: DataFrame, batch_id: int, fresh: bool = False) -> dict:
        """Takes in a batch of changes once: all tables before it, or all after it. With fresh, nothing that was there stays."""
        t = self.tables
        if t.has(batch_id) and not fresh:
            return {}
        changes = t.keep(last_changes(batch))
        touched = t.touched("notes", changes)
        old = None if fresh or not touched else t.read("notes", touched)
        rows = parsed(changes) if old is None else parsed(changes.join(old.select("path", F.col("version").alias("had")), "path", "left").where("had is null or version > had").drop("had"))
        rows = t.keep(rows)
        alive = rows.where("not deleted and error is null")
        gone = rows.where("deleted or error is not null").select("path")
        writes: dict = {}
        if touched or fresh:
            writes["notes"] = (rows if old is None else old.join(rows.select("path"), "path", "left_anti").unionByName(rows), None if fresh else touched)
        for name, of in DERIVED.items():
            new, at = of(alive), t.touched(name, rows)
            had = None if fresh or not at else t.read(name, at)
            if at or fresh:
                writes[name] = (new if had is None else had.join(rows.select("path"), "path", "left_anti").unionByName(new), None if fresh else at)
        paths = rows.select("path", F.lit("note").alias("kind"), F.when(F.col("deleted") | F.col("error").isNotNull(), "delete").otherwise("upsert").alias("op"))
        numbers: dict = {}
        refs = alive.select(F.col("path").alias("source"), F.explode("links").alias("target"))
        state = Tables(t.spark, f"{t.folder}/fresh-{batch_id}", t.keys, t.buckets) if fresh else t  # an empty one
        writes |= {k: (v[0], None) if fresh else v for k, v in linkindex.link_writes(state, paths, refs).items()}
        if self.with_text:
            text = F.concat_ws(" ", "title", "body")
            more, numbers = textfeed.text_writes(state, batch_id, alive.select("path", "title", "body"), gone, text, t)
            writes |= {k: (v[0], None) if fresh and isinstance(v, tuple) else v for k, v in more.items()}
            if fresh:
                writes = dict.fromkeys(t.names("terms")) | writes
        written = t.commit(batch_id, writes, numbers)
        state.drop_kept()
        if fresh:
            t._remove(state.folder)
        if self.with_text:
            textfeed.TextIndex(t).merge()
        return written

    def rebuild(self, notes: DataFrame, batch_id: int) -> dict:
        """Puts the index of notes (path, version, mtime_ms, text) in place of all that was there; one that dies on the way leaves the old."""
        return self.apply(notes.select("path", F.lit("upsert").alias("op"), "version", "mtime_ms", "text"), batch_id, fresh=True)

    def follow(self, changes: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
        """Starts the stream; it ends once what is there has been read."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id)
            if on_batch:
                on_batch(batch, batch_id)

        return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_embed(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks whose text has no vector yet, by path, place and hash."""
    return chunks.join(embedded.select("path", "chunk_index", "content_hash"), ["path", "chunk_index", "content_hash"], "left_anti")
