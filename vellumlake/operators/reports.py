"""Reports that put several queries into one table of (part, name, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import links, metadata

OPEN = ("todo", "in_progress")


def part(rows: DataFrame, name: str, key: str, n: str) -> DataFrame:
    return rows.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("name"), F.col(n).cast("long").alias("n"))


def orientation(notes: DataFrame, graph: DataFrame, entries: DataFrame, most: int = 20) -> DataFrame:
    """What a newcomer needs to know: folders, tags, property keys, newest notes, memory files, orphans, and counts of notes, bytes and broken links."""
    stats = metadata.stats(notes)
    counts = stats.select(F.explode(F.create_map(*[x for c in stats.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("name", "n"))
    broken = links.broken(graph, notes)
    parts = [
        part(metadata.folder_counts(notes).limit(most), "folder", "folder", "n_notes"),
        part(metadata.all_tags(notes).limit(most), "tag", "tag", "n_notes"),
        part(metadata.property_keys(notes).limit(most), "property", "key", "n_notes"),
        part(metadata.recent(notes, limit=most), "recent", "path", "mtime_ms"),
        part(entries.groupBy("file").agg(F.count("*").alias("n_entries")), "memory", "file", "n_entries"),
        part(links.orphans(graph, notes, [], most), "orphan", "path", "mtime_ms"),
        counts.select(F.lit("count").alias("part"), "name", "n"),
        part(broken.withColumn("name", F.lit("n_broken")), "count", "name", "n_broken"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def daily_review(tasks: DataFrame, entries: DataFrame, notes: DataFrame, today: str) -> DataFrame:
    """Of a day: open tasks that are overdue, due, due next day or begin; tasks done that day; entries and notes of the day."""
    day = F.lit(today).cast("date")
    text = lambda plus: F.date_format(F.date_add(day, plus), "yyyy-MM-dd")
    due = F.col("due")
    bucket = F.when(due < text(0), "overdue").when(due == text(0), "due").when(due == text(1), "tomorrow").when((F.col("start") == text(0)) | (F.col("scheduled") == text(0)), "begins")
    opened = tasks.where(F.col("status").isin(*OPEN)).withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    done = tasks.where((F.col("status") == "done") & (F.col("done") == text(0)))
    written = entries.where(F.col("entry_date") == text(0))
    made = notes.where(F.startswith("created", text(0)))
    one = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    rows = part(opened, "task", "bucket", "n")
    for found, kind, name in ((done, "task", "done"), (written, "memory", "entries"), (made, "note", "created")):
        rows = rows.union(part(one(found, name), kind, "name", "n"))
    return rows


def memory_review(entries: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Of each section: its entries, how many are older than so many days, and the last date; sections without a late entry come first."""
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    out = entries.groupBy("file", "section").agg(F.count("*").alias("n_entries"), F.count_if(F.col("entry_date") < since).alias("n_old"), F.max("entry_date").alias("last_date"))
    return out.withColumn("stale", F.col("n_old") == F.col("n_entries")).orderBy(F.desc("stale"), "last_date", "file", "section")
