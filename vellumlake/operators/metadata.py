"""Tags, properties, folders and statistics of notes; lists of tasks; dated entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions import predicates as P
from vellumlake.operators.ranks import first_of_each


def newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("mtime_ms"), "path").limit(P.limit_of(limit))


def by_tag(notes: DataFrame, tag: str, exact: bool = False, limit: int = 20) -> DataFrame:
    return newest(notes.where(P.has_tag(F.col("tags"), tag, exact)), limit)


def by_folder(notes: DataFrame, folder: str, recursive: bool = True, limit: int = 20) -> DataFrame:
    return newest(notes.where(P.in_folder(F.col("path"), folder, recursive)), limit)


def all_tags(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count_distinct("path").alias("n_notes")).orderBy(F.desc("n_notes"), "tag")


def recent(notes: DataFrame, sort_by: str = "modified", limit: int = 20) -> DataFrame:
    return notes.orderBy(F.col("created").desc_nulls_last(), "path").limit(limit) if sort_by == "created" else newest(notes, limit)


def properties_of(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, key, value): a row for each property, values as variants."""
    some = notes if folder is None else notes.where(P.in_folder(F.col("path"), folder))
    some = some.select("path", "properties")
    return some.lateralJoin(notes.sparkSession.tvf.variant_explode(F.col("properties").outer())).select("path", "key", "value")


def property_texts(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, key, text): scalar values and the elements of lists as text, without nulls."""
    each = properties_of(notes, folder)
    many = F.try_variant_get(F.col("value"), "$", "array<variant>")
    values = F.when(F.schema_of_variant("value").startswith("ARRAY"), F.transform(many, P.as_text)).otherwise(F.array(P.as_text(F.col("value"))))
    return each.select("path", "key", F.explode(values).alias("text")).where("text is not null")


def property_keys(notes: DataFrame, folder: str | None = None, samples: int = 3) -> DataFrame:
    """key, n_notes and its most frequent values, in one pass over the properties: their rows, each with a note's first value marked, meet by key and value."""
    some = properties_of(notes, folder)
    many = F.try_variant_get(F.col("value"), "$", "array<variant>")
    texts = F.when(F.schema_of_variant("value").startswith("ARRAY"), F.transform(many, P.as_text)).otherwise(F.array(P.as_text(F.col("value"))))
    # a key occurs once in a note, so notes are counted by the first value of each
    each = some.select("key", F.posexplode_outer(texts).alias("at", "text"))
    values = each.groupBy("key", "text").agg(F.count("*").alias("n"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("notes"))
    counts = values.groupBy("key").agg(F.sum("notes").alias("n_notes"))
    top = first_of_each(values.where("text is not null"), "key", samples, [(-F.col("n")).alias("n"), F.col("text").alias("text")])
    out = counts.join(top, "key", "left").select("key", "n_notes", F.coalesce(F.transform("first", lambda s: s["text"]), F.array().cast("array<string>")).alias("samples"))
    return out.orderBy(F.desc("n_notes"), "key")


def property_values(notes: DataFrame, key: str, folder: str | None = None, limit: int = 50) -> DataFrame:
    some = property_texts(notes, folder).where(F.col("key") == key)
    return some.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(limit)


def by_property(notes: DataFrame, key: str, value: str, folder: str | None = None, limit: int = 20) -> DataFrame:
    some = notes.where(P.property_has(F.col("properties"), key, value))
    return newest(some if folder is None else some.where(P.in_folder(F.col("path"), folder)), limit)


def modified_on(notes: DataFrame, day: str, limit: int = 50) -> DataFrame:
    return newest(notes.where(P.modified_bounds(F.col("mtime_ms"), {"on": day})), limit)


def stats(notes: DataFrame) -> DataFrame:
    empty = F.to_json("properties") == "{}"
    return notes.agg(F.count("*").alias("n_notes"), F.count_if(F.size("tags") == 0).alias("n_untagged"), F.count_if(empty).alias("n_without_properties"), F.sum("bytes").alias("bytes"))


def folder_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("n_notes")).orderBy(F.desc("n_notes"), "folder")


def adoption(notes: DataFrame, low: float = 0.05) -> DataFrame:
    """Share of notes with each property, and whether it is low."""
    total = notes.agg(F.count("*").alias("total"))
    each = properties_of(notes).groupBy("key").agg(F.count_distinct("path").alias("n_notes"))
    share = F.round(F.col("n_notes") / F.col("total"), 6)
    return each.join(F.broadcast(total)).select("key", "n_notes", share.alias("share"), (share < low).alias("is_low")).orderBy(F.desc("n_notes"), "key")


#: The dates that stand in for a missing one, most urgent first, and what sorts latest first by itself.
STAND_IN = ("due", "scheduled", "start", "created")
LATEST_FIRST = {"start", "created", "done", "note_mtime"}
LEVELS = {"highest": 0, "high": 1, "medium": 2, "low": 4, "lowest": 5}


def task_order(by: str, direction: str | None = None) -> list[Column]:
    """The sort of a task list, ties by note path and line.

    A date is followed by the other dates that may stand in for it, then by the newest
    note; nulls come last.  An explicit direction holds for all dates, else each has its own.
    """
    tie = [F.col("note_path").asc(), F.col("line").asc()]
    down = lambda c: (direction or ("desc" if c in LATEST_FIRST else "asc")) == "desc"
    put = lambda c, name: c.desc_nulls_last() if down(name) else c.asc_nulls_last()
    if by == "position":
        return [put(F.col("note_path"), by), put(F.col("line"), by)]
    if by == "note_mtime":
        return [put(F.col("mtime_ms"), by), *tie]
    if by == "priority":
        level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("priority")], F.lit(3))
        return [put(level, by), *tie]
    others = [c for c in STAND_IN if c != by] if by in STAND_IN else []
    return [*(put(F.col(c), c) for c in (by, *others)), F.desc("mtime_ms"), *tie]


def task_list(tasks: DataFrame, status=("not_done",), dates=None, priority=None, folder=None, tag=None, heading=None, path=None, limit: int = 50, sort_by: str = "due", direction: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(total, page) of the tasks that pass all filters."""
    where = [F.col("status").isin(P.statuses(status))]
    where += [P.day_bounds(F.col(c), b) for c, b in (dates or {}).items()]
    if priority:
        where.append(P.has_priority(F.col("priority"), priority))
    if folder:
        where.append(P.in_folder(F.col("note_path"), folder))
    if tag:
        where.append(P.has_tag(F.col("tags"), tag))
    if heading:
        where.append(F.col("heading").isin(list(heading)))
    if path:
        where.append(F.col("note_path") == path)
    some = tasks.where(P.all_of(where))
    return some.agg(F.count("*").alias("total")), some.orderBy(*task_order(sort_by, direction)).limit(P.limit_of(limit))


def recall(hits: DataFrame, limit: int = 50) -> DataFrame:
    """The most relevant entries of scored hits, then in order of date."""
    top = hits.orderBy(F.desc(F.round("score", 6)), "entry_key", "entry_index").limit(max(1, limit))
    return top.orderBy("entry_date", "file", "entry_key", "entry_index")


def memory_files(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file", "section").agg(F.count("*").alias("n_entries"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"))


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, hash, place, action): keep, insert or delete, copies of a hash being matched one to one in order."""
    nth = lambda df: df.select("file", "hash", F.row_number().over(Window.partitionBy("file", "hash").orderBy("entry_index")).alias("place"))
    both = nth(old).withColumn("had", F.lit(True)).join(nth(new).withColumn("has", F.lit(True)), ["file", "hash", "place"], "full")
    return both.select("file", "hash", "place", F.when(F.col("had") & F.col("has"), "keep").when(F.col("has"), "insert").otherwise("delete").alias("action"))
