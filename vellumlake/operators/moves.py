"""Moving notes without breaking links: which link texts must change, and to what.

Every link is resolved before and after the move.  A text that still leads to the same
note, wherever that is now, stays as it is; another is written anew in its own form (from
the source's folder, whole path, or name alone, with or without extension), or as a whole
path where its own form would lead elsewhere.  What a new text leads to is looked up like
any link, so a rewrite that is reported has been proved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import links


def renamed(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with paths of `column` as the moves (old, new) leave them."""
    new = moves.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(rows.columns)


def relative(source: Column, target: Column) -> Column:
    """target as a path from the folder of source, beginning with ./ or ../."""
    here, there = F.split(source, "/"), F.split(target, "/")
    most = F.least(F.size(here), F.size(there)) - 1
    same = F.aggregate(F.sequence(F.lit(0), most), F.lit(0), lambda n, i: F.when((i == n) & (i < most) & (F.get(here, i) == F.get(there, i)), n + 1).otherwise(n))
    up = F.size(here) - 1 - same
    rest = F.array_join(F.slice(there, same + 1, F.size(there)), "/")
    return F.concat(F.when(up == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), up)), rest)


def own_form(text: Column, source: Column, target: Column, extension: str = ".md") -> Column:
    """A text for target in the form that text has."""
    whole = F.when(text.rlike(r"^\.{1,2}/"), relative(source, target)).when(F.contains(text, F.lit("/")), target).otherwise(F.regexp_extract(target, r"([^/]*)$", 1))
    return shortened(whole, text, extension)


def shortened(path: Column, text: Column, extension: str = ".md") -> Column:
    """path, without the extension of notes where text has none."""
    return F.when(F.endswith(path, F.lit(extension)) & ~F.endswith(text, F.lit(extension)), F.left(path, F.length(path) - len(extension))).otherwise(path)


def rewrites(references: DataFrame, notes: DataFrame, moves: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(source, target, text): for each link (source, target as written) whose text must change, the source's new path, and the new text.

    moves has (old, new), each old path once, no new path that another file keeps.  Links
    that led nowhere stay as they are.
    """
    refs = references.select("source", "target").distinct()
    keys_of = lambda move: links.link_keys(renamed(notes.select("path"), "path", moves) if move else notes.select("path"), None if files is None else renamed(files.select("path"), "path", moves) if move else files.select("path"))
    before = links.answered(links.asked_keys(refs, files is not None), keys_of(False)).where("path is not null")
    wanted = renamed(renamed(before, "path", moves), "source", moves)
    after = keys_of(True)
    now = links.answered(links.asked_keys(wanted, files is not None), after).withColumnRenamed("path", "now")
    lost = wanted.join(now, ["source", "target"]).where(~F.col("now").eqNullSafe(F.col("path"))).drop("now")
    text, source, path = F.col("target"), F.col("source"), F.col("path")
    tried = lost.select("source", "target", "path", F.posexplode(F.array(own_form(text, source, path), shortened(path, text), path)).alias("order", "text"))
    leads = links.answered(links.asked_keys(tried.select("source", F.col("text").alias("target")).distinct(), files is not None), after).select("source", F.col("target").alias("text"), F.col("path").alias("leads"))
    proved = tried.join(leads, ["source", "text"]).where("leads = path")
    return proved.groupBy("source", "target").agg(F.min(F.struct("order", "text"))["text"].alias("text"))


def moved_links(references: DataFrame, notes: DataFrame, moves: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(source, target): all links as written after the move, of sources where they are then."""
    refs = renamed(references.select("source", "target").distinct(), "source", moves)
    new = rewrites(references, notes, moves, files)
    return refs.join(new, ["source", "target"], "left").select("source", F.coalesce("text", "target").alias("target")).distinct()
