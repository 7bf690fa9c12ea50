"""The link graph: resolution of link texts to paths, backlinks, out-links, orphans, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.functions.predicates import in_folder


def suffixes(path: Column) -> Column:
    """A path and what is left of it after each of its slashes, as (key, depth)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("key"), i.alias("depth")))


def normal(path: Column) -> Column:
    """A path without empty and "." segments, ".." taking back the segment before it where there is one."""
    last = lambda out: F.element_at(out, -1)
    step = lambda out, p: F.when(p.isin("", "."), out).when((p == "..") & (F.size(out) > 0) & (F.coalesce(last(F.concat(F.array(F.lit("..")), out)), F.lit("")) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def beside(source: Column, target: Column) -> Column:
    """target as a path from the folder of source."""
    return normal(F.concat(F.regexp_replace(source, r"[^/]*$", ""), target))


def stem_of(path: Column) -> Column:
    """A path without its file's extension; a name that begins with its only dot has none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def path_keys(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(key, tier, n, path): every text that may lead to a path.

    Keys begin with what they are: "n" and "f" for the ends of paths of notes and of other
    files, "N" and "F" for whole paths, which a link may give from the source's folder.
    Tiers are the order of the rules: notes before files; whole names before names without
    their extension; exact before relative before the end of a path.  n is the path's
    length.
    """

    def of(paths: DataFrame, name: Column, kind: str, tier: int) -> DataFrame:
        ends = F.transform(suffixes(name), lambda s: F.struct(F.concat(F.lit(kind), s["key"]).alias("key"), F.when(s["depth"] == 0, tier).otherwise(tier + 2).alias("tier")))
        whole = F.array(F.struct(F.concat(F.lit(kind.upper()), name).alias("key"), F.lit(tier + 1).alias("tier")))
        return paths.select("path", F.explode(F.concat(ends, whole)).alias("k")).select("k.*", F.length("path").alias("n"), "path")

    keys = of(notes.select("path"), F.col("path"), "n", 0)
    if files is not None:
        keys = keys.union(of(files.select("path"), F.col("path"), "f", 3)).union(of(files.select("path"), stem_of(F.col("path")), "f", 6))
    return keys


def best_of(keys: DataFrame) -> DataFrame:
    """(key, tier, n, path): of each key the best path: the lowest tier, of equals the shortest path, then the first."""
    return keys.groupBy("key").agg(F.min(F.struct("tier", "n", "path")).alias("best")).select("key", "best.*")


def link_keys(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(key, tier, n, path): the best path for each text that may lead to it, a row for each key."""
    return best_of(path_keys(notes, files))


def asked_keys(references: DataFrame, files: bool, extension: str = ".md") -> DataFrame:
    """(source, target, key): the few keys that the rules look for, of each link text."""
    note = F.when(F.endswith("target", F.lit(extension)), F.col("target")).otherwise(F.concat("target", F.lit(extension)))
    source = F.col("source")
    asked = {"n": note, "N": beside(source, note)} | ({"f": F.col("target"), "F": beside(source, F.col("target"))} if files else {})
    return references.select("source", "target", F.explode(F.array(*[F.concat(F.lit(k), c) for k, c in asked.items()])).alias("key"))


def answered(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, target, path): the best path of each link text over all its keys, null where there is none."""
    met = asked.join(keys, "key", "left").groupBy("source", "target").agg(F.min(F.when(F.col("path").isNotNull(), F.struct("tier", "n", "path"))).alias("best"))
    return met.select("source", "target", F.col("best.path").alias("path"))


def resolved(references: DataFrame, notes: DataFrame, files: DataFrame | None = None, extension: str = ".md") -> DataFrame:
    """(source, target): each link text led to the path of a note, else of another file; a text that leads nowhere stays as it is.

    Paths are expanded to their ends, and a link to the few texts that its rules look for,
    so that the search is an equi-join; a popular target is one row of keys, whose
    references a skewed join may split.  Repeated references count once.
    """
    refs = references.select("source", "target").distinct()
    found = answered(asked_keys(refs, files is not None, extension), link_keys(notes, files))
    return found.select("source", F.coalesce("path", "target").alias("target")).distinct()


def backlinks(links: DataFrame, notes: DataFrame, path: str, files: DataFrame | None = None) -> DataFrame:
    """The notes (and other files, such as canvases) that link to path, by title; a file's name is its title."""
    found = links.where(F.col("target") == path).select(F.col("source").alias("path"))
    have = notes.select("path", "title", "bytes")
    if files is not None:
        have = have.union(files.select("path", F.regexp_extract("path", r"([^/]*)$", 1), "bytes"))
    return found.join(have, "path").select("path", "title", "bytes").orderBy("title", "path")


def outgoing(links: DataFrame, notes: DataFrame, path: str, daily_folder: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Targets of a note, kind "file" for files that are no notes; a missing target in the daily folder is a forward reference."""
    have = notes.select(F.col("path").alias("target"), "title", "bytes", F.lit("note").alias("kind"))
    if files is not None:
        have = have.union(files.select("path", F.lit(None).cast("string"), "bytes", F.lit("file")))
    out = links.where(F.col("source") == path).join(have, "target", "left")
    exists = F.col("kind").isNotNull()
    forward = ~exists & F.startswith("target", F.lit(daily_folder.rstrip("/") + "/")) if daily_folder else F.lit(False)
    return out.select(F.col("target").alias("path"), "title", exists.alias("exists"), F.coalesce("kind", F.lit("note")).alias("kind"), "bytes", forward.alias("forward_ref")).orderBy("path")


def orphans(links: DataFrame, notes: DataFrame, exclude: list[str], limit: int = 50) -> DataFrame:
    """Notes that no other note links to, newest first."""
    pointed = links.where("source <> target").select(F.col("target").alias("path")).distinct()
    some = notes
    for folder in exclude:
        some = some.where(~in_folder(F.col("path"), folder))
    return some.join(pointed, "path", "left_anti").select("path", "title", "mtime_ms").orderBy(F.desc("mtime_ms"), "path").limit(limit)


def broken(links: DataFrame, notes: DataFrame, daily_folder: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row: distinct targets that exist nowhere, and how many lie in the daily folder, counted apart."""
    targets = links.select(F.col("target").alias("path")).distinct().join(notes.select("path"), "path", "left_anti")
    if files is not None:
        targets = targets.join(files.select("path"), "path", "left_anti")
    daily = F.startswith("path", F.lit(daily_folder.rstrip("/") + "/")) if daily_folder else F.lit(False)
    return targets.agg(F.count_if(~daily).alias("n_broken"), F.count_if(daily).alias("n_excluded"))
