"""A folder of notes as tables: one scan of the files, one parse of each, then plain selections.

Every reader goes through Spark's binaryFile source, so any store that Spark reads
will do.  A file that cannot be parsed is kept apart with its error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions import markdown as M
from vellumlake.functions.predicates import visible
from vellumlake.operators.links import resolved
from vellumlake.sources.store import small_batches

TEXT_TYPES = ("txt", "csv", "json", "xml", "svg", "log", "yaml", "yml", "base")
TASK = "line int, heading string, status_char string, status string, priority string, block_id string, done string, cancelled string, due string, scheduled string, start string, created string, recurrence string, on_completion string, task_id string, depends_on array<string>, description string, tags array<string>"
PARSED = f"struct<error:string,title:string,tags:array<string>,related:array<string>,type:string,created:string,properties:string,body:string,metadata:string,callout:struct<type:string,title:string,body:string>,headings:array<struct<level:int,text:string,start:int,body_start:int,body_end:int>>,links:array<string>,tasks:array<struct<{TASK.replace(' array', ':array').replace(' string', ':string').replace(' int', ':int')}>>,entries:array<struct<section:string,date:string,text:string,entry_index:int,content_hash:string>>,chunks:array<string>,done_lanes:array<string>>"


def as_list(value) -> list[str]:
    """A list as it is; another value that says something as a list of one."""
    if isinstance(value, list):
        return [x if isinstance(x, str) else json.dumps(x) for x in value]
    return [str(value)] if value else []


def metadata_text(properties: dict) -> str:
    """key: value lines for search, without title, nulls and nested values."""
    out = []
    for k, v in properties.items():
        if k == "title" or v is None or isinstance(v, dict):
            continue
        plain = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
        out.append(f"{k}: " + (" ".join(plain(x) for x in v if x is not None and not isinstance(x, dict | list)) if isinstance(v, list) else plain(v)))
    return "\n".join(out)


def parse_note(path: str, text: str) -> dict:
    properties, body = M.frontmatter(text)
    title = properties.get("title")
    title = title if isinstance(title, str) else path.rsplit("/", 1)[-1].removesuffix(".md")
    created = properties.get("created")
    created = created if isinstance(created, str) and _instant(created) else None
    return {
        "error": None, "title": title, "tags": as_list(properties.get("tags")), "related": as_list(properties.get("related")), "type": properties["type"] if isinstance(properties.get("type"), str) else None, "created": created,
        "properties": json.dumps(properties, default=str), "body": body, "metadata": metadata_text(properties), "callout": M.leading_callout(body), "headings": M.headings(M.lines_of(body)),
        "links": list(dict.fromkeys([*M.link_targets(body), *M.property_links(properties)])), "tasks": M.tasks(text), "entries": M.memory_entries(body), "chunks": M.chunks(title, body), "done_lanes": M.done_lanes(text) if properties.get("kanban-plugin") else None,
    }


def _instant(text: str) -> bool:
    import datetime

    try:
        datetime.datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


#: Characters of text that are parsed into one frame: a parsed note holds its text several times.
PARSED_CHARS = 1_000_000


def parse_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [f.split(":")[0] for f in ("error", "title", "tags", "related", "type", "created", "properties", "body", "metadata", "callout", "headings", "links", "tasks", "entries", "chunks", "done_lanes")]
    frame = lambda rows: pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)
    for paths, texts in batches:
        rows, size = [], 0
        for path, text in zip(paths, texts, strict=True):
            try:
                if text is None:
                    raise ValueError("not UTF-8")
                rows.append(parse_note(path, text))
            except Exception as e:  # one bad file must not end the scan
                rows.append({"error": f"{type(e).__name__}: {e}"})
            size += len(text or "")
            if size >= PARSED_CHARS:
                yield frame(rows)
                rows, size = [], 0
        if rows or not len(paths):
            yield frame(rows)


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path relative to root, mtime_ms, bytes, content) of the files below root that no dot hides; content is read only if it is used."""
    base = root.rstrip("/")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    after = F.regexp_replace("path", F.lit(r"^.*?\Q" + base.split("://")[-1] + r"/\E"), F.lit(""))
    rows = scan.select(F.url_decode(F.replace(after, F.lit("+"), F.lit("%2B"))).alias("path"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.col("length").alias("bytes"), "content")
    return rows.where(visible(F.col("path")))


def note_rows(raw: DataFrame) -> DataFrame:
    """path, mtime_ms, bytes and the parsed fields of (path, mtime_ms, bytes, text); a null text, which was no UTF-8, is an error."""
    small_batches(raw.sparkSession)
    return raw.withColumn("note", F.pandas_udf(parse_batches, PARSED)("path", "text")).select("path", "mtime_ms", "bytes", "note.*").withColumn("folder", F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(""))


def vault(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """notes, tasks, entries, chunks, links, files and errors of a folder."""
    text: Column = F.try_validate_utf8(F.col("content").cast("string"))
    raw = files(spark, root, "*.md").select("path", "mtime_ms", "bytes", text.alias("text"))
    return tables(note_rows(raw), files(spark, root).where(~F.endswith("path", F.lit(".md"))))


def tables(rows: DataFrame, others: DataFrame) -> dict[str, DataFrame]:
    good = rows.where("error is null")
    notes = good.select("path", "title", F.col("body").alias("content"), "metadata", "tags", "related", "folder", "type", "created", "mtime_ms", "bytes", F.parse_json("properties").alias("properties"), F.col("callout").alias("leading_callout"), "done_lanes")
    tasks = good.select(F.col("path").alias("note_path"), "mtime_ms", F.explode("tasks").alias("t")).select("note_path", "mtime_ms", "t.*")
    entries = good.select(F.col("path").alias("file"), F.explode("entries").alias("e")).select("file", "e.section", F.col("e.date").alias("entry_date"), F.col("e.text").alias("entry_text"), "e.entry_index", "e.content_hash")
    chunks = good.select("path", F.posexplode("chunks").alias("chunk_index", "chunk_text")).withColumn("content_hash", F.sha2("chunk_text", 256))
    refs = good.select(F.col("path").alias("source"), F.explode("links").alias("target"))
    links = resolved(refs.union(canvas_links(others)), notes, others)
    return {"notes": notes, "tasks": tasks, "entries": entries, "chunks": chunks, "links": links, "files": others.select("path", "mtime_ms", "bytes"), "errors": rows.where("error is not null").select("path", "error")}


def canvas_links(others: DataFrame) -> DataFrame:
    """(source, target): the files that canvases show; a canvas that is no JSON shows none."""
    if "content" not in others.columns:
        return others.select(F.col("path").alias("source"), F.lit("").alias("target")).where(F.lit(False))
    nodes = F.from_json(F.try_validate_utf8(F.col("content").cast("string")), "nodes array<struct<type:string,file:string>>")["nodes"]
    each = others.where(F.endswith("path", F.lit(".canvas"))).select(F.col("path").alias("source"), F.explode(nodes).alias("n"))
    return each.where("n.type = 'file' and n.file is not null").select("source", F.col("n.file").alias("target"))


def text_files(spark: SparkSession, root: str, most: int = 102_400) -> DataFrame:
    """(path, title, content, folder, mtime_ms, bytes) of text files and canvases, contents cut to so many bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = files(spark, root).where(kind.isin(*TEXT_TYPES, "canvas"))

    @F.pandas_udf("string")
    def content(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return texts.combine(kinds, lambda t, k: M.cut_bytes(M.canvas_text(t) if k == "canvas" else t, most))

    raw = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    return rows.select("path", name.alias("title"), content(kind, raw).alias("content"), folder.alias("folder"), F.round("mtime_ms").alias("mtime_ms"), "bytes")
