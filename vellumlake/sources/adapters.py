"""The driver's tables as notes, tasks, dated entries, edges and chunks: fixed arithmetic, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions.predicates import visible
from vellumlake.sources.vault import note_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as notes; some have no tags, no properties, no created."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    id_ = F.col("doc_id")
    tags = F.when(id_ % 10 == 3, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.concat(F.lit("lang/"), "lang"), F.when(F.col("quality") == 1, "q/good").when(F.col("quality") == 0, "q/bad"), F.when(F.col("toxic") == 1, "flag/toxic"))))
    properties = F.when(id_ % 11 == 0, F.lit("{}")).otherwise(F.to_json(F.struct("lang", "source", "quality", (F.col("toxic") == 1).alias("toxic"))))
    # before the join, so that a query without content doesn't carry it there
    return d.withColumn("bytes", F.octet_length("text").cast("long")).join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), id_.cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("doc "), id_.cast("string")).alias("title"),
        F.col("source").alias("folder"),
        F.col("lang").alias("type"),
        F.col("text").alias("content"),
        "bytes",
        F.when(id_ % 7 != 0, F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (id_ % 400).cast("int")), "yyyy-MM-dd"), F.lit("T08:00:00+00:00"))).alias("created"),
        (1700000000000 + (id_ * 7919 % 40000) * 3600000).cast("double").alias("mtime_ms"),
        tags.alias("tags"),
        F.parse_json(properties).alias("properties"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, type, title, content) of notes(), without what labels say of them, so that no text is dealt to its label."""
    id_ = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), id_, F.lit(".md")).alias("path"), F.col("lang").alias("type"), F.concat(F.lit("doc "), id_).alias("title"), F.col("text").alias("content"))


NOTES = """notes AS (SELECT d.doc_id, d.source||'/'||d.lang||'/'||d.doc_id||'.md' AS path, 'doc '||d.doc_id AS title, d.source AS folder, d.lang AS type, d.text AS content,
  CAST(strlen(d.text) AS BIGINT) AS bytes, CASE WHEN d.doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER), '%Y-%m-%d')||'T08:00:00+00:00' END AS created,
  CAST(1700000000000 + (d.doc_id * 7919 % 40000) * 3600000 AS DOUBLE) AS mtime_ms,
  CASE WHEN d.doc_id % 10 = 3 THEN [] ELSE list_filter(['lang/'||d.lang, CASE WHEN quality = 1 THEN 'q/good' WHEN quality = 0 THEN 'q/bad' END, CASE WHEN toxic = 1 THEN 'flag/toxic' END], lambda x: x IS NOT NULL) END AS tags,
  d.doc_id % 11 <> 0 AS has_properties, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PROPERTIES = """props AS (SELECT path, mtime_ms, title, folder, unnest([{'k': 'lang', 'v': lang}, {'k': 'source', 'v': source}, {'k': 'quality', 'v': CAST(quality AS VARCHAR)}, {'k': 'toxic', 'v': CASE WHEN toxic = 1 THEN '1' WHEN toxic = 0 THEN '0' END}]) AS p FROM notes WHERE has_properties)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tasks of notes: four statuses, six priorities with none, dates that may be missing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = lambda plus: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), plus), "yyyy-MM-dd")
    level = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.concat(F.lit("list/"), (F.col("o_custkey") % 97).cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("note_path"),
        k.alias("line"),
        F.when(k % 13 == 0, "cancelled").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("todo").alias("status"),
        F.concat(F.lit("order "), k.cast("string")).alias("description"),
        F.when(level == "1", "highest").when(level == "2", "high").when(level == "3", "medium").when(level == "4", "low").alias("priority"),
        F.when(k % 4 != 0, day(0)).alias("due"),
        F.when(k % 3 == 0, day(-5)).alias("scheduled"),
        F.when(k % 5 == 0, day(-3)).alias("start"),
        F.when(k % 6 != 0, day(-20)).alias("created"),
        F.when(F.col("o_orderstatus") == "F", day(9)).alias("done"),
        (1600000000000 + (F.col("o_custkey") * 31 % 1000) * 86400000).cast("double").alias("mtime_ms"),
        F.array(F.concat(F.lit("prio/"), level), F.when(k % 2 == 0, "even").otherwise("odd")).alias("tags"),
        F.concat(F.lit("lane "), (k % 5).cast("string")).alias("heading"),
    )


TASKS = """tasks AS (SELECT 'list/'||(o_custkey % 97)||'/'||o_custkey||'.md' AS note_path, o_orderkey AS line, CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'todo' END AS status,
  'order '||o_orderkey AS description, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'highest' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' END AS priority,
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS due, CASE WHEN o_orderkey % 3 = 0 THEN strftime(CAST(o_orderdate AS DATE) - 5, '%Y-%m-%d') END AS scheduled, CASE WHEN o_orderkey % 5 = 0 THEN strftime(CAST(o_orderdate AS DATE) - 3, '%Y-%m-%d') END AS "start", CASE WHEN o_orderkey % 6 <> 0 THEN strftime(CAST(o_orderdate AS DATE) - 20, '%Y-%m-%d') END AS created, CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE) + 9, '%Y-%m-%d') END AS done,
  CAST(1600000000000 + (o_custkey * 31 % 1000) * 86400000 AS DOUBLE) AS mtime_ms, ['prio/'||substr(o_orderpriority, 1, 1), CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags, 'lane '||(o_orderkey % 5) AS heading FROM orders)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): two link texts for each note, as full path, path suffix or base name; some lead nowhere."""
    n = notes(spark, sf_dir).select("doc_id", "path", "type")
    count = n.agg(F.count("*").alias("n"))
    d = n.select("doc_id", "path").join(F.broadcast(count))
    each = d.select("doc_id", F.col("path").alias("source"), F.explode(F.array((7 * F.col("doc_id") + 3) % F.floor(F.col("n") * 6 / 5), 2 * ((5 * F.col("doc_id") + 1) % F.floor(F.col("n") * 3 / 5)))).alias("to"))
    to = n.select(F.col("doc_id").alias("to"), F.col("path").alias("full"), F.concat("type", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("suffix"))
    style = F.col("doc_id") % 3
    full = F.coalesce("full", F.concat(F.lit("missing/"), F.col("to").cast("string"), F.lit(".md")))
    text = F.when(style == 0, full).when(style == 1, F.coalesce("suffix", full)).otherwise(F.col("to").cast("string"))
    return each.join(to, "to", "left").select("source", text.alias("target")).distinct()


REFERENCES = """cnt AS (SELECT count(*) AS n FROM notes), ends AS (SELECT doc_id, path AS source, unnest([(7 * doc_id + 3) % CAST(floor(n * 6 / 5) AS BIGINT), 2 * ((5 * doc_id + 1) % CAST(floor(n * 3 / 5) AS BIGINT))]) AS to_id FROM notes, cnt),
refs AS (SELECT DISTINCT e.source, CASE e.doc_id % 3 WHEN 0 THEN coalesce(t.path, 'missing/'||e.to_id||'.md') WHEN 1 THEN coalesce(t.type||'/'||t.doc_id||'.md', 'missing/'||e.to_id||'.md') ELSE CAST(e.to_id AS VARCHAR) END AS target FROM ends e LEFT JOIN notes t ON t.doc_id = e.to_id),
keys AS (SELECT path, path AS key, 0 AS tier FROM notes UNION ALL SELECT path, substr(path, strpos(path, '/') + 1), 2 FROM notes UNION ALL SELECT path, regexp_extract(path, '[^/]+$'), 2 FROM notes),
asked AS (SELECT source, target, CASE WHEN target LIKE '%.md' THEN target ELSE target||'.md' END AS key FROM refs),
found AS (SELECT source, target, path, row_number() OVER (PARTITION BY source, target ORDER BY tier, length(path), path) AS rn FROM (
  SELECT a.source, a.target, k.path, k.tier FROM asked a JOIN keys k ON k.key = a.key UNION ALL
  SELECT a.source, a.target, n.path, 1 FROM asked a JOIN notes n ON n.path = regexp_extract(a.source, '^(.*/)[^/]*$', 1)||a.key)),
links AS (SELECT DISTINCT r.source, coalesce(f.path, r.target) AS target FROM refs r LEFT JOIN found f ON f.source = r.source AND f.target = r.target AND f.rn = 1)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, bytes): pages as files that are no notes, some without an extension, some hidden."""
    k = F.col("page_id")
    name = F.concat(F.lit("page"), k.cast("string"), F.when(k % 5 == 0, ".png").when(k % 5 == 1, ".Canvas").when(k % 5 == 2, ".tar.gz").when(k % 5 == 3, ".csv").otherwise(""))
    return table(spark, sf_dir, "pages").select(k.alias("page_id"), F.concat(F.lit("files/"), (k % 3).cast("string"), F.when(k % 17 == 0, "/.cache/").otherwise("/"), name).alias("path"), F.octet_length("html").cast("long").alias("bytes"))


FILES = """files AS (SELECT page_id, 'files/'||(page_id % 3)||CASE WHEN page_id % 17 = 0 THEN '/.cache/' ELSE '/' END||'page'||page_id||CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.Canvas' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.csv' ELSE '' END AS path, CAST(strlen(html) AS BIGINT) AS bytes FROM pages)"""


def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): a link to another page from each page that is a file: by whole path, from its own folder (which no dot hides), by name, without extension; some lead nowhere."""
    f = files(spark, sf_dir)
    to = f.select((F.col("page_id") * 3).alias("from_id"), F.col("path").alias("to"))
    style, name = F.col("page_id") % 5, F.regexp_extract("to", r"([^/]*)$", 1)
    text = F.when(F.col("to").isNull(), F.concat(F.lit("nowhere/"), F.col("page_id").cast("string"))).when(style == 0, F.col("to")).when(style == 1, F.concat(F.lit("../"), F.regexp_replace("to", "^files/", ""))).when(style == 2, name).when(style == 3, F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).otherwise(F.concat(F.lit("../../x/.././"), F.col("to")))
    return f.where(visible(F.col("path"))).join(to, F.col("page_id") == F.col("from_id"), "left").select(F.col("path").alias("source"), text.alias("target"))


ASSET_REFERENCES = """pairs AS (SELECT f.page_id, f.path AS source, t.path AS dest FROM files f LEFT JOIN files t ON t.page_id * 3 = f.page_id WHERE f.path NOT LIKE '%/.%'),
asset_links AS (SELECT source, CASE WHEN dest IS NULL THEN 'nowhere/'||page_id ELSE dest END AS target FROM pairs)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dated entries: role is the file, the conversation the section."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 37 + F.col("turn")
    return c.select(F.concat(F.lit("About Me/"), "role", F.lit(".md")).alias("file"), F.col("conv_id").cast("string").alias("section"), F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (key % 700).cast("int")), "yyyy-MM-dd").alias("entry_date"), F.col("text").alias("entry_text"), F.col("turn").alias("entry_index"), F.col("conv_id").alias("entry_key"))


ENTRIES = """entries AS (SELECT 'About Me/'||role||'.md' AS file, CAST(conv_id AS VARCHAR) AS section, strftime(DATE '2023-01-01' + CAST((conv_id * 37 + turn) % 700 AS INTEGER), '%Y-%m-%d') AS entry_date, text AS entry_text, turn AS entry_index, conv_id AS entry_key FROM conversations)"""


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as parsed notes: plain lines, a heading of level 1, 2, 3, 1, ... before every third."""
    plain = F.regexp_replace("text", r"[^\p{L}\p{N} \n.]", " ")
    lines = F.transform(F.split(plain, "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 3).cast("int") % 3), F.lit(" part "), F.floor(i / 3).cast("string"), F.lit("\nx"), x)).otherwise(F.concat(F.lit("x"), x)))
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(lines, "\n").alias("text"))
    return note_rows(d.select("path", F.lit(0.0).alias("mtime_ms"), F.octet_length("text").cast("long").alias("bytes"), "text"))


OUTLINED = """plain AS (SELECT doc_id, string_split(regexp_replace(text, '[^\\p{L}\\p{N} \\n.]', ' ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, k, len(l) AS n, repeat('#', CAST(1 + k % 3 AS INTEGER))||' part '||k||chr(10)||array_to_string(list_transform(l[3 * k + 1 : 3 * k + 3], lambda x: 'x'||x), chr(10)) AS b FROM (SELECT doc_id, l, unnest(range(0, (len(l) + 2) // 3)) AS k FROM plain)),
outlined AS (SELECT a.doc_id, 'notes/'||a.doc_id||'.md' AS path, a.k, 1 + a.k % 3 AS level, 'part '||a.k AS text, string_agg(b.b, chr(10) ORDER BY b.k) AS body FROM blocks a JOIN blocks b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.k < a.k + 3 - a.k % 3 GROUP BY ALL)"""
