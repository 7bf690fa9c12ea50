"""The reference queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions import predicates as P
from vellumlake.functions import ranking
from vellumlake.functions.stems import stem
from vellumlake.operators import fulltext, links, metadata, moves, reading, recall, reports, textindex, vectorindex, vectors
from vellumlake.sources import adapters as A
from vellumlake.sources.adapters import ENTRIES, NOTES, PROPERTIES, REFERENCES, TASKS, table
from vellumlake.sources.store import shared_folder
from vellumlake.streaming import debounce, feed, linkindex, textfeed, vectorfeed
from vellumlake.streaming.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: BM25 in SQL over rows t(id columns, text); parts are single words.
def bm25_sql(source: str, ids: str, text: str, words: list[str], any_term: bool, tail: str, x: str = "") -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS BIGINT) AS f{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(words)))
    idf = lambda i: f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5)))"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(words)))
    hit = (" OR " if any_term else " AND ").join(f"f{i} > 0" for i in range(len(words)))
    return f"""{source}, tok{x} AS (SELECT *, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM t{x}), tf{x} AS (SELECT {ids}, len(w) AS dl, {tf} FROM tok{x}),
st{x} AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM tf{x}), hits{x} AS (SELECT {ids}, round({score}, 6) AS score FROM tf{x}, st{x} WHERE {hit}) {tail}"""


@query(bm25_sql(f"WITH {NOTES}, t AS (SELECT path, type, folder, title, bytes, title||' '||content AS txt FROM notes)", "path, type, folder, title, bytes", "txt", ["that", "with"], False, "SELECT path, title, folder, type, bytes, score FROM hits WHERE type = 'en' ORDER BY score DESC, path LIMIT 20"))
def q01_full_text_search(spark, sf_dir):
    found = fulltext.search(A.notes(spark, sf_dir), "that with", where=F.col("type") == "en")
    return found.select("path", "title", "folder", "type", "bytes", F.round("score", 6).alias("score"))


@query(bm25_sql(f"WITH {NOTES}, t AS (SELECT path, folder, title||' '||content AS txt FROM notes)", "path, folder", "txt", ["idiot", "benchmark", "mit"], True, "SELECT path, score FROM hits WHERE lower(path) LIKE 'src1/%' ORDER BY score DESC, path LIMIT 20"))
def q01_any_term_in_folder(spark, sf_dir):
    found = fulltext.search(A.notes(spark, sf_dir), "about the idiot OR benchmark, MIT", where=P.in_folder(F.col("path"), "SRC1/"), any_term=True)
    return found.select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {NOTES}, hit AS (SELECT path, len(regexp_extract_all(' '||array_to_string(list_filter(string_split_regex(lower(title||' '||content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), '  ')||' ', ' mit  license ')) AS n FROM notes) SELECT path, CAST(n AS INTEGER) AS n_places FROM hit WHERE n > 0""")
def q01_phrase_places(spark, sf_dir):
    n = A.notes(spark, sf_dir).select("path", fulltext.tokens(F.concat_ws(" ", "title", "content")).alias("words"))
    return n.select("path", fulltext.frequency(F.col("words"), ["mit", "license"]).alias("n_places")).where("n_places > 0")


#: All words of the driver's tables that have the stems of "hands" and "resting".
FORMS = (["hand", "handing", "handed", "handes"], ["rest", "restes", "rested", "resting"])


def stems_sql(tail: str) -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: list_contains({forms}, x))) AS BIGINT) AS f{i}" for i, forms in enumerate(FORMS))
    idf = lambda i: f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5)))"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(2))
    return f"""WITH {NOTES}, tok AS (SELECT path, list_transform(list_filter(string_split_regex(lower(title||' '||content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: strip_accents(x)) AS w FROM notes), tf AS (SELECT path, len(w) AS dl, {tf} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (f0 > 0) AS df0, count(*) FILTER (f1 > 0) AS df1 FROM tf), hits AS (SELECT path, f0, f1, round({score}, 6) AS score FROM tf, st) {tail}"""


def _indexed(spark, sf_dir, query: str, any_term: bool = False):
    folder = shared_folder(spark)
    textindex.build(A.texts(spark, sf_dir), F.concat_ws(" ", "title", "content"), folder)
    return textindex.search(spark, folder, query, any_term=any_term).select("path", F.round("score", 6).alias("score"))


@query(stems_sql("SELECT path, score FROM hits WHERE f0 > 0 AND f1 > 0"))
def q01_indexed_search(spark, sf_dir):
    return _indexed(spark, sf_dir, "hands resting")


@query(stems_sql("SELECT path, score FROM hits WHERE f0 > 0 OR f1 > 0 ORDER BY score DESC, path LIMIT 30"))
def q01_indexed_any_term(spark, sf_dir):
    return _indexed(spark, sf_dir, "what about Hands, Resting", any_term=True).orderBy(F.desc("score"), "path").limit(30)


@query(f"""WITH {NOTES}, hit AS (SELECT path, len(regexp_extract_all(' '||array_to_string(list_filter(string_split_regex(lower(title||' '||content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), '  ')||' ', ' (licensed|license)  under ')) AS n FROM notes) SELECT path, CAST(n AS INTEGER) AS n_places FROM hit WHERE n > 0""")
def q01_indexed_phrase(spark, sf_dir):
    rows = textindex.postings(A.texts(spark, sf_dir), F.concat_ws(" ", "title", "content")).where(F.col("term").isin(stem("licensing"), stem("under")))
    places = rows.groupBy("path").agg(*[F.max(F.when(F.col("term") == stem(w), F.col("places"))).alias(w) for w in ("licensing", "under")])
    return places.select("path", F.size(F.array_intersect(F.transform("licensing", lambda x: x + 1), "under")).alias("n_places")).where("n_places > 0")


SHOWN = ["the", "and", "license", "que", "der"]


@query(f"""WITH d AS (SELECT doc_id, string_split_regex(trim(coalesce(text, '')), '[\\s\\x0B]+') AS every FROM documents),
h AS (SELECT doc_id, i, t FROM (SELECT doc_id, i - 1 AS i, list_position({SHOWN}, regexp_replace(lower(every[i]), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS t FROM (SELECT doc_id, every, unnest(range(1, len(every) + 1)) AS i FROM d)) WHERE t > 0),
e AS (SELECT a.doc_id, a.i, b.t, max(b.i) AS last FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.i <= a.i AND b.i > a.i - 30 GROUP BY ALL),
c AS (SELECT doc_id, i, count(*) AS n_terms, i - min(last) + 1 AS length, min(last) AS start FROM e GROUP BY doc_id, i),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, length, start) AS r FROM c),
s AS (SELECT d.doc_id, every, n_terms, length, start, greatest(0, least(coalesce(start - (30 - length) // 2, 0), len(every) - 30)) AS b FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND r = 1)
SELECT doc_id, CAST(coalesce(n_terms, 0) AS INTEGER) AS n_terms, CAST(coalesce(length, 0) AS INTEGER) AS length, CAST(coalesce(start, -1) AS INTEGER) AS start, sha256(CASE WHEN b > 0 THEN '...' ELSE '' END || array_to_string(every[b + 1 : b + 30], ' ') || CASE WHEN b + 30 < len(every) THEN '...' ELSE '' END) AS digest FROM s""")
def x5_best_snippets(spark, sf_dir):
    """For each document the best stretch of 30 words, and what a search would show of it."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", fulltext.shown_words(text).alias("every"), fulltext.best_window(fulltext.plain_words(text), SHOWN, 30).alias("w"))
    digest = F.sha2(fulltext.shown(F.col("every"), F.col("w")), 256)
    return d.select("doc_id", F.coalesce("w.n_terms", F.lit(0)).alias("n_terms"), F.coalesce("w.length", F.lit(0)).alias("length"), F.coalesce("w.start", F.lit(-1)).alias("start"), digest.alias("digest"))


def _vector(spark, sf_dir, vec_id: int = 7) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


VECTORS = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, vec_id // 3 AS note, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {VECTORS}, d AS (SELECT vec_id, note, round(list_distance(e, q), 6) AS distance FROM v, q WHERE label < 3 ORDER BY distance, vec_id LIMIT 30), b AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY distance, vec_id) AS rn FROM d) SELECT vec_id, note, distance FROM b WHERE rn = 1")
def q03_vector_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("note"), "label", "embedding")
    hits = vectors.nearest(rows, "embedding", _vector(spark, sf_dir), 30, ("vec_id",), where=F.col("label") < 3)
    return vectors.best_of_each(hits, "note", ("vec_id",)).select("vec_id", "note", "distance")


@query(f"WITH {VECTORS} SELECT vec_id, label, round(list_distance(e, q), 6) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 25")
def q03_indexed_neighbours(spark, sf_dir):
    """The nearest vectors, exact, from the lists of an inverted file that may hold them."""
    folder = shared_folder(spark)
    vectorindex.build(table(spark, sf_dir, "embeddings"), "embedding", folder)
    found, _ = vectorindex.search(spark, folder, "embedding", _vector(spark, sf_dir), 25, ("vec_id",))
    return found.select("vec_id", "label", "distance")


@query(f"WITH {VECTORS} SELECT vec_id, round(1 - list_cosine_similarity(e, q), 6) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 20")
def q04_cosine_search(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir), 20, ("vec_id",), "cosine").select("vec_id", "distance")


@query(bm25_sql("WITH t AS (SELECT conv_id, turn, role, text FROM conversations)", "conv_id, turn, role", "text", ["the", "of"], False, "SELECT conv_id, turn, role, score FROM hits ORDER BY score DESC, conv_id, turn LIMIT 20"))
def q05_file_content_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return fulltext.bm25(c, F.col("text"), [["the"], ["of"]]).select("conv_id", "turn", "role", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)


def _candidates(spark, sf_dir):
    """Text hits and nearest vectors of documents, fused."""
    text = fulltext.search(A.notes(spark, sf_dir), "that with").select("doc_id", F.round("score", 6).alias("s"))
    near = vectors.nearest(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", _vector(spark, sf_dir), 20, ("doc_id",))
    return text, near, vectors.fused([text, near], "doc_id", [[F.desc("s"), F.col("doc_id")], [F.col("distance"), F.col("doc_id")]])


_FUSED = bm25_sql(f"WITH {NOTES}, {VECTORS}, t AS (SELECT doc_id, path, title||' '||content AS txt FROM notes)", "doc_id, path", "txt", ["that", "with"], False, """, txt AS (SELECT doc_id, score FROM hits ORDER BY score DESC, path LIMIT 20),
near AS (SELECT vec_id AS doc_id, round(list_distance(e, q), 6) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 20),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM txt UNION ALL SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) FROM near),
fused AS (SELECT doc_id, sum(1.0 / (60 + r) + CASE WHEN r = 1 THEN 0.05 WHEN r <= 3 THEN 0.02 ELSE 0 END) AS f FROM ranks GROUP BY doc_id)""")


@query(_FUSED + " SELECT doc_id, round(f, 6) AS score FROM fused")
def q02_rank_fusion(spark, sf_dir):
    return _candidates(spark, sf_dir)[2].select("doc_id", F.round("score", 6).alias("score"))


@query(_FUSED + """, top AS (SELECT f.doc_id, round(f, 6) AS f, coalesce(1 - n.distance, -1) AS p FROM fused f LEFT JOIN near n ON n.doc_id = f.doc_id ORDER BY round(f, 6) DESC, f.doc_id LIMIT 20),
nrm AS (SELECT doc_id, row_number() OVER (ORDER BY f DESC, doc_id) AS r, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS a, (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) AS b FROM top),
bl AS (SELECT doc_id, CASE WHEN r <= 3 THEN 0.75 WHEN r <= 10 THEN 0.5 ELSE 0.4 END AS w, a, b FROM nrm),
x AS (SELECT doc_id, CAST(w * a + (1 - w) * b AS DOUBLE) AS s FROM bl)
SELECT doc_id, CASE WHEN s = 0 THEN 0 ELSE round(s * pow(10.0, 3 - floor(log10(abs(s))))) / pow(10.0, 3 - floor(log10(abs(s)))) END AS score FROM x""")
def q02_hybrid_search(spark, sf_dir):
    _, near, fused = _candidates(spark, sf_dir)
    top = fused.select("doc_id", F.round("score", 6).alias("f")).join(near.select("doc_id", "distance"), "doc_id", "left").select("doc_id", "f", F.coalesce(1 - F.col("distance"), F.lit(-1.0)).alias("p")).orderBy(F.desc("f"), "doc_id").limit(20)
    return vectors.reranked(top, "f", "p", "doc_id").select("doc_id", "score")


_NOTE_HITS = bm25_sql(f"WITH {NOTES}, {A.FILES}, {VECTORS}, t AS (SELECT path, type, title||' '||content AS txt FROM notes)", "path, type", "txt", ["that", "with"], False, "")
_FILE_HITS = bm25_sql(_NOTE_HITS + ", t2 AS (SELECT f.path, p.url FROM pages p JOIN files f ON f.page_id = p.page_id)", "path", "url", ["blog"], False, "", "2")


@query(_FILE_HITS + """, a AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS r FROM hits WHERE type = 'en'), b AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS r FROM hits2),
near AS (SELECT vec_id, label, round(list_distance(e, q), 6) AS distance FROM v, q),
c AS (SELECT path, row_number() OVER (ORDER BY distance, path) AS r FROM near JOIN notes ON doc_id = vec_id WHERE near.label < 5), d AS (SELECT path, row_number() OVER (ORDER BY distance, path) AS r FROM near JOIN files ON page_id = vec_id WHERE near.label >= 5),
legs AS (SELECT * FROM a WHERE r <= 60 UNION ALL SELECT * FROM b WHERE r <= 60 UNION ALL SELECT * FROM c WHERE r <= 60 UNION ALL SELECT * FROM d WHERE r <= 60),
fused AS (SELECT path, round(sum(1.0 / (60 + r) + CASE WHEN r = 1 THEN 0.05 WHEN r <= 3 THEN 0.02 ELSE 0 END), 6) AS score FROM legs GROUP BY path),
have AS (SELECT path, 'note' AS kind, title, type FROM notes UNION ALL SELECT path, 'file', regexp_extract(path, '[^/]*$'), NULL FROM files)
SELECT path, kind, title, score FROM fused JOIN have USING (path) WHERE kind = 'file' OR type = 'en' ORDER BY score DESC, path LIMIT 20""")
def q02_hybrid_with_files(spark, sf_dir):
    """Text and vectors of notes and of other files, fused; the type asked for holds for notes that vectors alone found, too."""
    notes, files, most = A.notes(spark, sf_dir), A.files(spark, sf_dir), vectors.candidates(20)
    english, v = F.col("type") == "en", table(spark, sf_dir, "embeddings")
    urls = files.join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    text = fulltext.search(notes, "that with", english, most).select("path", F.round("score", 6).alias("s"))
    named = fulltext.bm25(urls.select("path", "url"), F.col("url"), [["blog"]]).select("path", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "path").limit(most)
    near = lambda rows, key, label: vectors.nearest(v.where(label).join(rows.select(F.col(key).alias("vec_id"), "path"), "vec_id"), "embedding", _vector(spark, sf_dir), most, ("path",)).select("path", "distance")
    legs = [text, named, near(notes, "doc_id", F.col("label") < 5), near(files, "page_id", F.col("label") >= 5)]
    by_score, by_distance = [F.desc("s"), F.col("path")], [F.col("distance"), F.col("path")]
    found = vectors.hydrated(vectors.fused(legs, "path", [by_score, by_score, by_distance, by_distance]), notes, files)
    return found.where((F.col("kind") == "file") | english).orderBy(F.desc("score"), "path").limit(20).select("path", "kind", "title", "score")


@query(bm25_sql(f"WITH {ENTRIES}, t AS (SELECT * FROM entries)", "file, section, entry_date, entry_index, entry_key", "entry_text", ["the", "and"], False, "SELECT file, section, entry_date, entry_index, score FROM hits ORDER BY score DESC, entry_key, entry_index LIMIT 50"))
def q06_memory_recall(spark, sf_dir):
    hits = fulltext.bm25(A.entries(spark, sf_dir), F.col("entry_text"), [["the"], ["and"]])
    return metadata.recall(hits).select("file", "section", "entry_date", "entry_index", F.round("score", 6).alias("score"))


def _entries(spark, sf_dir):
    e = A.entries(spark, sf_dir)
    return e.select((F.col("entry_key") * 100 + F.col("entry_index")).alias("id"), "file", "section", "entry_date", "entry_index", "entry_text")


def _entry_vectors(spark, sf_dir):
    """The nearest of the vectors that first turns of conversations have."""
    v = table(spark, sf_dir, "embeddings").join(_entries(spark, sf_dir).select("id"), F.col("id") == F.col("vec_id") * 100 + 1)
    return vectors.nearest(v.select("id", "embedding"), "embedding", _vector(spark, sf_dir), recall.NEAREST, ("id",)).select("id", "distance")


def _hits(spark, sf_dir, words, any_term=False):
    return fulltext.bm25(_entries(spark, sf_dir), F.col("entry_text"), words, any_term).select("id", F.round("score", 6).alias("score"))


def recall_sql(words: list[str], any_term: bool, tail: str) -> str:
    return bm25_sql(f"WITH {ENTRIES}, {VECTORS}, e AS (SELECT entry_key * 100 + entry_index AS id, * FROM entries), t AS (SELECT * FROM e)", "id", "entry_text", words, any_term, f""", near AS (SELECT id, round(list_distance(e, q), 6) AS distance FROM (SELECT vec_id * 100 + 1 AS id, e FROM v) JOIN (SELECT id FROM e) USING (id), q ORDER BY distance, id LIMIT 100),
ranks AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM hits UNION ALL SELECT id, row_number() OVER (ORDER BY distance, id) FROM near),
fused AS (SELECT id, round(sum(1.0 / (60 + r) + CASE WHEN r = 1 THEN 0.05 WHEN r <= 3 THEN 0.02 ELSE 0 END), 6) AS fused FROM ranks GROUP BY id),
placed AS (SELECT *, row_number() OVER (ORDER BY fused DESC, id) AS place FROM fused), cand AS (SELECT p.id, p.fused, h.id IS NOT NULL AS lexical, n.distance FROM placed p LEFT JOIN hits h ON h.id = p.id LEFT JOIN near n ON n.id = p.id WHERE h.id IS NOT NULL OR place <= 120) {tail}""")


@query(recall_sql(["thing", "that"], False, ", k AS (SELECT * FROM cand WHERE lexical OR distance <= (SELECT min(distance) FROM cand) + 0.15 ORDER BY fused DESC, id LIMIT 50) SELECT file, section, entry_date, entry_index FROM k JOIN e USING (id)"))
def q06_recall_hybrid(spark, sf_dir):
    """Text and vectors without a reranker: vectors alone count within a margin of the nearest."""
    found = recall.found(_entries(spark, sf_dir), _hits(spark, sf_dir, [["thing"], ["that"]]), _entry_vectors(spark, sf_dir))
    return recall.told(recall.relevant(found))[1].select("file", "section", "entry_date", "entry_index")


RERANK = "1 / (1 + exp(-(12 - 8 * distance)))"


@query(recall_sql(["thing", "that"], False, f", p AS (SELECT *, coalesce({RERANK}, 0) AS p FROM cand), k AS (SELECT * FROM p WHERE lexical OR p >= least(0.05, greatest(0.001, 0.1 * coalesce((SELECT max(p) FROM p WHERE NOT lexical), 0.5)))) SELECT count(*) AS total FROM k"))
def q06_recall_reranked(spark, sf_dir):
    """How many entries stay beside the best of those that vectors alone found, by a stand-in for a reranker's probability."""
    found = recall.found(_entries(spark, sf_dir), _hits(spark, sf_dir, [["thing"], ["that"]]), _entry_vectors(spark, sf_dir))
    return recall.told(recall.relevant(found, F.expr(RERANK)))[0]


@query(recall_sql(["of", "nowhere"], True, "SELECT file, section, entry_date, entry_index FROM (SELECT * FROM hits ORDER BY score DESC, id LIMIT 50) JOIN e USING (id)"))
def q06_recall_rescued(spark, sf_dir):
    """No entry has all words and no vectors are at hand: those with any of them."""
    e = _entries(spark, sf_dir)
    all_terms = _hits(spark, sf_dir, [["of"], ["nowhere"]]).join(e, "id").select(*e.columns, F.col("score").alias("relevance"))
    return recall.told(recall.rescued(all_terms, _hits(spark, sf_dir, [["of"], ["nowhere"]], True), e))[1].select("file", "section", "entry_date", "entry_index")


LISTED = "path, title, mtime_ms"


@query(f"WITH {NOTES} SELECT {LISTED} FROM notes WHERE list_contains(tags, 'q') OR len(list_filter(tags, lambda x: lower(x) LIKE 'q/%')) > 0 ORDER BY mtime_ms DESC, path LIMIT 20")
def q07_search_by_tag(spark, sf_dir):
    return metadata.by_tag(A.notes(spark, sf_dir), "Q").select("path", "title", "mtime_ms")


@query(f"WITH {NOTES} SELECT {LISTED} FROM notes WHERE list_contains(tags, 'flag/toxic') ORDER BY mtime_ms DESC, path LIMIT 20")
def q07_search_by_exact_tag(spark, sf_dir):
    return metadata.by_tag(A.notes(spark, sf_dir), "flag/toxic", exact=True).select("path", "title", "mtime_ms")


@query(f"WITH {NOTES} SELECT {LISTED} FROM notes WHERE lower(path) LIKE 'src2/en/%' AND lower(path) NOT LIKE 'src2/en/%/%' ORDER BY mtime_ms DESC, path LIMIT 20")
def q08_search_by_folder(spark, sf_dir):
    return metadata.by_folder(A.notes(spark, sf_dir), "SRC2/en/", recursive=False).select("path", "title", "mtime_ms")


@query(f"WITH {TASKS} SELECT note_path, line, status, priority, due, scheduled FROM tasks WHERE status IN ('todo', 'in_progress') AND due < '1997-01-01' AND (priority IN ('high') OR priority IS NULL) AND lower(note_path) LIKE 'list/%' ORDER BY due ASC NULLS LAST, scheduled ASC NULLS LAST, \"start\" DESC NULLS LAST, created DESC NULLS LAST, mtime_ms DESC, note_path, line LIMIT 50")
def q09_list_tasks(spark, sf_dir):
    _, page = metadata.task_list(A.tasks(spark, sf_dir), dates={"due": {"before": "1997-01-01"}}, priority=["high", "none"], folder="list")
    return page.select("note_path", "line", "status", "priority", "due", "scheduled")


@query(f"WITH {TASKS} SELECT note_path, line, priority, due FROM tasks WHERE len(list_filter(tags, lambda x: x = 'prio' OR lower(x) LIKE 'prio/%')) > 0 AND heading IN ('lane 1', 'lane 4') ORDER BY CASE priority WHEN 'highest' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 4 WHEN 'lowest' THEN 5 ELSE 3 END, note_path, line LIMIT 40")
def q09_tasks_by_priority(spark, sf_dir):
    _, page = metadata.task_list(A.tasks(spark, sf_dir), status=["all"], tag="prio", heading=["lane 1", "lane 4"], limit=40, sort_by="priority")
    return page.select("note_path", "line", "priority", "due")


@query(f"WITH {TASKS} SELECT count(*) AS total FROM tasks WHERE status = 'done' AND done > '1995-06-30' AND scheduled = '1996-03-01'")
def q09_count_tasks(spark, sf_dir):
    return metadata.task_list(A.tasks(spark, sf_dir), status=["done"], dates={"done": {"after": "1995-06-30"}, "scheduled": {"on": "1996-03-01"}})[0]


@query(f"WITH {TASKS} SELECT note_path, line, \"start\", created FROM tasks WHERE status IN ('todo', 'in_progress') ORDER BY \"start\" DESC NULLS LAST, due ASC NULLS LAST, scheduled ASC NULLS LAST, created DESC NULLS LAST, mtime_ms DESC, note_path, line LIMIT 50")
def q09_tasks_by_start(spark, sf_dir):
    return metadata.task_list(A.tasks(spark, sf_dir), sort_by="start")[1].select("note_path", "line", "start", "created")


@query(f"WITH {TASKS} SELECT note_path, line, created, due FROM tasks WHERE status IN ('todo', 'in_progress') ORDER BY created ASC NULLS LAST, due ASC NULLS LAST, scheduled ASC NULLS LAST, \"start\" ASC NULLS LAST, mtime_ms DESC, note_path, line LIMIT 50")
def q09_tasks_oldest_first(spark, sf_dir):
    return metadata.task_list(A.tasks(spark, sf_dir), sort_by="created", direction="asc")[1].select("note_path", "line", "created", "due")


@query(f"WITH {TASKS} SELECT note_path, line, done FROM tasks WHERE status = 'done' ORDER BY done DESC NULLS LAST, mtime_ms DESC, note_path, line LIMIT 30")
def q09_tasks_lately_done(spark, sf_dir):
    return metadata.task_list(A.tasks(spark, sf_dir), status=["done"], sort_by="done", limit=30)[1].select("note_path", "line", "done")


@query(f"WITH {TASKS} SELECT note_path, line FROM tasks WHERE status IN ('todo', 'in_progress') ORDER BY mtime_ms DESC, note_path, line LIMIT 30")
def q09_tasks_of_newest_notes(spark, sf_dir):
    return metadata.task_list(A.tasks(spark, sf_dir), sort_by="note_mtime", limit=30)[1].select("note_path", "line")


@query(f"WITH {NOTES}, x AS (SELECT DISTINCT path, unnest(tags) AS tag FROM notes) SELECT tag, count(*) AS n_notes FROM x GROUP BY tag")
def q10_list_all_tags(spark, sf_dir):
    return metadata.all_tags(A.notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT path, created, mtime_ms FROM notes ORDER BY mtime_ms DESC, path LIMIT 20")
def q11_recent_notes(spark, sf_dir):
    return metadata.recent(A.notes(spark, sf_dir)).select("path", "created", "mtime_ms")


@query(f"WITH {NOTES} SELECT path, created FROM notes ORDER BY created DESC NULLS LAST, path LIMIT 30")
def q11_recently_created(spark, sf_dir):
    return metadata.recent(A.notes(spark, sf_dir), "created", 30).select("path", "created")


@query(f"""WITH {NOTES}, {PROPERTIES}, p2 AS (SELECT path, p.k AS key, p.v AS v FROM props WHERE p.v IS NOT NULL), c AS (SELECT key, count(DISTINCT path) AS n_notes FROM p2 GROUP BY key),
vals AS (SELECT key, v, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, v) AS r FROM p2 GROUP BY key, v), s AS (SELECT key, string_agg(v, '|' ORDER BY r) AS samples FROM vals WHERE r <= 3 GROUP BY key) SELECT c.key, n_notes, samples FROM c LEFT JOIN s ON c.key = s.key""")
def q12_property_keys(spark, sf_dir):
    return metadata.property_keys(A.notes(spark, sf_dir)).select("key", "n_notes", F.array_join("samples", "|").alias("samples"))


@query(f"WITH {NOTES}, {PROPERTIES} SELECT p.v AS text, count(*) AS n FROM props WHERE p.k = 'toxic' AND p.v IS NOT NULL AND lower(path) LIKE 'src3/%' GROUP BY p.v")
def q13_property_values(spark, sf_dir):
    return metadata.property_values(A.notes(spark, sf_dir), "toxic", folder="src3")


@query(f"WITH {NOTES} SELECT {LISTED} FROM notes WHERE has_properties AND toxic = 1 ORDER BY mtime_ms DESC, path LIMIT 20")
def q14_search_by_property(spark, sf_dir):
    return metadata.by_property(A.notes(spark, sf_dir), "toxic", "1").select("path", "title", "mtime_ms")


@query(f"WITH {NOTES} SELECT path FROM notes WHERE has_properties AND quality = 1 AND toxic = 0 AND created IS NOT NULL AND substr(created, 1, 10) > '2024-03-01' AND substr(created, 1, 10) < '2024-09-01'")
def q14_typed_filters(spark, sf_dir):
    n, p = A.notes(spark, sf_dir), F.col("properties")
    return n.where(P.property_equals(p, "quality", 1) & P.property_equals(p, "toxic", False) & P.day_bounds(F.substr("created", F.lit(1), F.lit(10)), {"after": "2024-03-01", "before": "2024-09-01"})).select("path")


def _links(spark, sf_dir):
    return links.resolved(A.references(spark, sf_dir), A.notes(spark, sf_dir))


GRAPH = f"WITH {NOTES}, {REFERENCES}"
HUB = "(SELECT target FROM links GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"


@query(f"{GRAPH} SELECT source, target FROM links")
def q15_resolved_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"{GRAPH} SELECT n.path, n.title, n.bytes FROM links l JOIN notes n ON n.path = l.source WHERE l.target = (SELECT path FROM notes WHERE doc_id = 12)")
def q15_backlinks(spark, sf_dir):
    n = A.notes(spark, sf_dir)
    path = n.where("doc_id = 12").first()["path"]
    return links.backlinks(_links(spark, sf_dir), n, path)


@query(f"{GRAPH} SELECT l.target AS path, n.title, n.path IS NOT NULL AS exists, 'note' AS kind, n.bytes, n.path IS NULL AND starts_with(l.target, 'missing/') AS forward_ref FROM links l LEFT JOIN notes n ON n.path = l.target WHERE l.source = (SELECT path FROM notes WHERE doc_id = 171)")
def q16_outgoing_links(spark, sf_dir):
    n = A.notes(spark, sf_dir)
    return links.outgoing(_links(spark, sf_dir), n, n.where("doc_id = 171").first()["path"], "missing")


@query(f"{GRAPH} SELECT path, title, mtime_ms FROM notes n WHERE lower(path) NOT LIKE 'src1/%' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.target = n.path AND l.source <> l.target) ORDER BY mtime_ms DESC, path LIMIT 50")
def q17_orphans(spark, sf_dir):
    return links.orphans(_links(spark, sf_dir), A.notes(spark, sf_dir), ["src1"])


@query(f"{GRAPH}, b AS (SELECT DISTINCT target FROM links WHERE target NOT IN (SELECT path FROM notes)) SELECT count(*) FILTER (NOT starts_with(target, 'missing/')) AS n_broken, count(*) FILTER (starts_with(target, 'missing/')) AS n_excluded FROM b")
def q18_broken_links(spark, sf_dir):
    return links.broken(_links(spark, sf_dir), A.notes(spark, sf_dir), "missing/")


MOVED = "CASE WHEN {0} IN (SELECT path FROM notes WHERE type = 'de') THEN 'archive/' || substr({0}, strpos({0}, '/') + 1) || '.moved.md' ELSE {0} END"


@query(f"{GRAPH} SELECT DISTINCT {MOVED.format('source')} AS source, {MOVED.format('target')} AS target FROM links")
def u4_links_after_moves(spark, sf_dir):
    """The link table after all German notes have moved and been renamed, from link texts that were written anew where they had to be: each leads where it led."""
    n, refs = A.notes(spark, sf_dir), A.references(spark, sf_dir)
    new = F.concat(F.lit("archive/"), F.regexp_replace("path", "^[^/]*/", ""), F.lit(".moved.md"))
    gone = n.where("type = 'de'").select(F.col("path").alias("old"), new.alias("new"))
    return links.resolved(moves.moved_links(refs, n, gone), moves.renamed(n.select("path"), "path", gone))


ASSETS = f"WITH {A.FILES}, {A.ASSET_REFERENCES}"


@query(f"{ASSETS} SELECT source, target FROM asset_links")
def q15_resolved_file_links(spark, sf_dir):
    return links.resolved(A.asset_references(spark, sf_dir), A.notes(spark, sf_dir), A.files(spark, sf_dir))


@query(f"{ASSETS} SELECT source AS path, regexp_extract(source, '[^/]*$') AS title, f.bytes FROM asset_links l JOIN files f ON f.path = l.source WHERE target = (SELECT path FROM files WHERE page_id = 2)")
def q15_backlinks_of_file(spark, sf_dir):
    f = A.files(spark, sf_dir)
    found = links.resolved(A.asset_references(spark, sf_dir), A.notes(spark, sf_dir), f)
    return links.backlinks(found, A.notes(spark, sf_dir), f.where("page_id = 2").first()["path"], f)


@query(f"{ASSETS} SELECT target AS path, CAST(NULL AS VARCHAR) AS title, f.path IS NOT NULL AS exists, CASE WHEN f.path IS NOT NULL THEN 'file' ELSE 'note' END AS kind, f.bytes, false AS forward_ref FROM asset_links l LEFT JOIN files f ON f.path = l.target WHERE l.source = (SELECT path FROM files WHERE page_id = 6)")
def q16_outgoing_file_links(spark, sf_dir):
    f = A.files(spark, sf_dir)
    found = links.resolved(A.asset_references(spark, sf_dir), A.notes(spark, sf_dir), f)
    return links.outgoing(found, A.notes(spark, sf_dir), f.where("page_id = 6").first()["path"], None, f)


@query(f"{ASSETS} SELECT count(*) FILTER (NOT starts_with(target, 'nowhere/1')) AS n_broken, count(*) FILTER (starts_with(target, 'nowhere/1')) AS n_excluded FROM (SELECT DISTINCT target FROM asset_links WHERE target NOT IN (SELECT path FROM files))")
def q18_broken_file_links(spark, sf_dir):
    found = links.resolved(A.asset_references(spark, sf_dir), A.notes(spark, sf_dir), A.files(spark, sf_dir))
    return links.broken(found.withColumn("target", F.regexp_replace("target", "^nowhere/1", "nowhere/1/")), A.notes(spark, sf_dir), "nowhere/1", A.files(spark, sf_dir))


@query(f"WITH {NOTES} SELECT {LISTED} FROM notes WHERE mtime_ms >= epoch_ms(TIMESTAMP '2024-02-01') AND mtime_ms < epoch_ms(TIMESTAMP '2024-02-02') ORDER BY mtime_ms DESC, path LIMIT 50")
def q19_modified_on_date(spark, sf_dir):
    return metadata.modified_on(A.notes(spark, sf_dir), "2024-02-01").select("path", "title", "mtime_ms")


@query(f"WITH {NOTES} SELECT count(*) AS n_notes, count(*) FILTER (len(tags) = 0) AS n_untagged, count(*) FILTER (NOT has_properties) AS n_without_properties, CAST(sum(bytes) AS BIGINT) AS bytes FROM notes")
def q20_vault_stats(spark, sf_dir):
    return metadata.stats(A.notes(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT file, section, sha256(string_agg(entry_date||': '||entry_text, chr(10) ORDER BY entry_key, entry_index)) AS digest FROM entries GROUP BY file, section")
def q21_memory_section_text(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entry_key", "entry_index", F.concat_ws(": ", "entry_date", "entry_text").alias("line")))), lambda s: s["line"])
    return A.entries(spark, sf_dir).groupBy("file", "section").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


@query(f"WITH {ENTRIES} SELECT file, section, count(*) AS n_entries, min(entry_date) AS first_date, max(entry_date) AS last_date FROM entries GROUP BY file, section")
def q22_memory_files(spark, sf_dir):
    return metadata.memory_files(A.entries(spark, sf_dir))


@query(f"WITH {NOTES} SELECT split_part(path, '/', 1) AS folder, count(*) AS n_notes FROM notes GROUP BY 1")
def q23_folder_counts(spark, sf_dir):
    return metadata.folder_counts(A.notes(spark, sf_dir))


@query(f"WITH {NOTES}, {PROPERTIES}, c AS (SELECT p.k AS key, count(DISTINCT path) AS n_notes FROM props WHERE p.v IS NOT NULL GROUP BY 1) SELECT key, n_notes, round(n_notes / (SELECT count(*) FROM notes), 6) AS share, n_notes / (SELECT count(*) FROM notes) < 0.05 AS is_low FROM c")
def q23_property_adoption(spark, sf_dir):
    return metadata.adoption(A.notes(spark, sf_dir))


@query(f"WITH {TASKS} SELECT CASE WHEN due < '1996-01-01' THEN 'overdue' WHEN due = '1996-01-01' THEN 'today' WHEN due = '1996-01-02' THEN 'tomorrow' END AS bucket, count(*) AS n_tasks FROM tasks WHERE status IN ('todo', 'in_progress') AND due <= '1996-01-02' GROUP BY 1")
def q24_daily_review(spark, sf_dir):
    t = A.tasks(spark, sf_dir).where(F.col("status").isin(P.statuses(["not_done"])) & (F.col("due") <= "1996-01-02"))
    bucket = F.when(F.col("due") < "1996-01-01", "overdue").when(F.col("due") == "1996-01-01", "today").otherwise("tomorrow")
    return t.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_tasks"))


@query("WITH a AS (SELECT role AS file, sha256(text) AS hash, row_number() OVER (PARTITION BY role, sha256(text) ORDER BY turn, conv_id) AS place FROM conversations), n AS (SELECT role, turn, conv_id, CASE WHEN turn = 1 THEN text || ' (edited)' ELSE text END AS text FROM conversations), b AS (SELECT role AS file, sha256(text) AS hash, row_number() OVER (PARTITION BY role, sha256(text) ORDER BY turn, conv_id) AS place FROM n) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NOT NULL AND b.file IS NOT NULL THEN 'keep' WHEN b.file IS NOT NULL THEN 'insert' ELSE 'delete' END AS action, count(*) AS n FROM a FULL JOIN b ON a.file = b.file AND a.hash = b.hash AND a.place = b.place GROUP BY 1, 2")
def q25_reconcile_all_entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    snapshot = lambda text: c.select("conv_id", F.col("role").alias("file"), F.sha2(text, 256).alias("hash"), F.col("turn").alias("entry_index"))
    edited = F.when(F.col("turn") == 1, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    return metadata.reconciled(snapshot(F.col("text")), snapshot(edited)).groupBy("file", "action").agg(F.count("*").alias("n"))


@query(f"""{GRAPH}, {PROPERTIES}, {ENTRIES} SELECT 'folder' AS part, * FROM (SELECT split_part(path, '/', 1) AS name, count(*) AS n FROM notes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) UNION ALL
SELECT 'tag', * FROM (SELECT tag, count(*) AS n FROM (SELECT DISTINCT path, unnest(tags) AS tag FROM notes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) UNION ALL
SELECT 'property', * FROM (SELECT p.k, count(DISTINCT path) FROM props WHERE p.v IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) UNION ALL
SELECT 'recent', * FROM (SELECT path, CAST(mtime_ms AS BIGINT) FROM notes ORDER BY mtime_ms DESC, path LIMIT 20) UNION ALL
SELECT 'memory', file, count(*) FROM entries GROUP BY file UNION ALL
SELECT 'orphan', * FROM (SELECT path, CAST(mtime_ms AS BIGINT) FROM notes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.target = n.path AND l.source <> l.target) ORDER BY mtime_ms DESC, path LIMIT 20) UNION ALL
SELECT 'count', unnest(['n_notes', 'n_untagged', 'n_without_properties', 'bytes']), unnest([count(*), count(*) FILTER (len(tags) = 0), count(*) FILTER (NOT has_properties), CAST(sum(bytes) AS BIGINT)]) FROM notes UNION ALL
SELECT 'count', 'n_broken', count(*) FROM (SELECT DISTINCT target FROM links WHERE target NOT IN (SELECT path FROM notes))""")
def q23_orientation(spark, sf_dir):
    return reports.orientation(A.notes(spark, sf_dir), _links(spark, sf_dir), A.entries(spark, sf_dir))


@query(f"""WITH {TASKS}, {NOTES}, {ENTRIES}, b AS (SELECT CASE WHEN due < '1996-06-10' THEN 'overdue' WHEN due = '1996-06-10' THEN 'due' WHEN due = '1996-06-11' THEN 'tomorrow' WHEN "start" = '1996-06-10' OR scheduled = '1996-06-10' THEN 'begins' END AS bucket FROM tasks WHERE status IN ('todo', 'in_progress'))
SELECT 'task' AS part, bucket AS name, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 2 UNION ALL SELECT 'task', 'done', count(*) FROM tasks WHERE status = 'done' AND done = '1996-06-10' UNION ALL
SELECT 'memory', 'entries', count(*) FROM entries WHERE entry_date = '1996-06-10' UNION ALL SELECT 'note', 'created', count(*) FROM notes WHERE created LIKE '1996-06-10%'""")
def q24_daily_report(spark, sf_dir):
    return reports.daily_review(A.tasks(spark, sf_dir), A.entries(spark, sf_dir), A.notes(spark, sf_dir), "1996-06-10")


@query(f"WITH {ENTRIES}, g AS (SELECT file, section, count(*) AS n_entries, count(*) FILTER (entry_date < '2024-03-03') AS n_old, max(entry_date) AS last_date FROM entries GROUP BY 1, 2) SELECT *, n_old = n_entries AS stale FROM g")
def q25_memory_review(spark, sf_dir):
    return reports.memory_review(A.entries(spark, sf_dir), "2024-06-01")


@query(f"WITH {NOTES} SELECT path FROM notes WHERE regexp_full_match(path, 'src1?[1-4]/[^/]*/[^/]*[1-4][.]md')")
def s9_list_notes(spark, sf_dir):
    return reading.list_notes(A.notes(spark, sf_dir), None, "{src[1-4],src1[1-4]}/*/*[1-4].md")


@query(f"WITH {A.FILES} SELECT path, CASE WHEN e = '' THEN '(none)' ELSE e END AS extension, bytes FROM (SELECT path, lower(regexp_extract(path, '[^/]([.][^./]*)$', 1)) AS e, bytes FROM files WHERE path NOT LIKE '%/.%' AND path LIKE 'files/1/%') ORDER BY path LIMIT 25")
def s10_list_files(spark, sf_dir):
    return reading.list_files(A.files(spark, sf_dir), "files/1/", None, 25)[0]


@query(f"WITH {A.FILES} SELECT lower(regexp_extract(path, '[^/]([.][^./]*)$', 1)) AS extension, count(*) AS n FROM files WHERE path NOT LIKE '%/.%' AND (lower(path) LIKE '%.png' OR lower(path) LIKE '%.canvas') GROUP BY 1")
def a10_extension_counts(spark, sf_dir):
    return reading.list_files(A.files(spark, sf_dir), None, ["PNG", ".canvas"])[1]


@query(f"WITH {A.OUTLINED} SELECT path, CAST(k AS INTEGER) AS place, CAST(level AS INTEGER) AS level, text, CAST(strlen(body) AS BIGINT) AS bytes FROM outlined")
def s13_outlines(spark, sf_dir):
    return reading.outline(A.outlined(spark, sf_dir))


@query(f"WITH {A.OUTLINED}, p AS (SELECT DISTINCT 'notes/'||doc_id||'.md' AS path FROM plain) SELECT p.path, sha256(o.body) AS digest, CASE WHEN o.path IS NULL THEN 'heading not found' END AS error FROM p LEFT JOIN outlined o ON o.path = p.path AND o.text = 'part 1'")
def s14_sections(spark, sf_dir):
    return reading.sections(A.outlined(spark, sf_dir), "part 1").select("path", F.sha2("text", 256).alias("digest"), "error")


@query("WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM documents), t AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM l) SELECT doc_id, CASE WHEN len(l) BETWEEN 1 AND 2 THEN NULL ELSE sha256(array_to_string(l[3:6], chr(10))) END AS digest, CASE WHEN len(l) BETWEEN 1 AND 2 THEN -1 ELSE 3 END AS start_line, CASE WHEN len(l) BETWEEN 1 AND 2 THEN -1 WHEN len(l) = 0 THEN 2 ELSE least(len(l), 6) END AS end_line, len(l) AS total_lines FROM t")
def s15_line_windows(spark, sf_dir):
    found = reading.line_window(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 3, 4)
    return found.select("doc_id", F.when(F.col("error").isNull(), F.sha2("window", 256)).alias("digest"), F.coalesce("start_line", F.lit(-1)).alias("start_line"), F.when(F.col("error").isNull(), F.col("end_line")).otherwise(-1).alias("end_line"), F.col("total_lines").cast("long").alias("total_lines"))


@query("WITH s AS (SELECT DISTINCT p_name AS section FROM part), w AS (SELECT unnest(['Blue  Bolt (newest first)', 'hott gear', 'small rings', 'red wigdet']) AS wanted, unnest(['blue bolt', 'hot gear', 'small rings', 'red wigdet']) AS form) SELECT section, count(*) AS n FROM s, w WHERE section = form OR (levenshtein(section, CASE form WHEN 'hot gear' THEN 'hott gear' ELSE form END) <= 2 AND least(length(section), length(form)) > 7) OR (levenshtein(section, CASE form WHEN 'hot gear' THEN 'hott gear' ELSE form END) <= 1 AND least(length(section), length(form)) BETWEEN 4 AND 7) GROUP BY section")
def x49_near_miss_sections(spark, sf_dir):
    wanted = ["Blue  Bolt (newest first)", "hott gear", "small rings", "red wigdet"]
    return reading.near_counts(table(spark, sf_dir, "part").select(F.col("p_name").alias("section")), wanted)


@query("SELECT DISTINCT trim(regexp_replace(lower(p_brand||' '||p_type), '[^a-z0-9]+', '-', 'g'), '-') AS tag FROM part")
def x51_kebab_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(reading.kebab(F.concat_ws(" ", "p_brand", "p_type")).alias("tag")).distinct()


@query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM h GROUP BY target")
def s1_link_extraction(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    return each.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def r7_hash_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY key")
def a2_event_property_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id AS path, event_id AS version, event_type AS op FROM l WHERE r = 1 AND event_type <> 'delete'")
def r2_latest_per_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("version"), F.col("event_type").alias("op"), F.col("value").alias("mtime_ms"), F.col("props").alias("text"))
    return feed.last_changes(e).select("path", "version", "op").where("op <> 'delete'")


@query(f"WITH {NOTES}, a AS (SELECT path, mtime_ms FROM notes), b AS (SELECT CASE WHEN type = 'de' THEN 'moved/' || path ELSE path END AS path, CASE WHEN bytes > 2000 THEN mtime_ms + 1 ELSE mtime_ms END AS mtime_ms FROM notes) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR b.mtime_ms > a.mtime_ms")
def r5_manifest_changes(spark, sf_dir):
    """What changed between two listings of all notes: in the second some have been moved, and some edited."""
    n = A.notes(spark, sf_dir)
    path = F.when(F.col("type") == "de", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    now = n.select(path.alias("path"), F.when(F.col("bytes") > 2000, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"))
    return feed.manifest_changes(n.select("path", "mtime_ms"), now)


@query("WITH l AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, epoch_us(ts) // 1000 AS at_ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS next_ms FROM events) SELECT user_id AS path, event_id AS version, op, at_ms FROM l WHERE op = 'delete' OR next_ms IS NULL OR next_ms - at_ms >= 21600000")
def r3_settled_changes(spark, sf_dir):
    """The changes that a debounce of six hours passes on: events as a log of their users' changes, errors being deletions."""
    at_ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), at_ms.alias("at_ms"))
    return debounce.settled_log(log, 6 * 3600 * 1000)


def _changes(spark, sf_dir) -> list[DataFrame]:
    """All notes as two batches of changes: first each with its title alone and German ones in a drafts folder, then each with its text in its own place, the drafts deleted."""
    n = A.texts(spark, sf_dir)
    draft = F.when(F.col("type") == "de", F.concat(F.lit("drafts/"), "path")).otherwise(F.col("path"))
    return [n.select(draft.alias("path"), F.col("title").alias("text"), "doc_id"), n.select("path", F.concat_ws(" ", "title", "content").alias("text"), "doc_id"), n.where("type = 'de'").select(draft.alias("path"))]


@query(stems_sql("SELECT path, score FROM hits WHERE f0 > 0 OR f1 > 0 ORDER BY score DESC, path LIMIT 30"))
def w1_segments_search(spark, sf_dir):
    """A search after two batches of changes: the first one's postings lie dead in their segment."""
    titles, texts, gone = _changes(spark, sf_dir)
    index = textfeed.TextIndex(Tables(spark, shared_folder(spark), textfeed.KEYS))
    index.apply(0, titles, gone.limit(0))
    index.apply(1, texts, gone)
    found = index.search("what about Hands, Resting", any_term=True).select("path", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "path").limit(30)


@query(f"{GRAPH} SELECT source, target FROM links")
def r9_links_after_changes(spark, sf_dir):
    """The link table after two batches: links are written while their targets lie in other places or nowhere, and found anew as these come and go."""
    n, refs = A.notes(spark, sf_dir), A.references(spark, sf_dir)
    german = F.col("type") == "de"
    note = lambda path, op: [path.alias("path"), F.lit("note").alias("kind"), F.lit(op).alias("op")]
    draft = F.concat(F.lit("drafts/"), "path")
    index = linkindex.LinkIndex(Tables(spark, shared_folder(spark), linkindex.KEYS))
    index.apply(0, n.select(*note(F.when(german, draft).otherwise(F.col("path")), "upsert")), refs)
    moved = n.where(german)
    index.apply(1, moved.select(*note(F.col("path"), "upsert")).union(moved.select(*note(draft, "delete"))), refs.where(F.split_part("source", F.lit("/"), F.lit(2)) == "de"))
    return index.links()


@query("WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT 'n/' || doc_id AS path, 0 AS chunk_index, h AS content_hash, 64 AS dims FROM c")
def r8_healed_vectors(spark, sf_dir):
    """Vectors after a first heal() of older texts and a second one of the present ones: each chunk has one vector, of its present text."""
    d = table(spark, sf_dir, "documents")
    older = F.when(F.col("lang") == "en", F.concat(F.lit("draft of "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    chunks = lambda text: d.select(F.concat(F.lit("n/"), F.col("doc_id").cast("string")).alias("path"), F.lit(0).alias("chunk_index"), text.alias("chunk_text"), F.sha2(text, 256).alias("content_hash"))
    store = vectorfeed.VectorFeed(Tables(spark, shared_folder(spark), vectorfeed.KEYS))
    store.heal(chunks(older), 0)
    store.heal(chunks(F.coalesce("text", F.lit(""))), 1)
    return store.vectors().select("path", "chunk_index", "content_hash", F.size("embedding").alias("dims"))


@query("SELECT d.doc_id AS path, 0 AS chunk_index, sha256(d.text) AS content_hash FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 1)")
def j9_chunks_to_embed(spark, sf_dir):
    """Chunks without a vector of their present text; vectors of one label are of an older text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("chunk_index"), F.sha2("text", 256).alias("content_hash"))
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "label").join(d, "path")
    embedded = old.select("path", "chunk_index", F.when(F.col("label") == 1, "older").otherwise(F.col("content_hash")).alias("content_hash"))
    return feed.to_embed(d, embedded).select("path", "chunk_index", "content_hash")


@query("SELECT lang, levenshtein(lang, 'den') AS distance FROM (SELECT DISTINCT lang FROM documents)")
def x48_near_misses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.levenshtein("lang", F.lit("den")).cast("long").alias("distance"))
