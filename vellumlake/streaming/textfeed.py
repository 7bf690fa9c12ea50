"""A full-text index that follows changes: segments that are never rewritten, and marks of what is alive.

Each batch adds the postings of its notes as one segment, with their lengths as those of the empty term.  `heads` names, for each note,
the batch that its postings are of; postings of another batch are dead, so an edit or a
deletion touches no segment.  The number of notes and their words are kept as sums to
which a batch adds what it puts in and takes out.  Once MERGED segments are of one size
class, they are merged into one without their dead postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import textindex
from vellumlake.streaming.tables import Tables

KEYS = {"heads": "path", "terms": "term"}
HEADS = "path string, seg long, dl int"
#: Segments of one size class that are merged, each class being so many times larger than the last.
MERGED = 4


def text_writes(tables: Tables, batch_id: int, notes: DataFrame, gone: DataFrame, text: Column, into: Tables | None = None) -> tuple[dict, dict]:
    """What a batch changes, and the new sums, for Tables.commit().

    notes: a row (path, ...) for each new or edited note; gone: (path) of those deleted.
    A null text has no words.  The segment is written at once, to `into` if the commit
    is not that of `tables`.
    """
    into = into or tables
    name = f"terms@{batch_id:012d}"
    segment = into.ahead(name, textindex.postings(notes.select("path", text.alias("text")), F.col("text"), with_lengths=True).withColumn("seg", F.lit(batch_id).cast("long")))
    new = into.rows(segment).where("term = ''").select("path", "seg", "dl")
    changed = tables.keep(new.select("path").union(gone.select("path")).distinct())
    at = tables.touched("heads", changed)
    had = tables.read("heads", at) if at else None
    had = tables.spark.createDataFrame([], HEADS) if had is None else had
    sums = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    plus, minus = sums(new), sums(had.join(changed, "path", "left_semi"))
    was = tables.manifest()["numbers"]
    writes: dict = {}
    if at:
        writes["heads"] = (had.join(changed, "path", "left_anti").unionByName(new), at)
    segments = list(was.get("segments", []))
    if n := into.rows(segment).count():  # from the files' footers
        writes[name] = segment
        segments.append({"name": name, "rows": n})
    return writes, {"n": was.get("n", 0) + plus["n"] - minus["n"], "words": was.get("words", 0) + plus["words"] - minus["words"], "segments": segments}


def size_class(rows: int) -> int:
    return max(0, (rows.bit_length() - 1) // 2)


class TextIndex:
    """Notes' postings in segments, with their heads, in a folder of tables."""

    def __init__(self, tables: Tables, text: Column | None = None):
        self.tables, self.text = tables, F.col("text") if text is None else text

    def apply(self, batch_id: int, notes: DataFrame, gone: DataFrame) -> None:
        """Takes in a batch once, and merges segments where that is due."""
        if not self.tables.has(batch_id):
            self.tables.commit(batch_id, *text_writes(self.tables, batch_id, notes, gone, self.text))
        self.merge()

    def live(self, rows: DataFrame) -> DataFrame:
        """Postings of the batch that their note's head names."""
        return rows.join(self.tables.read("heads").select("path", "seg"), ["path", "seg"], "left_semi")

    def merge(self) -> bool:
        """Merges the segments of one class, the smallest that has MERGED of them; dead postings are left out."""
        state = self.tables.manifest()
        classes: dict[int, list[dict]] = {}
        for s in state["numbers"].get("segments", []):
            classes.setdefault(size_class(s["rows"]), []).append(s)
        due = next((c for k, c in sorted(classes.items()) if len(c) >= MERGED), None)
        if due is None:
            return False
        every = reduce(DataFrame.unionByName, [self.tables.read(s["name"]) for s in due])
        name = f"{due[-1]['name']}m"
        rows = self.tables.ahead(name, self.live(every).repartition(self.tables.buckets, "term"))
        n = self.tables.rows(rows).count()
        left = [s for s in state["numbers"]["segments"] if s not in due]
        writes = {s["name"]: None for s in due} | ({name: rows} if n else {})
        self.tables.commit(state["batch"], writes, {"segments": left + ([{"name": name, "rows": n}] if n else [])})
        return True

    def search(self, query: str, any_term: bool = False) -> DataFrame:
        """(path, score) as textindex.search() gives them; of each segment only the buckets of the asked stems are read."""
        t, numbers = self.tables, self.tables.manifest()["numbers"]
        parts, asked = textindex.parts_of(query, any_term)
        words = t.spark.createDataFrame([(w,) for w in asked], "term string")
        found = [t.read(s["name"], t.touched(s["name"], words)) for s in numbers.get("segments", [])] if asked else []
        empty = t.spark.createDataFrame([], "term string, path string, tf int, dl int, places array<int>, seg long")
        rows = reduce(DataFrame.unionByName, [empty, *found]).where(F.col("term").isin(asked))
        if found:
            rows = self.live(rows)
        n = numbers.get("n", 0)
        return textindex.scored(rows, parts, asked, n, numbers.get("words", 0) / n if n else 1.0, "path", any_term)
