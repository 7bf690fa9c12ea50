"""Ranked full-text search: BM25 over tokens, phrases, all terms or any term.

A query has few terms, so their frequencies are counted in each row's token array;
nothing is exploded, and the only exchange is that of the corpus statistics.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Words that a query operator would be, and words that tell nothing in a search for any term.
RESERVED = {"AND", "OR", "NOT", "NEAR"}
COMMON = set("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with i me my you your do does about what when where which who whom why how".split())
#: Marks that are operators of a query, never a part of a term; other ASCII marks but _ join what stands on both sides.
OPERATORS = set('"*^():')
JOINERS = set(string.punctuation) - OPERATORS - {"_"}


def terms(raw: str) -> list[tuple[str, list[str]]]:
    """The terms of a query as typed: ("quoted", words), ("joined", parts that marks join) or ("single", [word])."""
    out: list[tuple[str, list[str]]] = []
    parts, joining, at = [""], False, 0

    def finish() -> None:
        if found := [p for p in parts if p]:
            out.append(("joined" if len(found) > 1 else "single", found))
        parts[:] = [""]

    while at < len(raw):
        c, end = raw[at], raw.find('"', at + 1)
        if c == '"' and end > at + 1:
            finish()
            out.append(("quoted", "".join(x for x in raw[at + 1 : end] if x not in OPERATORS).split()))
            at = end
        elif c.isspace() or c in OPERATORS:
            finish()
        elif c in JOINERS:
            joining = True
        else:
            if joining:
                parts.append("")
            parts[-1] += c
        joining = c in JOINERS
        at += 1
    finish()
    return out


def parse_query(raw: str, any_term: bool = False) -> list[list[str]]:
    """The parts that must (or, with any_term, may) match, each a list of words that follow each other: quoted phrases first, then terms that marks join, then single words but for operators (and, with any_term, common words)."""
    found = terms(raw)
    skip = lambda w: w.upper() in RESERVED or any_term and w.lower() in COMMON
    kept = [(kind, words) for kind, words in found if kind != "single" or not skip(words[0])]
    in_order = [words for k in ("quoted", "joined", "single") for kind, words in kept if kind == k]
    return [words for part in in_order if (words := tokens_of(" ".join(part)))]


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def frequency(words: Column, phrase: list[str]) -> Column:
    """How often the words of phrase follow each other."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))

    def places(every: Column) -> Column:
        same = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(every, i + j) == w, F.lit(False)) for j, w in enumerate(phrase)])
        return F.size(F.filter(F.transform(every, lambda t, i: same(i)), lambda hit: hit))

    # an array of one array, so that words is computed once for all its places
    return F.element_at(F.transform(F.array(words), places), 1)


def bm25(rows: DataFrame, text: Column, parts: list[list[str]], any_term: bool = False, where: Column | None = None) -> DataFrame:
    """rows that match, with score; the statistics are those of all rows, where only limits what is returned."""
    if not parts:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    counted = rows.withColumn("_words", tokens(text))
    counted = counted.select(*rows.columns, F.size("_words").alias("_dl"), *[frequency(F.col("_words"), p).alias(f"_f{i}") for i, p in enumerate(parts)])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(len(parts))])
    hit = reduce((lambda a, b: a | b) if any_term else (lambda a, b: a & b), [F.col(f"_f{i}") > 0 for i in range(len(parts))])

    def weight(i: int) -> Column:
        df, f = F.col(f"_df{i}"), F.col(f"_f{i}")
        idf = F.greatest(F.lit(FLOOR), F.log((F.col("_n") - df + 0.5) / (df + 0.5)))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))

    kept = counted.where(hit) if where is None else counted.where(hit & where)
    score = reduce(lambda a, b: a + b, map(weight, range(len(parts))))
    return kept.join(F.broadcast(stats)).select(*rows.columns, score.alias("score"))  # one row of statistics


def best_window(words: Column, asked: list[str], n: int) -> Column:
    """(n_terms, length, start): the stretch of at most n words with the most different asked words; of such the shortest, then the first; null where none is there.

    One walk over the places of asked words, each as the end of a stretch: the last place
    of each word says which of them lie in it and where it begins.
    """
    terms = list(dict.fromkeys(asked))
    kind = "struct<n_terms:int,length:int,start:int>"
    if not terms:
        return F.lit(None).cast(kind)
    every = F.array(*[F.lit(t) for t in terms])

    def places(ws: Column) -> Column:
        # get() is null beyond the last word; only what is asked for becomes a struct
        found = F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: F.coalesce(F.get(ws, i).isin(terms), F.lit(False)))
        return F.transform(found, lambda i: F.struct(F.array_position(every, F.get(ws, i)).cast("int").alias("t"), i.alias("at")))

    # an array of one array, so that words is computed once for all its places
    hits = F.element_at(F.transform(F.array(words), places), 1)
    start = F.struct(F.array(*[F.lit(-n - 1)] * len(terms)).alias("last"), F.lit(None).cast("struct<n:int,l:int,s:int>").alias("best"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda v, j: F.when(j == hit["t"] - 1, hit["at"]).otherwise(v))
        inside = F.filter(last, lambda v: v > hit["at"] - n)
        begins = F.array_min(inside)
        this = F.struct(F.size(inside).alias("n"), (begins - hit["at"] - 1).alias("l"), (-begins).alias("s"))
        return F.struct(last.alias("last"), F.greatest(state["best"], this).alias("best"))

    best = F.aggregate(hits, start, step)["best"]
    return F.when(best.isNotNull(), F.struct(best["n"].alias("n_terms"), (-best["l"]).alias("length"), (-best["s"]).alias("start")))


def shown_words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def plain_words(text: Column) -> Column:
    """shown_words() as they are compared: in lower case, without marks; a word of marks alone is an empty one."""
    # the whole text at once, white space first as one line feed, at which words of marks stay apart
    parted = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "\n")
    return F.split(F.regexp_replace(parted, r"[^\p{L}\p{N}\n]+", ""), "\n")


def shown(every: Column, window: Column, n: int = 30) -> Column:
    """n words with the window in their middle, as far as the text's ends let it; with ... where text is left out."""
    start = F.coalesce(window["start"] - F.floor((n - window["length"]) / 2).cast("int"), F.lit(0))
    start = F.greatest(F.lit(0), F.least(start, F.size(every) - n))
    body = F.array_join(F.slice(every, start + 1, n), " ")
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + n < F.size(every), "...").otherwise(""))


def snippet(text: Column, words: list[str], n: int = 30) -> Column:
    """What a search shows of a text: shown() of its best_window()."""
    # an array of one struct, so that words and window are computed once
    both = F.array(F.struct(shown_words(text).alias("every"), best_window(plain_words(text), words, n).alias("window")))
    return F.element_at(F.transform(both, lambda x: shown(x["every"], x["window"], n)), 1)


def search(notes: DataFrame, query: str, where: Column | None = None, limit: int = 20, any_term: bool = False) -> DataFrame:
    """The best notes for a query by title and content, ties by path."""
    found = bm25(notes, F.concat_ws(" ", "title", "content"), parse_query(query, any_term), any_term, where)
    return found.orderBy(F.desc(F.round("score", 6)), "path").limit(limit)
