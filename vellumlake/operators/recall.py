"""Recall of dated entries by text and vectors: fused, cut by relevance, told in order of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.operators import vectors

#: Vectors that are looked at, and candidates that are reranked (text hits always are).
NEAREST, RERANKED = 100, 120


def found(entries: DataFrame, text_hits: DataFrame, near: DataFrame, key: str = "id") -> DataFrame:
    """Candidates of both legs with fused, lexical and distance: text_hits has (key, score), near (key, distance), each a leg in order of what it holds, then of key.

    Text hits all stay; of those that vectors alone found, those among the first
    RERANKED by fused score.
    """
    both = vectors.fused([text_hits, near], key, [[F.desc("score"), F.col(key)], [F.col("distance"), F.col(key)]], unlimited=(0,))
    both = both.withColumn("score", F.round("score", 6))
    first = both.orderBy(F.desc("score"), key).limit(RERANKED).select(key, F.lit(True).alias("first"))
    lexical = text_hits.select(key, F.lit(True).alias("hit"))
    every = both.join(first, key, "left").join(lexical, key, "left").join(near.select(key, "distance"), key, "left").withColumn("lexical", F.coalesce("hit", F.lit(False)))
    return every.where(F.col("lexical") | F.col("first")).join(entries, key).select(*entries.columns, F.col("score").alias("fused"), "lexical", "distance")


def relevant(candidates: DataFrame, probability: Column | None = None) -> DataFrame:
    """The candidates that stay, with relevance: by a reranker's probability where there is one, else by distance."""
    if probability is not None:
        return vectors.adaptive_floor(candidates.withColumn("relevance", F.coalesce(probability, F.lit(0.0))), "relevance", "lexical")
    return vectors.within_margin(candidates.withColumn("relevance", F.col("fused")), "distance", "lexical")


def told(kept: DataFrame, most: int = 50, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(total, entries): how many stayed, and the most relevant of them by date, file and place."""
    top = kept.orderBy(F.desc("relevance"), key).limit(max(1, most))
    return kept.agg(F.count("*").alias("total")), top.orderBy("entry_date", "file", "entry_index")


def rescued(kept: DataFrame, any_term: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """kept, or where it is empty the entries that any term of the query hits, by their score."""
    none = kept.limit(1).agg((F.count("*") == 0).alias("none"))  # one row
    rest = any_term.join(entries, key).select(*entries.columns, F.col("score").alias("relevance"))
    return kept.select(*entries.columns, "relevance").union(rest.join(F.broadcast(none)).where("none").drop("none"))
