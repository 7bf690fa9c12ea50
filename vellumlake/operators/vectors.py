"""Exact nearest neighbours and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions import ranking
from vellumlake.operators.ranks import ranked


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, by: tuple[str, ...], metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with distance (6 digits), ties by the columns `by`; where applies before k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = {"l2": ranking.l2, "cosine": ranking.cosine_distance}[metric](F.col(vector), q)
    some = rows if where is None else rows.where(where)
    return some.withColumn("distance", F.round(distance, 6)).orderBy("distance", *by).limit(k)


def best_of_each(hits: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """For each key the nearest of its hits."""
    w = Window.partitionBy(key).orderBy("distance", *by)
    return hits.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def candidates(limit: int) -> int:
    """How many hits of each leg go into a fusion of which `limit` are shown."""
    return min(max(1, 3 * limit), 100)


def hydrated(hits: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, score) with kind, title, type, folder, tags, bytes and score (6 digits): of a note where there is one of that path, else of another file; hits that are neither are left out."""
    of_note = notes.select("path", F.struct(F.lit("note").alias("kind"), "title", "type", "folder", "tags", "bytes").alias("n"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    of_file = files.select("path", F.struct(F.lit("file").alias("kind"), name.alias("title"), F.lit(None).cast("string").alias("type"), folder.alias("folder"), F.array().cast("array<string>").alias("tags"), "bytes").alias("f"))
    both = hits.join(of_note, "path", "left").join(of_file, "path", "left").select("path", F.round("score", 6).alias("score"), F.coalesce("n", "f").alias("row"))
    return both.where("row is not null").select("path", "score", "row.*")


def fused(legs: list[DataFrame], key: str, order: list[list[Column]], unlimited: tuple[int, ...] = ()) -> DataFrame:
    """(key, score): reciprocal rank fusion of lists, each short enough to rank in one task but for those that `unlimited` numbers."""
    fused_ = None
    for i, (leg, by) in enumerate(zip(legs, order, strict=True)):
        one = ranked(leg, by).select(key, "rank") if i in unlimited else leg.select(key, F.row_number().over(Window.orderBy(*by)).cast("long").alias("rank"))
        fused_ = one if fused_ is None else fused_.unionByName(one)
    return fused_.groupBy(key).agg(F.sum(ranking.reciprocal_rank(F.col("rank"))).alias("score"))


def reranked(candidates: DataFrame, fused_score: str, rerank_score: str, key: str) -> DataFrame:
    """candidates (a short list) with score, the blend of both scores by fused rank."""
    every = Window.partitionBy()
    norm = lambda c: ranking.min_max(F.col(c), F.min(c).over(every), F.max(c).over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(fused_score), key))
    return candidates.select("*", rank.alias("_rank"), norm(fused_score).alias("_f"), norm(rerank_score).alias("_r")).withColumn("score", ranking.significant(ranking.blend(F.col("_f"), F.col("_r"), F.col("_rank")))).drop("_rank", "_f", "_r")


def adaptive_floor(candidates: DataFrame, probability: str, lexical: str) -> DataFrame:
    """Candidates that text search found, and others whose probability reaches a floor of a tenth of the best such, within 0.001 and 0.05."""
    best = candidates.agg(F.max(F.when(~F.col(lexical), F.col(probability))).alias("_best"))  # one row
    floor = F.coalesce(F.least(F.lit(0.05), F.greatest(F.lit(0.001), 0.1 * F.col("_best"))), F.lit(0.05))
    return candidates.join(F.broadcast(best)).where(F.col(lexical) | (F.col(probability) >= floor)).drop("_best")


def within_margin(candidates: DataFrame, distance: str, lexical: str, margin: float = 0.15) -> DataFrame:
    """Candidates that text search found, and others at most margin beyond the nearest."""
    best = candidates.agg(F.min(distance).alias("_best"))  # one row
    return candidates.join(F.broadcast(best)).where(F.col(lexical) | (F.col(distance) <= F.col("_best") + margin)).drop("_best")
