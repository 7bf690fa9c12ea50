"""Nearest neighbours from an inverted file: vectors lie in lists by their nearest centroid.

Centroids are fitted on a bounded sample; every vector is put in a list, whichever the
sample was.  A search computes exact distances within the lists that it opens.  By
default it is exact: no vector of a list is nearer than the distance to its centroid less
the list's radius, so only lists whose bound lies beyond the k-th neighbour found so far
are left closed.  With `probe` only so many lists are opened, which may miss some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.operators.vectors import nearest

#: Lists at most (their centroids and radii are all that the driver sees), and vectors that centroids are fitted on.
LISTS, SAMPLE = 1024, 20_000


def build(rows: DataFrame, vector: str, folder: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 3) -> None:
    """Writes `vectors`, a folder for each list, and `centroids` (list, centroid, radius, n).

    By default there are about as many lists as the root of the number of vectors.  Rows
    without a vector are in no list; vectors must have one length; a large list is split
    over files.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(vector).isNotNull())
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), LISTS, n or 1))
    some = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).sample(min(1.0, 1.2 * sample / max(1, n)), seed).limit(sample)
    fitted = KMeans(k=lists, seed=seed, maxIter=15).fit(some).clusterCenters() if n and lists > 1 else rows.limit(1).select(F.col(vector).cast("array<double>")).toPandas().iloc[:, 0].tolist()
    centers = np.array([np.asarray(c, float) for c in fitted])
    kept = rows.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                square = (centers**2).sum(1)
                x = np.array(batch.column(vector).to_pylist(), float)
                at = (square - 2 * x @ centers.T).argmin(1)
                far = np.sqrt(((x - centers[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(at, pa.int32()), pa.array(far)], names=[*kept, "list", "_far"])

    kinds = dict(rows.dtypes)
    dealt = rows.mapInArrow(put, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "list int", "_far double"]))
    if n:
        dealt.hint("rebalance", "list").write.partitionBy("list").parquet(f"{folder}/vectors")
    else:  # a file without rows, for its columns
        dealt.write.parquet(f"{folder}/vectors")
    stored = spark.read.schema(dealt.schema).parquet(f"{folder}/vectors")
    radii = {r["list"]: (r["radius"], r["n"]) for r in stored.groupBy("list").agg(F.max("_far").alias("radius"), F.count("*").alias("n")).collect()}
    out = [(i, [float(v) for v in centers[i]], *radii[i]) for i in sorted(radii)]
    spark.createDataFrame(out, "list int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{folder}/centroids")


def opened(spark: SparkSession, folder: str, lists: list[int]) -> DataFrame:
    return spark.read.parquet(f"{folder}/vectors").where(F.col("list").isin([int(x) for x in lists])).drop("list", "_far")


def search(spark: SparkSession, folder: str, vector: str, query: list[float], k: int, by: tuple[str, ...], probe: int | None = None) -> tuple[DataFrame, int]:
    """The k rows nearest to query by L2 with distance (6 digits), ties by the columns `by`, and how many lists were opened for them."""
    rows = spark.read.parquet(f"{folder}/centroids").collect()  # LISTS at most
    if not rows:
        return spark.read.parquet(f"{folder}/vectors").drop("list", "_far").withColumn("distance", F.lit(0.0)).limit(0), 0
    far = np.sqrt(((np.array([r["centroid"] for r in rows]) - np.array(query, float)) ** 2).sum(1))
    order = np.argsort(far, kind="stable")
    first = order[: probe or 1]
    if probe is None:
        while sum(rows[i]["n"] for i in first) < k and len(first) < len(rows):
            first = order[: len(first) + 1]
    found = nearest(opened(spark, folder, [rows[i]["list"] for i in first]), vector, query, k, by)
    if probe is not None:
        return found, len(first)
    worst = found.agg(F.max("distance"), F.count("*")).first()
    bound = worst[0] + 1e-5 if worst[1] >= k else float("inf")
    every = [i for i in order if far[i] - rows[i]["radius"] <= bound]
    return nearest(opened(spark, folder, [rows[i]["list"] for i in every]), vector, query, k, by), len(every)
