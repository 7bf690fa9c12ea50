"""Ranks of lists that no single task could sort, and the first few of each key."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.sources.store import shared_folder


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with their place in `order`, counted from 1: ranges of the order are sorted each by itself, and begin where the sizes of those before them add up to.

    Rows that the order does not tell apart stand in any order, over as many ranges as they need.  Ranges are written
    to the shared folder once, since a second look at them must find the same borders;
    their sizes, one number for each range, are added up by the driver.
    """
    spark = rows.sparkSession
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{shared_folder(spark)}/ranges"
    # a tie parts rows that the order does not
    rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before = dict(zip(sorted(sizes), [0, *accumulate(sizes[k] for k in sorted(sizes))], strict=False))
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before", "_tie")


def first_of_each(rows: DataFrame, key: str, n: int, values: list[Column], salts: int = 64) -> DataFrame:
    """(key, first): of each key the first n of its values, as an array of structs in ascending order.

    The values of one key are spread over `salts` groups, of each of which n stay, most
    of them before they are shuffled; so n * salts values of a key meet at most.
    """
    each = rows.select(key, F.struct(*values).alias("_value"))
    salt = F.pmod(F.xxhash64("_value"), F.lit(salts))
    place = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_value"))
    some = each.withColumn("_salt", salt).withColumn("_place", place).where(F.col("_place") <= n)
    return some.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("_value")), 1, n).alias("first"))
