"""Global numbering, slices and samples without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.runtime import cut, width


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with its place in the total order of `order` (ascending, from 0): range partitions, their counts, and a place in each.

    Only one count per partition goes to the driver. Ties get any order among themselves, so end `order` with a unique column.
    """
    laid = cut(df.repartitionByRange(width(df), *order).sortWithinPartitions(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["c"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    at, starts = 0, []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(at).cast("long")]
        at += counts[p]
    if not starts:
        return laid.withColumn(name, F.lit(0).cast("long")).drop("__id")
    return laid.withColumn(name, F.element_at(F.create_map(*starts), part) + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def slices(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with slice, the number of its slice of `size` rows in the given order."""
    return numbered(df, order, "__n").withColumn("slice", F.floor(F.col("__n") / size).cast("long")).drop("__n")


def tiles(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with tile 1..n: contiguous parts whose sizes differ by at most 1, the larger ones first."""
    x = cut(numbered(df, order, "__n"))
    total = x.count()
    small, more = divmod(total, n)
    i = F.col("__n")
    tile = F.when(i < more * (small + 1), F.floor(i / (small + 1))).otherwise(more + F.floor((i - more * (small + 1)) / max(small, 1)))
    return x.withColumn("tile", (tile + 1).cast("int")).drop("__n")


def shuffled(df: DataFrame, key: Column, seed: int = 0, name: str = "n") -> DataFrame:
    """df with its place in a random order that is the same each time: by the MD5 of seed and key, ties by nothing (make key unique)."""
    return numbered(df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))), ["__h"], name).drop("__h")


def capped(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, the first by `order` (a top-n per key)."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", r).filter(F.col("__r") <= n).drop("__r")


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows, the same ones each time: those with the smallest MD5 of key (a top-k, not a sort)."""
    return df.withColumn("__h", F.md5(key.cast("string"))).orderBy("__h").limit(n).drop("__h")
