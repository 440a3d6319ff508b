"""Deduplication and per-key aggregates. Groups are reduced by partial aggregation, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webobs.functions.urls import canonical, is_ipv4_text


def by_canonical_url(df: DataFrame, url: str, name: str, order: str) -> DataFrame:
    """(rest, url, name): one row per address regardless of scheme and one trailing '/'.

    The first row by `order` gives the name; the scheme is http if any member has it. Rows whose address isn't http or
    doesn't have exactly one '://' (null too) are left out.
    """
    c = df.select(canonical(F.col(url)).alias("c"), F.col(name).alias("name"), F.col(order).alias("ord")).filter("c.ok")
    g = c.groupBy("c.rest").agg(F.min(F.struct("ord", "name")).alias("m"), F.max((F.col("c.scheme") == "http").cast("int")).alias("plain"), F.min("c.scheme").alias("other"))
    return g.select("rest", F.concat(F.when(F.col("plain") == 1, "http").otherwise(F.col("other")), F.lit("://"), "rest").alias("url"), F.col("m.name").alias("name"))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest `order`, which must be unique in a key. Null keys are one key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As first_by, with the largest `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def by_content_hash(df: DataFrame, text: str, url: str, order: str) -> DataFrame:
    """(hash, order, url, n): one representative per text: without an address in its url first, then the shortest url, then by order.

    Null texts are left out; the empty text is a text.
    """
    best = F.struct(is_ipv4_text(F.coalesce(url, F.lit(""))).cast("int").alias("ip"), F.length(F.coalesce(url, F.lit(""))).alias("len"), F.col(order).alias("ord"), F.col(url).alias("url"))
    g = df.filter(F.col(text).isNotNull()).groupBy(F.md5(F.encode(text, "UTF-8")).alias("hash")).agg(F.min(best).alias("b"), F.count("*").alias("n"))
    return g.select("hash", F.col("b.ord").alias(order), F.col("b.url").alias(url), "n")


def multimap(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, values): sorted distinct values of each key; rows with a null key or value are left out."""
    return df.select(key.alias("key"), value.alias("value")).filter("key is not null and value is not null").groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def mode_first(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group; of equally frequent ones the one seen first."""
    c = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(group, f"m.{value}", "m.n")


def sizes_renumbered(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, size, rank): sizes of clusters, numbered from 0 by falling size, then cluster."""
    from webobs.operators.slices import numbered

    s = df.groupBy(cluster).agg(F.count("*").alias("size"))
    return numbered(s.withColumn("neg", -F.col("size")), ["neg", cluster], "rank").drop("neg")
