"""Differential TF-IDF on long tables (doc, word, tf); nothing is densified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, id_col: str, words: str) -> DataFrame:
    """(doc, word, tf) of an array column of words."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(words).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("tf"))


def normed(tf: DataFrame, n_docs: int) -> DataFrame:
    """(doc, word, x): tf x (ln((1+n)/(1+df)) + 1), each document's row divided by its Euclidean length."""
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    w = tf.join(df, "word").withColumn("x", F.col("tf") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return w.join(norm, "doc").select("doc", "word", (F.col("x") / F.col("len")).alias("x"))


def differential(related: DataFrame, unrelated: DataFrame, id_col: str, words: str) -> DataFrame:
    """(word, weight): sum over related documents of their TF-IDF rows (fitted on both corpora), times ln((Nu+1)/(df_u+1)).

    Documents without words count in N only. With no unrelated documents every weight is 0.
    """
    a, b = term_counts(related, id_col, words), term_counts(unrelated, id_col, words)
    nu = unrelated.count()
    x = normed(a.union(b), related.count() + nu)
    du = b.groupBy("word").agg(F.count("*").alias("dfu"))
    mine = x.join(related.select(F.col(id_col).alias("doc")), "doc", "left_semi").groupBy("word").agg(F.sum("x").alias("s"))
    return mine.join(du, "word", "left").select("word", (F.col("s") * F.log((F.lit(nu) + 1) / (F.coalesce("dfu", F.lit(0)) + 1))).alias("weight"))


def cluster_keywords(docs: DataFrame, id_col: str, cluster: str, words: str, least: float = 0.01, top: int = 15) -> DataFrame:
    """(cluster, word, share, rank): each cluster's words against all others, in one pass.

    The TF-IDF rows don't depend on the cluster, and df and N of the rest are totals less the cluster's own, so no fit is
    repeated. Shares over `least` are kept, `top` a cluster, ties by word. A cluster that is the whole corpus gives no rows.
    """
    from pyspark.sql.window import Window

    d = docs.select(F.col(id_col).alias("doc"), F.col(cluster).alias("cluster"), F.col(words).alias("w")).filter("cluster is not null")
    tf = term_counts(d, "doc", "w")
    n = d.count()
    x = normed(tf, n).join(d.select("doc", "cluster"), "doc")
    per = x.groupBy("cluster", "word").agg(F.sum("x").alias("s"), F.count("*").alias("dfc"))
    total = per.groupBy("word").agg(F.sum("dfc").alias("df"))
    size = d.groupBy("cluster").agg(F.count("*").alias("nc"))
    w = per.join(total, "word").join(size, "cluster").withColumn("v", F.col("s") * F.log((n - F.col("nc") + 1) / (F.col("df") - F.col("dfc") + 1)))
    all_ = w.groupBy("cluster").agg(F.sum("v").alias("all"))
    k = w.join(all_, "cluster").filter("all > 0").select("cluster", "word", (F.col("v") / F.col("all")).alias("share")).filter(F.col("share") > least)
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("share"), "word"))).filter(F.col("rank") <= top)


def shares(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """(word, share): each weight over the sum of all, those over `least`."""
    total = weights.agg(F.sum("weight")).first()[0] or 1.0
    return weights.select("word", (F.col("weight") / total).alias("share")).filter(F.col("share") > least)
