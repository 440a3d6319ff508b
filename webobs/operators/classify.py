"""Scoring pages in two stages, metrics, and the refinement of few-shot samples. A scorer is any column -> column function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Column], Column]


def with_url(url: Column, text: Column) -> Column:
    """The text a scorer sees: the address before it."""
    return F.concat(F.coalesce(url, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def two_stage(first: Column, second: Column) -> Column:
    """Class 1, 2 or 3: the second stage decides between 2 and 3 where the first says 2; null where a stage gives none."""
    return F.when(first == 2, second + 1).otherwise(first)


def metrics(df: DataFrame, truth: str, said: str, group: str) -> DataFrame:
    """(group, tp, fp, fn, precision, recall) of boolean columns; a ratio without a base is 0; null truths or answers count as false."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    g = df.groupBy(group).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return g.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def difference(label: Column, label2: Column, feature: Column, feature2: Column) -> Column:
    """2 x |difference of labels| + sum of |differences of features|."""
    return 2 * F.abs(label - label2) + F.aggregate(F.zip_with(feature, feature2, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)


def most_different(df: DataFrame, key: str, diff: Column, n: int = 1) -> DataFrame:
    """The n rows with the largest difference, ties by key (a top-k)."""
    return df.withColumn("diff", diff).orderBy(F.desc("diff"), key).limit(n)


def refine(samples: DataFrame, pool: DataFrame, interpret: Callable[[DataFrame, DataFrame], DataFrame], key: str, rounds: int = 20, size: int = 4) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Few-shot refinement. interpret(samples, pool) gives pool with truth, said, feature, feature2, label, label2.

    Each round takes the most different wrong row, tries it in the place of each sample and keeps the best replacement by
    (recall, precision); it ends without errors, without a gain, or after `rounds`. Samples are `size` rows.
    """
    spark, score = pool.sparkSession, lambda s: tuple(metrics(interpret(s, pool).withColumn("g", F.lit(1)), "truth", "said", "g").select("recall", "precision").first() or (0.0, 0.0))
    best, trail = score(samples), []
    for _ in range(rounds):
        trail.append(best)
        judged = interpret(samples, pool)
        wrong = judged.filter("truth <> said").join(samples.select(key), key, "left_anti")
        worst = most_different(wrong, key, difference(F.col("label"), F.col("label2"), F.col("feature"), F.col("feature2"))).select(key).collect()
        if not worst:
            break
        new = pool.filter(F.col(key) == worst[0][0]).select(*samples.columns)
        held = [r[0] for r in samples.select(key).orderBy(key).limit(size).collect()]
        tries = [(score(s), i, s) for i, s in enumerate(samples.filter(F.col(key) != k).union(new) for k in held)]
        top = max(tries, key=lambda x: (x[0], -x[1])) if tries else None
        if top is None or top[0] <= best:
            break
        best = top[0]
        samples = spark.createDataFrame(top[2].collect(), top[2].schema)  # `size` rows
    return samples, trail


def prompt(examples: DataFrame, text: str, label: str, feature: str, key: str) -> str:
    """The few-shot part of a prompt: the examples in order of key."""
    rows = examples.select(F.format_string("Text: %s\nFeatures: %s\nClass: %s", text, F.concat_ws(",", F.transform(feature, lambda x: x.cast("string"))), F.col(label).cast("string"))).withColumn("k", F.lit(0))
    return "\n\n".join(r[0] for r in rows.collect())


def frontier_round(queue: DataFrame, results: DataFrame, on: str) -> DataFrame:
    """What is left of a queue once a round's results are in."""
    return queue.join(results.select(on).distinct(), on, "left_anti")
