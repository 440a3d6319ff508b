"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webobs.llm import boilerplate as bp
from webobs.llm import copies, leak, match, mix, neardup, residue, split
from webobs.runtime import stage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match(_t(spark, d, "as_info"), _t(spark, d, "peeringdb_net"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("as_id", "net_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bp.boilerplate(bp.stage(bp.judged_lines(bp.featured_pages(_t(spark, d, "page_content")))))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "page_content")
    return bp.page_bodies(pages, bp.stage(bp.judged_lines(bp.featured_pages(pages))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = bp.residue_pages(bp.judged_lines(bp.featured_pages(_t(spark, d, "page_content"))))
    sites = residue.residue_addresses(_t(spark, d, "lg_page_info"), "row_id", "url")
    return pages.select(F.lit("page_content").alias("rec_table"), F.col("page_id").alias("rec_id")).union(sites.select(F.lit("lg_page_info"), "id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.duplicates(_t(spark, d, "lg_page_info"), copies.record_key())


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_t(spark, d, "lg_page_info"), copies.record_key()).select("row_id", "name", "url", "n_copies")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_t(spark, d, "page_content"), "page_id", "content", words=3, above=0.7, inclusive=False, least_words=60)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped_pairs(_groups(spark, d)).toDF("page_a", "page_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select(F.col("id").alias("page_id"), F.col("group").alias("group_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_item"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(_t(spark, d, "documents"), _t(spark, d, "source_plan"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(stage(p8_mix(spark, d)), _t(spark, d, "source_plan"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(_t(spark, d, "documents"), _t(spark, d, "source_plan"))


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_bodies, p3_found, p5_found, p5_records, p6_found, p6_groups, p7_found, p7_passages, p8_mix, p8_shares, p9_pieces)}
