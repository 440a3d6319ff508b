"""Streaming forms on files that arrive in parts."""

from pyspark.sql import functions as F

from webobs.streaming import incremental as inc


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_seen_and_summary(spark, tmp_path):
    src = tmp_path / "t.parquet"
    a = spark.createDataFrame([("x", 3, 1.0), ("y", 5, None)], "k string, o long, rtt double")
    b = spark.createDataFrame([("x", 1, 0.5), ("z", 9, 2.0)], "k string, o long, rtt double")
    a.coalesce(1).write.parquet(str(src))
    b.coalesce(1).write.mode("append").parquet(str(src))
    assert rows(inc.first_seen_until_now(spark, str(src), a.schema, "k", "o")) == [("x", 1), ("y", 5), ("z", 9)]
    assert rows(inc.summary_until_now(spark, str(src), a.schema, "k")) == [("x", 2, 2, 0.5), ("y", 1, 0, None), ("z", 1, 1, 2.0)]


def test_unseen_and_windows(spark, tmp_path):
    src, out = tmp_path / "e", tmp_path / "o"
    spark.createDataFrame([("u", "2025-01-01 00:00:00", 2.0), ("u", "2025-01-01 00:10:00", 1.0), ("v", "2025-01-01 05:00:00", 4.0)], "k string, s string, v double").select("k", F.to_timestamp("s").alias("ts"), "v").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    inc.append_results(inc.unseen(inc.read(spark, str(src), schema), "k", "ts"), lambda b: b.select("k"), str(out), str(tmp_path / "c"))
    assert [r["k"] for r in spark.read.parquet(str(out)).orderBy("k").collect()] == ["u", "v"]
    inc.append_results(inc.windowed_minima(inc.read(spark, str(src), schema), "k", "v", "ts", delay="1 hour"), lambda b: b.select("k", "least", "n"), str(tmp_path / "w"), str(tmp_path / "d"))
    assert ("u", 1.0, 2) in rows(spark.read.parquet(str(tmp_path / "w")).select("k", "least", "n"))


def test_stream_interval_join(spark, tmp_path):
    p = spark.createDataFrame([(1, "2025-01-01 00:00:30", "a"), (1, "2025-01-01 00:01:00", "edge"), (2, "2025-01-01 00:00:30", "b")], "m long, s string, ip string").select("m", F.to_timestamp("s").alias("ts"), "ip")
    w = spark.createDataFrame([(1, "2025-01-01 00:00:00", "2025-01-01 00:01:00", 7)], "wm long, a string, b string, vp long").select("wm", F.to_timestamp("a").alias("start"), F.to_timestamp("b").alias("end"), "vp")
    p.write.parquet(str(tmp_path / "p"))
    w.write.parquet(str(tmp_path / "w"))
    j = inc.joined_windows(inc.read(spark, str(tmp_path / "p"), p.schema), inc.read(spark, str(tmp_path / "w"), w.schema))
    inc.append_results(j, lambda b: b.select("vp", "ip"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(spark.read.parquet(str(tmp_path / "o")).select("vp", "ip")) == [(7, "a")]


def test_frontier_hands_out_what_no_result_covers(spark, tmp_path):
    src = tmp_path / "f"
    schema = "asn long, is_result boolean"
    for part in ([(1, False), (2, False), (3, False), (2, True), (1, False)], [(3, True), (4, False), (3, False), (None, False)], [(4, True), (5, True), (5, False), (6, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", inc.ROCKSDB)
    try:
        s = inc.read(spark, str(src), spark.read.parquet(str(src)).schema, files=100)
        inc.append_results(inc.frontier(s, "asn", "is_result"), lambda b: b, str(tmp_path / "o"), str(tmp_path / "c"))
        assert rows(spark.read.parquet(str(tmp_path / "o")).select("key")) == [(1,), (6,)]
        spark.createDataFrame([(1, False), (7, False), (6, True)], schema).coalesce(1).write.mode("append").parquet(str(src))
        s = inc.read(spark, str(src), spark.read.parquet(str(src)).schema, files=100)
        inc.append_results(inc.frontier(s, "asn", "is_result"), lambda b: b, str(tmp_path / "o"), str(tmp_path / "c"))
        assert rows(spark.read.parquet(str(tmp_path / "o")).select("key")) == [(1,), (6,), (7,)]  # state lives on over restarts
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
