"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from webobs.runtime import checkpoint_dir


def _at(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/stream-{what}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema: StructType, files: int = 64) -> DataFrame:
    """Parquet files as a stream, `files` of them a batch; path may be a folder or one file (a pattern stands for either)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def summary_until_now(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """(key, hops, answers, least) over all rows seen so far; each batch stores the keys it changed, the last of which counts.

    The aggregate is kept by the state store, so the result is exact however rows are split over batches and however late
    they come: no watermark drops any.
    """
    out, ckpt = _at(spark, "out"), _at(spark, "ckpt")
    agg = read(spark, path, schema).groupBy(key).agg(F.count("*").alias("hops"), F.count("rtt").alias("answers"), F.round(F.min("rtt"), 3).alias("least"))
    agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
    last = spark.read.parquet(out).groupBy(key).agg(F.max_by(F.struct("hops", "answers", "least"), "batch").alias("m"))
    return last.select(key, "m.*")


def first_seen_until_now(spark: SparkSession, path: str, schema: StructType, key: str, order: str) -> DataFrame:
    """(key, order): the smallest `order` of each key. Every batch stores its own minima under its number, so a repeated batch
    (after a failure) overwrites itself; they are merged on reading."""
    out, ckpt = _at(spark, "out"), _at(spark, "ckpt")

    def step(b: DataFrame, i: int) -> None:
        b.groupBy(key).agg(F.min(order).alias(order)).write.mode("overwrite").parquet(f"{out}/batch={i}")

    read(spark, path, schema).select(key, order).writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.parquet(out).groupBy(key).agg(F.min(order).alias(order))


def unseen(stream: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Rows with a key not seen within the watermark; state is bounded by `delay`."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_minima(stream: DataFrame, key: str, value: str, time: str, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(key, window, least, n) in windows of event time; rows later than `delay` are left out, in append mode each window once."""
    return stream.withWatermark(time, delay).groupBy(key, F.window(time, size).alias("window")).agg(F.min(value).alias("least"), F.count("*").alias("n"))


def joined_windows(packets: DataFrame, windows: DataFrame, delay: str = "10 minutes", longest: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Stream-stream interval join: packets (m, ts, ip) in windows (wm, start, end, vp); watermarks bound the state."""
    p, w = packets.withWatermark("ts", delay), windows.withWatermark("start", delay)
    return p.join(w, F.expr(f"m = wm AND ts > start AND ts < end AND ts <= start + {longest}"))


def append_results(stream: DataFrame, score, path: str, ckpt: str) -> None:
    """Scores what is new and appends it: the checkpoint remembers what is done, as a log of results would."""
    stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(lambda b, i: score(b).write.mode("overwrite").parquet(f"{path}/batch={i}")).start().awaitTermination()


class _Frontier(StatefulProcessor):
    """Per key: whether a result has covered it, and whether its task was handed out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "covered boolean, given boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        covered, given = self.done.get() if self.done.exists() else (False, False)
        task = False
        for r in rows:  # the rows of one batch in any order: results count before tasks
            covered = covered or bool(r["is_result"].any())
            task = task or bool((~r["is_result"]).any())
        give = task and not covered and not given
        self.done.update((covered, given or give))
        if give:
            yield pd.DataFrame({"key": [key[0]]})

    def close(self) -> None:
        pass


def frontier(stream: DataFrame, key: str, is_result: str) -> DataFrame:
    """(key): tasks of a stream of tasks and results that no result has covered yet, each handed out once.

    A key's state is two flags in the state store, kept over batches and restarts. Needs the RocksDB state store provider.
    """
    kind = dict(stream.dtypes)[key]
    s = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(is_result, F.lit(False)).alias("is_result"))
    return s.groupBy("key").transformWithStateInPandas(statefulProcessor=_Frontier(), outputStructType=f"key {kind}", outputMode="Append", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
