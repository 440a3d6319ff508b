"""Records that differ only in formatting (problem 5): range-partitioned sort and a scan of adjacent runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webobs.runtime import cut, width

_NOT_WORD = r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+"


def word_key(c: Column | str) -> Column:
    """Words (runs of letters or digits) in order, lower-cased, with one blank between; '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _NOT_WORD, " "))


def bag_key(c: Column | str) -> Column:
    """As word_key, with the words sorted, so that their order doesn't matter."""
    return F.array_join(F.array_sort(F.split(word_key(c), " ")), " ")


def url_key(c: Column | str) -> Column:
    """Words up to the first '?', then the sorted parameters; parameters without words are dropped."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    head = word_key(F.substring_index(c, "?", 1))
    tail = F.when(F.locate("?", c) > 0, F.substring(c, F.locate("?", c) + 1, F.length(c))).otherwise(F.lit(""))
    params = F.array_sort(F.filter(F.transform(F.split(tail, "[&;]"), lambda p: F.trim(F.regexp_replace(F.lower(p), _NOT_WORD, " "))), lambda p: p != ""))
    return F.concat_ws("\u0001", head, F.array_join(params, "\u0002"))


def record_key(name: str = "name", url: str = "url") -> Column:
    """The canonical record: name as a bag of words, url in order, parameters as a bag."""
    return F.concat_ws("\u0003", bag_key(name), url_key(url))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each partition: its first and last key, and the first id and the rows of its last run."""
    from pyspark import TaskContext

    first = last = None
    tail_id, tail_n, runs = 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1)
        new = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
        if first is None:
            first = keys[0].as_py()
        if keys[0].as_py() != last:
            runs, tail_id, tail_n = runs + 1, ids[0].as_py(), 0
        if len(new):
            runs, tail_id, tail_n = runs + len(new), ids[int(new[-1])].as_py(), b.num_rows - int(new[-1])
        else:
            tail_n += b.num_rows
        last = keys[b.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "last": [last], "tail_id": [tail_id], "tail_n": [tail_n], "runs": [runs]})


def sorted_runs(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Each row's place in its run of equal keys: (id, keep_id = smallest id of the run, rank from 1).

    Rows are range-partitioned and sorted by (key, id), so a run that holds a third of all rows spreads over many
    partitions; runs are found by comparing neighbouring full keys. Only one summary row per partition (bounded by the
    number of partitions, not by the data) goes to the driver, to stitch runs that cross partition borders.
    Ids must be unique; rows with a null id are left out; an empty table gives an empty result.
    """
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id")).filter("id is not null")
    laid = cut(rows.repartitionByRange(width(df), "key", "id").sortWithinPartitions("key", "id"))
    marks = sorted(laid.mapInArrow(_summaries, "part int, first string, last string, tail_id long, tail_n long, runs long").collect())
    carry: dict[int, tuple[int, int]] = {}  # by partition: keep id and rows so far of the run that is open at its start
    key_, keep_, n_ = None, 0, 0
    for m in marks:
        if joined := m["first"] == key_:
            carry[m["part"]] = (keep_, n_)
        if m["runs"] == 1 and joined:
            n_ += m["tail_n"]
        else:
            key_, keep_, n_ = m["last"], m["tail_id"], m["tail_n"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, (keep, seen) = None, carry.get(TaskContext.get().partitionId(), (None, 0))
        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = b.column(0), b.column(1).to_numpy()
            starts = np.r_[0, np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1]
            sizes = np.diff(np.r_[starts, b.num_rows])
            keeps, before = ids[starts].copy(), np.zeros(len(starts), np.int64)
            if keep is not None and last in (None, keys[0].as_py()):
                keeps[0], before[0] = keep, seen
            last, keep, seen = keys[b.num_rows - 1].as_py(), int(keeps[-1]), int(before[-1] + sizes[-1])
            rank = np.arange(b.num_rows) + np.repeat(before - starts, sizes) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(keeps, sizes)), pa.array(rank)], ["id", "keep_id", "rank"])

    return laid.mapInArrow(scan, "id long, keep_id long, rank long")


def duplicates(df: DataFrame, key: Column, id_col: str = "row_id") -> DataFrame:
    """(keep_id, row_id): one row for each copy other than the representative (the smallest id)."""
    return sorted_runs(df, key, id_col).filter("id <> keep_id").select("keep_id", F.col("id").alias("row_id"))


def collapse(df: DataFrame, key: Column, id_col: str = "row_id") -> DataFrame:
    """One row per record, the one with the smallest id, with n_copies, its exact number of copies.

    The rank of the last row of a run is the size of the run, so counting needs one aggregate of (keep_id, max rank),
    which map-side combining shrinks before the shuffle.
    """
    n = sorted_runs(df, key, id_col).groupBy("keep_id").agg(F.max("rank").alias("n_copies"))
    return df.join(n, df[id_col] == n["keep_id"]).drop("keep_id")
