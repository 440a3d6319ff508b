"""Sizes in tokens of a public byte-level BPE tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pattern that cuts a text into pieces before byte-pair merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Sizes(dict):
    """Piece -> its number of tokens; found once per piece and worker. Emptied when it has grown too large."""

    MOST = 1_000_000

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self.longest = int(self.width.max())

    def __missing__(self, piece: str) -> int:
        n = len(self.code.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) > self.MOST:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))


@lru_cache(maxsize=4)
def sizes(path: str = DEFAULT) -> Sizes:
    """The sizes of a vocabulary file: of that path, or of that name among the files shipped with the application."""
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return Sizes(path)


def ship_vocabulary(spark, path: str = DEFAULT) -> None:
    """Give the vocabulary file to all executors, so that it need not lie on their disks. Once per application."""
    sc = spark.sparkContext
    done = getattr(sc, "_webobs_vocabularies", set())
    if path not in done and os.path.exists(path):
        sc.addFile(path)
        sc._webobs_vocabularies = done | {path}


def with_tokens(df: DataFrame, text: str, path: str = DEFAULT, name: str = "n_tokens") -> DataFrame:
    """df without its text column, with the number of tokens of the whole text; 0 for null and empty texts."""
    ship_vocabulary(df.sparkSession, path)
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sizes(path).count
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], [*rest, name])

    kinds = dict(df.dtypes)
    return df.select(*rest, F.col(text)).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{name}` bigint"]))
