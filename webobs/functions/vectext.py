"""Words and their hashes for whole Arrow batches at once (NumPy over the UTF-8 buffer, no loop over rows or words).

Input texts hold words with one blank between, as word_key makes them; whole texts are used, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, 1 << 16)
        for k, b in (("p", _P), ("i", _PINV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow["p"], _pow["i"]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _blank_punctuation(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the bytes of punctuation as blanks."""
    out = np.where(_WORD[raw], raw, np.uint8(32))
    two = np.flatnonzero(raw[:-1] == 0xC2)  # U+0080..U+00BF, less the letters among them
    two = two[~np.isin(raw[two + 1], (0xAA, 0xB5, 0xBA))]
    three = np.flatnonzero(((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81))) | ((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80)))
    for at, n in ((two, 2), (three, 3)):
        for j in range(n):
            out[at + j] = 32
    return out


class Words:
    """Words of an Arrow string column: for word w, its row (doc) and its bytes start..end; first[r]..first[r+1] are row r's.

    lower: take the capitals of ASCII and Latin-1 as small letters. punctuation: take punctuation as blanks, that of ASCII,
    Latin-1, the general block (dashes, quotes, bullets) and CJK.
    """

    def __init__(self, col: pa.Array, lower: bool = False, punctuation: bool = False):
        col = col.fill_null("") if col.null_count else col
        if pa.types.is_large_string(col.type):
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        else:
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = col.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        if lower and len(raw):  # the letters of ASCII and Latin-1
            after = np.r_[False, raw[:-1] == 0xC3]
            raw = raw + 32 * (((raw >= 65) & (raw <= 90)) | (after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))).astype(np.uint8)
        if punctuation and len(raw):
            raw = _blank_punctuation(raw)
        self.raw, self.rows = raw, len(col)
        inside = raw != 32
        # A word starts after a blank or where a row starts, and ends before a blank or where a row ends.
        begin = np.ones(len(raw) + 1, bool)
        begin[1:] = ~inside
        stop = ~inside[1:] if len(raw) else inside
        begin[off] = True
        stop = np.r_[stop, True] if len(raw) else stop
        stop[off[1:][off[1:] > 0] - 1] = True
        self.start = np.flatnonzero(inside & begin[:-1])
        self.end = np.flatnonzero(inside & stop) + 1
        self.first = np.searchsorted(self.start, off, "left")
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))
        p, _ = _powers(len(raw) + 1)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], dtype=np.uint64)])

    def numeric(self) -> np.ndarray:
        """Which words consist of ASCII digits."""
        n = np.concatenate([np.zeros(1, np.int64), np.cumsum((self.raw >= 48) & (self.raw <= 57))])
        return n[self.end] - n[self.start] == self.end - self.start

    def hashes(self, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words of one row; a hash depends on the bytes of the run only."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        i = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        _, inv = _powers(len(self.raw) + 1)
        s, e = self.start[i], self.end[i + k - 1]
        return i, mix((self._sum[e] - self._sum[s]) * inv[s] + (e - s).astype(np.uint64))


def distinct_in_rows(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order of row, with how often each occurs."""
    if not len(row):
        return row, h, np.zeros(0, np.int64)
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[at], h[at], np.diff(np.r_[at, len(row)])


def packed(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, int]:
    """(row, hash) as one 64-bit key, row first, with as many bits of the hash as fit, and how many these are: sorts fast."""
    bits = 64 - max(1, int(rows).bit_length())
    return (row.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)), bits


def run_sets(docs, id_col: str, text: str, k: int, name: str = "s"):
    """(id_col, name): the distinct runs of k words (split at white space) of each text, as hashes; texts of fewer words are left out."""
    from pyspark.sql import functions as F

    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                w = Words(c.column(1))
                i, h = w.hashes(k)
                row, h, _ = distinct_in_rows(w.doc[i], h)
                off = pa.array(np.searchsorted(row, np.arange(c.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(off, pa.array(h.view(np.int64)))], [id_col, name])

    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return docs.select(id_col, one.alias("__t")).mapInArrow(run, f"`{id_col}` {kind}, `{name}` array<long>").filter(F.size(name) > 0)
