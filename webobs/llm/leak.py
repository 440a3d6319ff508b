"""Test items that leak into documents (problem 7): SimHash windows, blocks of Hamming distance 0, exact verification.

A window as large as the shortest leak (18 words) is fingerprinted as blocks, each a SimHash of a segment of the window. One
word in nine may be replaced, so 18 words hold at most 2 replaced ones, and of 3 segments at least one is untouched: its
block has distance 0. Every window within that radius therefore agrees with its item in some block, wherever it lies,
which is the guarantee of multi-index Hamming search. A SimHash of the whole window gives none: replacing 2 of 18 words
turns about 10 of 64 bits, and blocks that survive that are too short to select anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webobs.functions.vectext import Words

BITS = 24


def spaced_words(c: Column | str) -> Column:
    """Words split at white space, lower-cased, without punctuation inside or around them; '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s  -  　]+", ""), r"[\s  -  　]+", " "))


def segment_simhash(h: np.ndarray, k: int, bits: int = BITS) -> np.ndarray:
    """SimHash of each run of k word hashes: bit j is set where at least half of the words have it set."""
    out = np.zeros(max(0, len(h) - k + 1), np.int64)
    for j in range(bits):
        c = np.concatenate([np.zeros(1, np.int32), np.cumsum((h >> np.uint64(j)).astype(np.int32) & 1, dtype=np.int32)])
        out |= ((2 * (c[k:] - c[:-k]) >= k).astype(np.int64)) << j
    return out


def _plan(n: int, least: int, per: int) -> int:
    """Words of a segment, so that one segment of the shortest leak of an item of n words is untouched; 0 for no words."""
    m = min(n, least)
    return m // (m // per + 1)


def _index(words: list[np.ndarray], least: int, per: int) -> dict[int, tuple]:
    """By length of segment: codes in order, their item and position, and which codes occur."""
    by_k: dict[int, tuple] = {}
    for k in sorted({_plan(len(w), least, per) for w in words}):
        own = [i for i, w in enumerate(words) if _plan(len(w), least, per) == k]
        code = np.concatenate([segment_simhash(words[i], k) for i in own])
        item = np.concatenate([np.full(len(words[i]) - k + 1, i) for i in own])
        pos = np.concatenate([np.arange(len(words[i]) - k + 1) for i in own])
        o = np.argsort(code, kind="stable")
        seen = np.zeros(1 << BITS, bool)
        seen[code] = True
        by_k[k] = code[o], item[o], pos[o], seen
    return by_k


def _finder(ids: np.ndarray, words: list[np.ndarray], least: int, per: int):
    flat = np.concatenate(words)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def check(doc: np.ndarray, item: int, shift: int) -> tuple[int, int] | None:
        """(words, equal words) of the longest leak on one alignment: it begins and ends with equal words."""
        it = words[item]
        lo, hi = max(0, -shift), min(len(it), len(doc) - shift)
        eq = doc[lo + shift : hi + shift] == it[lo:hi]
        need = min(least, len(it))
        if eq.sum() < need - need // per:
            return None
        g = np.concatenate([[0], np.cumsum(np.where(eq, -1, per - 1))])
        at = np.flatnonzero(eq)
        best = None
        for a in at:
            b = at[at >= a + need - 1]
            b = b[g[b + 1] <= g[a]]
            if len(b) and (best is None or b[-1] - a + 1 > best[0]):
                best = int(b[-1] - a + 1), int(eq[a : b[-1] + 1].sum())
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_k = _index(words, least, per)  # made in the task: only the items' word hashes travel
        for whole in batches:
            size = np.diff(np.r_[0, np.cumsum(pa.compute.binary_length(whole.column(1)).fill_null(0).to_numpy())])
            part = np.cumsum(size) // 2_000_000  # slices of about 2 MB, or one text
            for lo, hi in zip(np.r_[0, np.flatnonzero(np.diff(part)) + 1], np.r_[np.flatnonzero(np.diff(part)) + 1, whole.num_rows]):
                b = whole.slice(lo, hi - lo)
                w = Words(b.column(1))
                _, h = w.hashes(1)
                found: dict[tuple[int, int], tuple[int, int]] = {}
                for k, (code, item, pos, seen) in by_k.items():
                    mine = segment_simhash(h, k)
                    at = np.flatnonzero(seen[mine])
                    at = at[w.doc[at] == w.doc[at + k - 1]]
                    left, right = np.searchsorted(code, mine[at], "left"), np.searchsorted(code, mine[at], "right")
                    n = right - left
                    p, e = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
                    # Equal blocks of unequal words, by chance, end here.
                    same = np.ones(len(p), bool)
                    for j in range(k):
                        same &= h[p + j] == flat[first[item[e]] + pos[e] + j]
                    p, e = p[same], e[same]
                    doc, it = w.doc[p], item[e]
                    lines = np.unique(np.stack([doc, it, p - w.first[doc] - pos[e]], 1), axis=0)
                    # On each alignment count equal words; only those with enough go on to the exact check.
                    for d, i, s in lines[_enough(lines, h, w.first, flat, first, least, per)]:
                        if (r := check(h[w.first[d] : w.first[d + 1]], i, s)) is not None:
                            found[d, i] = max(found.get((d, i), r), r)
                if found:
                    d = np.array([x for x, _ in found])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([int(ids[i]) for _, i in found]), pa.array([x for x, _ in found.values()]), pa.array([y for _, y in found.values()])], ["doc_id", "item_id", "n_words", "n_equal"])

    return run


def _enough(lines: np.ndarray, h, dfirst, flat, ifirst, least: int, per: int) -> np.ndarray:
    """Which alignments (doc, item, shift) have enough equal words for a leak, counted for all at once, in blocks."""
    out = np.zeros(len(lines), bool)
    for lo in range(0, len(lines), 20_000):
        d, i, s = lines[lo : lo + 20_000].T
        n = ifirst[i + 1] - ifirst[i]
        row = np.repeat(np.arange(len(d)), n)
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = q + s[row]
        ok = (at >= 0) & (at < (dfirst[d + 1] - dfirst[d])[row])
        eq = np.zeros(len(q), bool)
        eq[ok] = h[(dfirst[d][row] + at)[ok]] == flat[(ifirst[i][row] + q)[ok]]
        need = np.minimum(n, least)
        out[lo : lo + 20_000] = np.bincount(row, eq, minlength=len(d)) >= need - need // per
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 18, per: int = 9, chunk: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal): documents with a passage of an item of at least `least` words, or all its words.

    Letter case, punctuation and layout don't matter; at most one word in `per` of the passage may be another one, not its
    first or last. n_words is the length of the longest such passage, n_equal its equal words. Items without words, null
    texts and empty documents give no row; equal documents give a row each.

    Items are the stated query set: they are read in chunks of about `chunk` bytes of text, each of which goes to all tasks,
    and documents are scanned once per chunk without a shuffle.
    """
    q = items.select(F.col(item_id).cast("long").alias("i"), spaced_words(item_text).alias("t")).filter("i is not null and t <> ''")
    total = q.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // chunk))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), spaced_words(doc_text).alias("t")).filter("doc_id is not null and t <> ''")
    schema, out = "doc_id long, item_id long, n_words long, n_equal long", None
    for k in range(parts):
        rows = (q if parts == 1 else q.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)).collect()
        if not rows:
            continue
        w = Words(pa.array([r["t"] for r in rows]))
        _, h = w.hashes(1)
        got = texts.mapInArrow(_finder(np.array([r["i"] for r in rows]), [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])], least, per), schema)
        out = got if out is None else out.union(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
