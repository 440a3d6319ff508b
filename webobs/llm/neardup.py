"""Near-duplicate texts (problem 6): ProbMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.functions.vectext import Words, distinct_in_rows, mix, packed
from webobs.llm.copies import word_key
from webobs.operators.graph import components
from webobs.operators.near import pairs_within
from webobs.runtime import cut, stage

BANDS, ROWS = 30, 4  # at similarity 0.7 a pair shares no band with probability 0.0003


def probminhash(row: np.ndarray, elem: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, rows x m, of weighted sets given as (row, element) with weights > 0; repeats change nothing.

    Each element is a Poisson process of its weight's rate, a function of the element alone; each arrival falls into one of
    m registers, which keeps the earliest. An element ends when its next arrival is later than all registers of its row.
    All rows advance together, one arrival per element and round. Equal registers have the probability Jaccard similarity
    as their expected share. Rows without elements get all zeros.
    """
    q, sig = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    live, t, k = np.arange(len(row)), np.zeros(len(row)), 0
    while len(live):
        k += 1
        h = mix(elem[live] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        t[live] -= np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        if k > 1:
            stay = t[live] < last[row[live]]
            live, h = live[stay], h[stay]
        at = row[live] * m + (mix(h ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(q, at, t[live])
        won = q[at] == t[live]
        sig[at[won]] = elem[live[won]]
        last = q.reshape(rows, m).max(axis=1)
    return sig.reshape(rows, m)


def _weighted(w: Words, words: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct runs of `words` words of each row: weight 1, or with counted how often each occurs."""
    i, h = w.hashes(words)
    if counted:
        row, h, n = distinct_in_rows(w.doc[i], h)
        return row, h, n.astype(float)
    return w.doc[i], h, np.ones(len(h))  # a repeated element arrives at the same times and changes nothing


def _sketch(words: int, least: int, bands: int, per: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):  # bounds the signature arrays
                c = b.slice(lo, 512)
                w = Words(c.column(1))
                count = np.diff(w.first)
                keep = np.flatnonzero(count >= least)
                if not len(keep):
                    continue
                sig = probminhash(*_weighted(w, words, counted), c.num_rows, bands * per)[keep]
                x = np.zeros((len(keep), bands), np.uint64)
                for j in range(per):
                    x = mix(x * np.uint64(31) + sig[:, j * bands : (j + 1) * bands])
                x = mix(x + np.arange(bands, dtype=np.uint64))
                # The whole sequence of words as one hash: the sum of hashes of (position, word), 2 x 64 bits.
                wi, wh = w.hashes(1)
                pos = (wi - np.repeat(w.first[:-1], count)).astype(np.uint64)
                two = []
                for seed in (1, 2):
                    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(wh ^ mix(pos + np.uint64(seed << 40))), dtype=np.uint64)])
                    two.append((s[w.first[1:]] - s[w.first[:-1]])[keep].view(np.int64))
                # A text of fewer words than a run is like equal texts only: it has no bands.
                has = count[keep] >= words
                off = pa.array(np.r_[0, np.cumsum(has * bands)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(keep)), pa.array(two[0]), pa.array(two[1]), pa.ListArray.from_arrays(off, pa.array(x[has].ravel().view(np.int64)))], ["id", "h1", "h2", "bands"])

    return run


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """J_P of two weight vectors over the same elements: sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    with np.errstate(divide="ignore"):
        o = np.argsort(np.where(x > 0, y / np.where(x > 0, x, 1), np.inf), kind="stable")
    x, y = x[o], y[o]
    below, above = np.cumsum(x), np.r_[np.cumsum(y[::-1])[::-1][1:], 0.0]  # up to i by falling x / y, and beyond it
    both = (x > 0) & (y > 0)
    return float((1 / (below[both] / x[both] + above[both] / y[both])).sum())


def _similar(words: int, above: float, inclusive: bool, counted: bool):
    """Rows come sorted: a text with null b, then the texts b that are compared with it; gives the similar pairs."""

    def sims(text: pa.Array, pivot: np.ndarray) -> np.ndarray:
        w = Words(text)
        row, h, weight = _weighted(w, words, counted)
        group = np.cumsum(pivot) - 1
        at = np.flatnonzero(pivot)
        if counted:
            first = np.searchsorted(row, np.arange(len(pivot) + 1))
            out = np.zeros(len(pivot))
            for r in np.flatnonzero(~pivot):
                p, q = (slice(first[k], first[k + 1]) for k in (at[group[r]], r))
                e = np.union1d(h[p], h[q])
                x, y = np.zeros(len(e)), np.zeros(len(e))
                x[np.searchsorted(e, h[p])], y[np.searchsorted(e, h[q])] = weight[p], weight[q]
                out[r] = probability_jaccard(x, y) if len(e) else 0.0
            return out
        key, bits = packed(row, h, len(pivot))
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        row = (key >> np.uint64(bits)).astype(np.int64)
        size = np.bincount(row, minlength=len(pivot))
        g = (group[row].astype(np.uint64) << np.uint64(bits)) | (key & np.uint64((1 << bits) - 1))
        left, right = g[pivot[row]], g[~pivot[row]]  # both sorted by group; left by group and hash
        pos = np.minimum(np.searchsorted(left, right), max(len(left) - 1, 0))
        hit = left[pos] == right if len(left) else np.zeros(len(right), bool)
        both = np.bincount(row[~pivot[row]][hit], minlength=len(pivot))
        return both / np.maximum(size + size[at[group]] - both, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 1000):  # in slices that bound the arrays, each with its first pivot
                c = b.slice(lo, 1000)
                if held is not None and c.column(1)[0].is_valid:
                    c = pa.concat_batches([held, c])
                pivot = np.asarray(c.column(1).is_null())
                held = c.slice(int(np.flatnonzero(pivot)[-1]), 1)
                sim = sims(c.column(2), pivot)
                at = pa.array(np.flatnonzero(~pivot & ((sim >= above) if inclusive else (sim > above))))
                yield pa.RecordBatch.from_arrays([c.column(0).take(at), c.column(1).take(at), pa.array(sim[at.to_numpy()])], ["a", "b", "sim"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, words: int, above: float, inclusive: bool = False, counted: bool = False, block: int = 256) -> DataFrame:
    """(a, b, sim) of the distinct pairs (a, b) whose sets of word runs are similar; texts has (id, text).

    The pairs of one a are cut into blocks of about `block`: a text travels once to each block of its partners, so no text
    is copied to each of very many pairs and no task has all pairs of one text. Texts in no pair are dropped by the join.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    p = cut(pairs.select("a", "b").join(n, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("blk"), "b"))
    left = p.select("a", "blk").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", "blk", F.lit(None).cast("long").alias("b"), "text")
    right = p.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "blk", "b", "text")
    both = left.union(right).select("a", "blk", "b", word_key("text").alias("norm"))
    return both.repartition("a", "blk").sortWithinPartitions("a", "blk", F.asc_nulls_first("b")).select("a", "b", "norm").mapInArrow(_similar(words, above, inclusive, counted), "a long, b long, sim double")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                w = Words(c.column(1))
                i, h = w.hashes(words)
                row, h, _ = distinct_in_rows(w.doc[i], h)
                off = pa.array(np.searchsorted(row, np.arange(c.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(off, pa.array(h.view(np.int64)))], ["id", "s"])

    return run


def prefix_pairs(texts: DataFrame, words: int, above: float, block: int = 500) -> DataFrame:
    """(a, b), a < b: all pairs of texts (id, comp, text) of different comp that may have a Jaccard similarity of `above` or more.

    Exact prefix filtering: of two such texts the n - ceil(above x n) + 1 rarest runs of each share one (runs in order of
    rising frequency), sizes differ by no more than `above` allows, and what follows the shared run in both must suffice.
    Runs of one comp only are passed over; the list of a frequent run is cut into blocks, each two of which meet in a task.
    """
    s = stage(texts.select("id", word_key("text").alias("norm")).mapInArrow(_sets(words), "id long, s array<long>").filter(F.size("s") > 0).join(texts.select("id", "comp"), "id"))
    t = s.select("id", "comp", F.size("s").alias("n"), F.explode("s").alias("item"))
    df = t.groupBy("item").agg(F.count("*").alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("df > 1").select("item", "df", (F.col("c0") != F.col("c1")).alias("mixed"))
    t = t.join(df, "item")
    w = Window.partitionBy("id")
    # Runs of one text only come first in the order and use up the prefix.
    t = t.withColumn("place", F.row_number().over(w.orderBy("df", "item")) + F.col("n") - F.count("*").over(w))
    t = stage(t.filter(F.col("mixed") & (F.col("place") <= F.col("n") - F.ceil(F.lit(above) * F.col("n") - 1e-9) + 1)).select("item", "id", "comp", "n", "place"))
    k = t.groupBy("item").agg(F.ceil(F.count("*") / block).cast("int").alias("k"), F.count("*").alias("m")).filter("m > 1").select("item", "k")
    t = t.join(k, "item").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    x = t.select("item", F.col("own").alias("x"), F.col("other").alias("y"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
    y = t.select("item", F.col("other").alias("x"), F.col("own").alias("y"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    size = F.least("na", "nb") >= above * F.greatest("na", "nb") - 1e-9
    need = F.lit(above) / (1 + above) * (F.col("na") + F.col("nb")) - 1e-9
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") >= need
    return x.join(y, ["item", "x", "y"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & size & left).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, above: float = 0.8, inclusive: bool = True, least_words: int = 1, bands: int = BANDS, rows: int = ROWS, small: int = 8, counted: bool = False) -> DataFrame:
    """(id, group): the group of near-duplicates of each text with at least least_words words; group = its smallest id.

    Two texts are linked when the Jaccard similarity of their distinct runs of `words` words reaches `above` (more than
    it, unless inclusive); groups are formed by links and chains of links. With counted, runs weigh as often as they occur and
    the similarity is the probability Jaccard. A text of fewer than `words` words has no runs and is grouped with equal texts
    only; null and empty texts have no words. Ids must be unique; null ids are left out.

    Texts with the same words are one class first. Classes are put into buckets by their bands. A bucket of at most
    `small` classes gives all its pairs; a larger one its links to its smallest id only. What is in a larger bucket and not
    all in one component then is searched once more, exactly, by prefix_pairs (with counted: by the pairs of its different
    components, in blocks), so neither copies nor unlike texts of a hot bucket make all its pairs, and no link between
    different groups is lost.
    """
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = cut(texts.select("id", word_key("text").alias("norm")).mapInArrow(_sketch(words, least_words, bands, rows, counted), "id long, h1 long, h2 long, bands array<long>"))
    rep = cut(sk.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    member = sk.select("id", "h1", "h2").join(rep, ["h1", "h2"]).select("id", "rep")
    lone = sk.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("bands").alias("bucket"))
    many = lone.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1")
    inb = cut(lone.join(many, "bucket"))
    tiny = inb.filter(F.col("n") <= small).select("bucket", "id")
    pairs = tiny.select("bucket", F.col("id").alias("a")).join(tiny.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b").select("a", "b")
    big = inb.filter(F.col("n") > small)
    first = cut(pairs.union(big.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))).distinct())
    links = cut(verify(first, texts, words, above, inclusive, counted))
    comp = components(links)
    if not big.isEmpty():
        at = big.join(comp, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
        mixed = at.groupBy("bucket").agg((F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").select("bucket")
        at = cut(at.join(mixed, "bucket"))
        if counted:
            more = _mixed_pairs(at)
        else:
            more = prefix_pairs(texts.join(at.select("id", "comp").distinct(), "id"), words, above)
        links2 = cut(verify(cut(more.join(first, ["a", "b"], "left_anti")), texts, words, above, inclusive, counted))
        comp = components(links.union(links2).select("a", "b"))
    return member.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("group"))


def _mixed_pairs(at: DataFrame, block: int = 500) -> DataFrame:
    """(a, b), a < b: pairs of one bucket and different comp, of at (bucket, id, comp); large buckets in blocks."""
    n = at.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    t = at.join(n, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    x = t.select("bucket", F.col("own").alias("x"), F.col("other").alias("y"), F.col("id").alias("a"), F.col("comp").alias("ca"))
    y = t.select("bucket", F.col("other").alias("x"), F.col("own").alias("y"), F.col("id").alias("b"), F.col("comp").alias("cb"))
    return x.join(y, ["bucket", "x", "y"]).filter("a < b and ca <> cb").select("a", "b").distinct()


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids in the same group."""
    return pairs_within(groups, "group", "id")
