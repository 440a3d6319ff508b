"""Similarity links and clusters. Equal items are one class; candidates come from exact prefix filtering, never from all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.operators.graph import components
from webobs.runtime import cut, stage


def classes(docs: DataFrame, id_col: str, items: str) -> DataFrame:
    """(id, rep): equal sets of items are one class, named by its smallest id. Empty sets are left out."""
    d = docs.filter(F.size(items) > 0).select(F.col(id_col).alias("id"), F.array_sort(items).alias("s"))
    d = d.select("id", F.struct(F.xxhash64("s").alias("a"), F.hash("s").alias("b"), F.size("s").alias("n")).alias("h"))  # 96 bits and the size
    rep = d.groupBy("h").agg(F.min("id").alias("rep"))
    return d.join(rep, "h").select("id", "rep")


def overlap_links(docs: DataFrame, id_col: str, items: str, least: float, log: Callable[[Column], Column] = F.log, block: int = 5_000) -> DataFrame:
    """(a, b, sim), a < b: pairs of class representatives with sim = |A n B| / (log(max size) + min size) >= least.

    Exact prefix filtering: items are ordered by rising document frequency. A pair that reaches `least` shares at least
    k = ceil(least x (log s + s)) items, s being the smaller size, so some of the s - k + 1 rarest items of the smaller set lie
    in the other one. Those prefixes are joined with all items of sets at least as large, and survivors are verified on
    their whole sets. The list of an item of more than `block` sets is cut into parts, each of which meets the prefixes in a
    task of its own. Sets are arrays of distinct items.
    """
    hashed = F.col(items) if dict(docs.dtypes)[items] == "array<bigint>" else F.transform(F.col(items), lambda x: F.xxhash64(x))
    d = docs.filter(F.size(items) > 0).select(F.col(id_col).alias("id"), hashed.alias("s"))
    rep = classes(docs, id_col, items).select(F.col("rep").alias("id")).distinct()
    d = stage(d.join(rep, "id", "left_semi"))
    t = d.select("id", F.size("s").alias("n"), F.explode("s").alias("item"))
    df = t.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    t = t.join(df, "item")
    need = F.ceil(least * (log(F.col("n")) + F.col("n")) - 1e-9)
    # Items of one document only can't be shared; they come first in the order and use up the prefix.
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))
    alone = t.groupBy("id").agg(F.first("n").alias("n1"), F.count("*").alias("shared"))
    pre = t.withColumn("place", place).join(alone.select("id", (F.col("n1") - F.col("shared")).alias("alone")), "id").filter(F.col("place") + F.col("alone") <= F.col("n") - need + 1)
    parts = F.ceil(F.col("df") / block).cast("int")
    x = pre.select("item", F.col("id").alias("p"), F.col("n").alias("pn"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    y = t.select("item", F.col("id").alias("q"), F.col("n").alias("qn"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    big = F.col("qn") >= F.col("pn")
    could = least * (log(F.col("qn")) + F.col("pn")) <= F.col("pn") + 1e-9
    c = x.join(y, ["item", "part"]).filter(big & could & (F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    v = c.join(d.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(d.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    return v.select("a", "b", (both / (log(large) + small)).alias("sim")).filter(F.col("sim") >= least)


def links_inside(docs: DataFrame, id_col: str, items: str, clusters: DataFrame, least: float) -> DataFrame:
    """(a, b): links between documents of one cluster of clusters (id, cluster): similar class representatives, and each class's members with theirs.

    An item counts together with its cluster, so no pair of two clusters is ever a candidate.
    """
    d = docs.join(clusters.select(F.col("id").alias(id_col), "cluster"), id_col).select(id_col, F.transform(items, lambda x: F.xxhash64(x, "cluster")).alias("__i"))
    d = stage(d)
    c = classes(d, id_col, "__i")
    return overlap_links(d, id_col, "__i", least).select("a", "b").union(c.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def best_match_edges(sims: DataFrame, least: float, extra: float = 0.1) -> DataFrame:
    """(a, b, sim) of links a < b: all with sim > least + extra, and of each a its best b (the first of equals) with sim > least."""
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return sims.filter(F.col("sim") > least).withColumn("r", best).filter((F.col("r") == 1) | (F.col("sim") > least + extra)).select("a", "b", "sim")


def groups(docs: DataFrame, id_col: str, items: str, links: DataFrame) -> DataFrame:
    """(id, cluster, links): every document with items, its cluster (smallest id) and how many class links its class has."""
    cls = classes(docs, id_col, items)
    comp = components(links.select("a", "b"))
    deg = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return cls.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").join(deg, "rep", "left").select("id", F.coalesce("comp", "rep").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))


def two_stage(stage1: DataFrame, links2: DataFrame, larger_than: int = 10) -> DataFrame:
    """(id, cluster): clusters of stage1 (id, cluster) of more than larger_than members are split by the components of
    links2 (a, b) inside them, named cluster_k with k from 0 by smallest member; others keep their number as text."""
    big = stage1.groupBy("cluster").count().filter(F.col("count") > larger_than).select("cluster")
    m = stage1.join(big, "cluster")
    inside = links2.join(m.toDF("cluster", "a"), "a").join(m.select(F.col("cluster").alias("c2"), F.col("id").alias("b")), "b").filter("cluster = c2").select("a", "b")
    comp = components(inside)
    sub = m.join(comp, "id", "left").select("id", "cluster", F.coalesce("comp", "id").alias("comp"))
    no = sub.select("cluster", "comp").distinct().withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("comp")) - 1)
    split = sub.join(no, ["cluster", "comp"]).select("id", F.concat_ws("_", "cluster", "k").alias("cluster"))
    return split.union(stage1.join(big, "cluster", "left_anti").select("id", F.col("cluster").cast("string")))


def sequence_ratio(a: list[str], b: list[str]) -> float:
    """Sum of matching blocks over (shorter length + log2 of the longer one); 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    m = SequenceMatcher(None, list(a), list(b))
    return sum(x.size for x in m.get_matching_blocks()) / (min(len(a), len(b)) + math.log2(max(len(a), len(b))))


def _could_match(pa: np.ndarray, la: np.ndarray, lb: np.ndarray, tb: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs may reach `least`: matching blocks are a common subsequence, so its length (by bit vectors) is a bound.

    pa: for each pair the places of each symbol in its first sequence as bits, tb: its second sequence, padded by a symbol
    without places; la, lb: lengths, at most 64.
    """
    v = np.full(len(la), ~np.uint64(0))
    row = np.arange(len(la))
    for j in range(tb.shape[1]):
        u = v & pa[row, tb[:, j]]
        v = (v + u) | (v - u)
    low = ~np.uint64(0) >> (64 - la).astype(np.uint64)
    return np.bitwise_count(~v & low) >= least * (np.minimum(la, lb) + np.log2(np.maximum(la, lb))) - 1e-9


def _verified(least: float, width: str, most: int = 100_000):
    """Scores all pairs of two blocks of sequences: rows of x and y (lists of id and codes) and whether both are one block."""

    def long_enough(x: list[bytes]) -> np.ndarray:
        return np.array([len(q) for q in x], np.int64) // np.dtype(width).itemsize

    def pairs(x: list[dict], y: list[dict], i: np.ndarray, j: np.ndarray) -> list[tuple]:
        sx, sy = [q["seq"] for q in x], [q["seq"] for q in y]
        nx, ny = long_enough(sx), long_enough(sy)
        small, large = np.minimum(nx[i], ny[j]), np.maximum(nx[i], ny[j])
        ok = small >= least * (small + np.log2(large)) - 1e-9
        i, j, large = i[ok], j[ok], large[ok]
        short = large <= 64
        keep = ~short
        if short.any():
            bits, codes = np.zeros((len(sx), 65), np.uint64), np.full((len(sy), int(ny[ny <= 64].max())), 64)
            for k in np.flatnonzero(nx <= 64):
                # Symbols that share a place of this table only make the bound larger.
                np.bitwise_or.at(bits[k], np.frombuffer(sx[k], width) % 64, np.uint64(1) << np.arange(nx[k]).astype(np.uint64))
            for k in np.flatnonzero(ny <= 64):
                codes[k, : ny[k]] = np.frombuffer(sy[k], width) % 64
            a, b = i[short], j[short]
            keep[short] = _could_match(bits[a], nx[a], ny[b], codes[b], least)
        out = []
        for p, q in zip(i[keep].tolist(), j[keep].tolist()):
            u, w = (x[p], y[q]) if x[p]["id"] < y[q]["id"] else (y[q], x[p])
            sim = sequence_ratio(np.frombuffer(u["seq"], width).tolist(), np.frombuffer(w["seq"], width).tolist())
            if sim >= least:
                out.append((u["id"], w["id"], sim))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            xs, ys, i, j, n, nx, ny, out = [], [], [], [], 0, 0, 0, []
            for row in range(t.num_rows):
                x, y, same = t.column(0)[row].as_py(), t.column(1)[row].as_py(), t.column(2)[row].as_py()
                p, q = np.triu_indices(len(x), 1) if same else np.indices((len(x), len(y))).reshape(2, -1)
                xs, ys, i, j = xs + [x], ys + [y], i + [p + nx], j + [q + ny]
                n, nx, ny = n + len(p), nx + len(x), ny + len(y)
                if n >= most or row == t.num_rows - 1:
                    out += pairs([z for x in xs for z in x], [z for y in ys for z in y], np.concatenate(i), np.concatenate(j))
                    xs, ys, i, j, n, nx, ny = [], [], [], [], 0, 0, 0
            if out:
                a, b, sim = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    return run


def tag_links(docs: DataFrame, id_col: str, tags: str, least: float = 0.8, block: int = 64) -> DataFrame:
    """(a, b, sim), a < b: pairs of distinct tag sequences with sequence_ratio >= least.

    No such pair is lost. Matching blocks can't hold more than the tags both sequences have, each as often as in both, so
    candidates are the pairs whose bags of tags reach `least` (overlap_links over tags numbered by occurrence, with the
    logarithm to 2). Sequences of equal bags are one class there and split into blocks of about `block`; all pairs of two
    blocks are verified, first by the length of their longest common subsequence. Equal sequences are one class.
    """
    d = docs.filter(F.size(tags) > 0).select(F.col(id_col).alias("id"), F.col(tags).alias("tags"))
    rep = d.groupBy(F.md5(F.encode(F.array_join("tags", " "), "UTF-8"))).agg(F.min("id").alias("id")).select("id")
    d = cut(d.join(rep, "id"))
    code = {r[0]: i for i, r in enumerate(d.select(F.explode("tags")).distinct().collect())}  # one row per kind of tag
    width = "u1" if len(code) <= 1 << 8 else "u4"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([code[x] for x in s], width).tobytes() for s in b.column(1).to_pylist()], pa.binary())], ["id", "seq"])

    times = lambda t: F.size(F.filter("tags", lambda x: x.eqNullSafe(t)))
    items = F.flatten(F.transform(F.array_distinct("tags"), lambda t: F.transform(F.sequence(F.lit(1), times(t)), lambda i: F.concat_ws(" ", i.cast("string"), t))))
    bags = cut(d.select("id", items.alias("bag")))
    cls = classes(bags, "id", "bag")
    kind = dict(d.dtypes)["id"]
    count = cls.groupBy("rep").agg(F.count("*").alias("n"))
    m = d.mapInArrow(coded, f"id {kind}, seq binary").join(cls, "id").join(count, "rep")
    m = m.groupBy("rep", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block).cast("long")).alias("no")).agg(F.collect_list(F.struct("id", "seq")).alias("m"))
    m = stage(m)
    links = overlap_links(bags, "id", "bag", least, F.log2).select("a", "b").union(count.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    c = links.join(m.toDF("a", "na", "x"), "a").join(m.toDF("b", "nb", "y"), "b").filter("a <> b or na <= nb")
    return c.select("x", "y", F.expr("a = b and na = nb").alias("same")).mapInArrow(_verified(least, width), f"a {kind}, b {kind}, sim double")


def _joined(ids: list, seq: list[np.ndarray], comp: np.ndarray, side: np.ndarray, least: float, strip: int = 256, most: int = 200_000) -> Iterator[tuple]:
    """(a, b) with sequence_ratio >= least that join the components of sequences in which such pairs of different comp lie.

    side: 0 and 1 where pairs of two blocks are meant, all 0 where all pairs are. A pair is left out once its ends are joined;
    every other pair is excluded by its bag of symbols or its longest common subsequence (upper bounds), or scored.
    """
    n = np.array([len(q) for q in seq])
    kinds = min(int(max(q.max() for q in seq)) + 1, 16)
    bag = np.zeros((kinds, len(seq)), np.min_scalar_type(int(n.max())))
    bits, codes = np.zeros((len(seq), 65), np.uint64), np.full((len(seq), min(int(n.max()), 64)), 64)
    for k, q in enumerate(seq):
        bag[:, k] = np.bincount(q % kinds, minlength=kinds)  # symbols that share a place only make the bounds larger
        if len(q) <= 64:
            np.bitwise_or.at(bits[k], q % 64, np.uint64(1) << np.arange(len(q)).astype(np.uint64))
            codes[k, : len(q)] = q % 64
    label = np.unique(comp, return_inverse=True)[1]
    up = list(range(int(label.max()) + 1))

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    two = bool(side.any())
    xs, ys = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(seq)),) * 2
    xs, ys = xs[np.argsort(-n[xs], kind="stable")], ys[np.argsort(-n[ys], kind="stable")]
    for at in range(0, len(xs), strip):
        x, y = xs[at : at + strip], ys if two else ys[at:]
        now = np.array([root(c) for c in range(len(up))])[label]
        both = np.zeros((len(x), len(y)), bag.dtype)
        for b in bag:
            both += np.minimum(b[x][:, None], b[y][None, :])
        # The least that any pair of these lengths needs, as a table over both lengths.
        lx, ix = np.unique(n[x], return_inverse=True)
        ly, iy = np.unique(n[y], return_inverse=True)
        need = np.ceil(least * (np.minimum.outer(lx, ly) + np.log2(np.maximum.outer(lx, ly))) - 1e-9)
        need = np.where(need > np.minimum.outer(lx, ly), -1, need)
        top = np.iinfo(bag.dtype).max
        ok = both >= np.where(need < 0, top, need).astype(bag.dtype)[ix][:, iy]
        if (need < 0).any() and (both == top).any():
            ok &= (need >= 0)[ix][:, iy]
        ok &= now[x][:, None] != now[y][None, :]
        i, j = np.nonzero(ok)
        if not two:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), most):
            now = np.array([root(c) for c in range(len(up))])[label]
            p, q = x[i[k : k + most]], y[j[k : k + most]]
            apart = now[p] != now[q]
            p, q = p[apart], q[apart]
            short = np.maximum(n[p], n[q]) <= 64
            keep = ~short
            if short.any():
                keep[short] = _could_match(bits[p[short]], n[p[short]], n[q[short]], codes[q[short]], least)
            for u, w in zip(p[keep].tolist(), q[keep].tolist()):
                c, d = root(int(label[u])), root(int(label[w]))
                if c != d:
                    u, w = (u, w) if ids[u] < ids[w] else (w, u)
                    if sequence_ratio(seq[u].tolist(), seq[w].tolist()) >= least:
                        up[d] = c
                        yield ids[u], ids[w]


def tag_components(docs: DataFrame, id_col: str, tags: str, least: float = 0.8, first: int = 8_000, block: int = 3_000) -> DataFrame:
    """(id, comp) of distinct tag sequences: the components of tag_links, without a list of all links.

    Links grow with the square of the sequences, what they join doesn't. Blocks of about `first` sequences are solved alone;
    then all pairs of blocks of about `block` are gone through, where only pairs of different components are looked at.
    Sequences too short for any link are left out; a sequence without a link is its own component.
    """
    size = F.size(tags)
    d = docs.filter(size > 0).select(F.col(id_col).alias("id"), F.col(tags).alias("tags"))
    d = d.groupBy(F.md5(F.encode(F.array_join("tags", " "), "UTF-8")).alias("h")).agg(F.min_by(F.struct("id", "tags"), "id").alias("x")).select("x.*")
    d = cut(d.filter(F.size("tags") >= least * (F.size("tags") + F.log2(F.size("tags").cast("double"))) - 1e-9))
    code = {r[0]: i for i, r in enumerate(d.select(F.explode("tags")).distinct().collect())}  # one row per kind of tag
    width, kind = "u1" if len(code) <= 1 << 8 else "u4", dict(d.dtypes)["id"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([code[x] for x in s], width).tobytes() for s in b.column(1).to_pylist()], pa.binary())], ["id", "seq"])

    def run(g: pa.Table) -> pa.Table:
        seq = [np.frombuffer(x, width) for x in g.column("seq").to_pylist()]
        side = np.array(g.column("no").to_pylist()) != g.column("i")[0].as_py()
        got = list(_joined(g.column("id").to_pylist(), seq, np.array(g.column("comp").to_pylist()), side, least))
        return pa.table([pa.array([x[k] for x in got], g.schema.field("id").type) for k in (0, 1)], ["a", "b"])

    def links(x: DataFrame, n: int, pairs: bool) -> DataFrame:
        x = x.withColumn("no", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if pairs else F.col("no"))
        x = x.select("id", "seq", "comp", "no", F.least("no", "o").alias("i"), F.greatest("no", "o").alias("j"))
        x = x.repartition(min(n * (n + 1) // 2 if pairs else n, 2_000), "i", "j")
        return stage(x.groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}"))

    d = stage(d.mapInArrow(coded, f"id {kind}, seq binary"))
    n = d.count()
    labelled = lambda l: d.join(components(l), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    l = links(d.withColumn("comp", F.col("id")), -(-n // first) or 1, False)
    if n > first:
        l = l.union(links(labelled(l), -(-n // block), True))
    return labelled(l).select("id", "comp")


def structure_groups(docs: DataFrame, id_col: str, tags: str, least: float = 0.8) -> DataFrame:
    """(id, cluster): components of documents by links of tag_links; equal sequences are together. Empty sequences are left out."""
    d = docs.filter(F.size(tags) > 0).select(F.col(id_col).alias("id"), F.md5(F.encode(F.array_join(tags, " "), "UTF-8")).alias("h"))
    rep = d.groupBy("h").agg(F.min("id").alias("rep"))
    comp = tag_components(docs, id_col, tags, least).select(F.col("id").alias("rep"), "comp")
    return d.join(rep, "h").join(comp, "rep", "left").select("id", F.coalesce("comp", "rep").alias("cluster"))
