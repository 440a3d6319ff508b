"""Points inside windows, votes, and the assignment of sources to points."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webobs.runtime import stage

_SETS = ["everywhere", "often"]


def interval_join(points: DataFrame, windows: DataFrame, key: str, ts: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points (key, ts, ...) joined with the windows (key, start, end, ...) that hold them: start < ts < end.

    Both sides are cut into buckets of `bucket` (choose it near the usual length of a window) and joined on key and bucket,
    so the plan is an equi-join with a residual and never a nested loop. Null times and windows that end before they
    start match nothing.
    """
    b = lambda c: F.floor(F.col(c) / bucket).cast("long")
    w = windows.filter(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(b(start), b(end))))
    p = points.withColumn("__b", b(ts))
    return p.join(w, [key, "__b"]).filter((F.col(ts) > F.col(start)) & (F.col(ts) < F.col(end))).drop("__b")


def votes(hits: DataFrame, vp: str, ip: str, machine: str) -> DataFrame:
    """(vp, ip, votes): machines in whose window of vp the address was seen."""
    return hits.groupBy(vp, ip).agg(F.count_distinct(machine).alias("votes"))


def candidates(voted: DataFrame, machines: int) -> DataFrame:
    """voted with everywhere (seen by all machines) and often (by two thirds of them, at least 2); others are left out."""
    most = max(2, -(-2 * machines // 3))
    return voted.withColumn("everywhere", F.col("votes") == machines).withColumn("often", F.col("votes") >= most).filter("everywhere or often")


def noise(hits: DataFrame, vp: str, ip: str, machine: str, share: float = 0.3) -> DataFrame:
    """(ip, n): addresses in the windows of at least `share` of all (vp, machine)'s vps, and at least twice."""
    n_vps = hits.select(vp).distinct().count()
    return hits.select(vp, machine, ip).distinct().groupBy(ip).agg(F.count("*").alias("n")).filter((F.col("n") >= 2) & (F.col("n") >= share * n_vps))


def assign_pass(cands: list[tuple]) -> list[tuple]:
    """Unique assignment to a fixpoint: vps in order take the only address left in their 'everywhere' set, else in 'often'.

    cands: (vp, ip, everywhere, often). An address is given once, a vp assigned once; passes repeat until one assigns nothing.
    """
    sets: dict = {}
    for vp, ip, every, often in cands:
        e = sets.setdefault(vp, (set(), set()))
        if every:
            e[0].add(ip)
        if often:
            e[1].add(ip)
    given, got, more = set(), {}, True
    while more:
        more = False
        for vp in sorted(sets):
            if vp in got:
                continue
            for s in sets[vp]:
                if len(left := s - given) == 1:
                    got[vp] = left.pop()
                    given.add(got[vp])
                    more = True
                    break
    return sorted(got.items())


def assign_codes(vp: np.ndarray, ip: np.ndarray, every: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """assign_pass over distinct (vp, ip) rows as arrays: the assigned vps and their addresses.

    Of each set only the number and the sum of the codes of what is left are kept; vps with one address left wait in a heap
    for their turn in this pass or the next, so time and memory follow the rows, not rows times passes.
    """
    vps, v = np.unique(vp, return_inverse=True)
    ips, i = np.unique(ip, return_inverse=True)
    order = np.argsort(i, kind="stable")
    v, i, flags = v[order].astype(np.int32), i[order], [np.asarray(f, bool)[order] for f in (every, often)]
    at = np.searchsorted(i, np.arange(len(ips) + 1))
    number = [np.bincount(v[f], minlength=len(vps)) for f in flags]
    total = [np.zeros(len(vps), np.int64) for _ in flags]
    for t, f in zip(total, flags):
        np.add.at(t, v[f], i[f])
    now, later = np.flatnonzero((number[0] == 1) | (number[1] == 1)).tolist(), []  # in order, so a heap
    got: dict[int, int] = {}
    while now:
        while now:
            w = heapq.heappop(now)
            k = 0 if number[0][w] == 1 else 1
            if w in got or number[k][w] != 1:
                continue
            x = got[w] = int(total[k][w])
            rows = slice(at[x], at[x + 1])
            for n, t, f in zip(number, total, flags):
                n[v[rows][f[rows]]] -= 1
                t[v[rows][f[rows]]] -= x
            near = v[rows]
            for u in near[(number[0][near] == 1) | (number[1][near] == 1)].tolist():
                if u not in got:
                    heapq.heappush(now if u > w else later, u)
        now, later = later, []
    return vps[list(got)], ips[list(got.values())]


def _sets_of(sizes: DataFrame, vp: str, n: int) -> DataFrame:
    """The vps of sizes (vp, __everywhere, __often) with a set of size n, and which of theirs has it."""
    return sizes.filter(" or ".join(f"__{s} = {n}" for s in _SETS)).select(vp, *[(F.col(f"__{s}") == n).alias(f"__{s}") for s in _SETS])


def _may_act(cands: DataFrame, vp: str, ip: str, rounds: int) -> DataFrame | None:
    """cands without the sets that can never come down to one address, or None if that wasn't settled within `rounds`.

    An address can only be given if a set of some vp can come down to it, so from the sets of one address on, sets with at
    most one address that can't be given make that one possible. A set with two such addresses for good is left out.
    """
    sizes = cands.groupBy(vp).agg(*[F.count(F.when(F.col(s), True)).alias(f"__{s}") for s in _SETS])
    possible = None
    for _ in range(rounds):
        # __every and __often: addresses of each set that can't be given, as far as known
        now = cands.join(_sets_of(sizes, vp, 1), vp).filter(" or ".join(f"{s} and __{s}" for s in _SETS)).select(ip).distinct()
        new = stage(now if possible is None else now.join(possible, ip, "left_anti"))
        if new.isEmpty():
            return cands.join(_sets_of(sizes, vp, 0), vp).select(vp, ip, *[(F.col(s) & F.col(f"__{s}")).alias(s) for s in _SETS]).filter(" or ".join(_SETS))
        possible = new if possible is None else possible.union(new)
        less = cands.join(new, ip, "left_semi").groupBy(vp).agg(*[F.count(F.when(F.col(s), True)).alias(f"__less_{s}") for s in _SETS])
        sizes = stage(sizes.join(less, vp, "left").select(vp, *[(F.col(f"__{s}") - F.coalesce(f"__less_{s}", F.lit(0))).alias(f"__{s}") for s in _SETS]))
    return None


def assign(cands: DataFrame, vp: str, ip: str, rounds: int = 30) -> DataFrame:
    """(vp, ip) of assign_pass. Null vps and addresses are left out.

    Sets that can never come down to one address are found by joins and left out first, with addresses in no other set;
    chains of more than `rounds` vps keep theirs. The order of vps matters across all rows, so the rest runs per connected
    component of its (vp, address) graph, as arrays: components don't influence each other.
    """
    from webobs.operators.graph import components

    c = cands.filter(F.col(vp).isNotNull() & F.col(ip).isNotNull()).groupBy(vp, ip)
    c = stage(c.agg(*[F.coalesce(F.bool_or(s), F.lit(False)).alias(s) for s in _SETS]).filter(" or ".join(_SETS)))
    less = _may_act(c, vp, ip, rounds)
    c = c if less is None else stage(less)
    kinds = dict(cands.dtypes)
    e = c.select(F.xxhash64(F.lit("v"), vp).alias("a"), F.xxhash64(F.lit("i"), ip).alias("b"))
    comp = components(e).select(F.col("id").alias("__n"), "comp")
    c = c.withColumn("__n", F.xxhash64(F.lit("v"), vp)).join(comp, "__n").select("comp", vp, ip, *_SETS)

    def run(g: pa.Table) -> pa.Table:
        v, i = assign_codes(*[g.column(x).to_numpy() for x in (vp, ip, *_SETS)])
        return pa.table([pa.array(v, g.schema.field(vp).type), pa.array(i, g.schema.field(ip).type)], [vp, ip])

    return c.groupBy("comp").applyInArrow(run, f"{vp} {kinds[vp]}, {ip} {kinds[ip]}")


def first_round(cands: DataFrame, vp: str, ip: str) -> DataFrame:
    """(vp, ip): vps whose set has one address before anything is assigned."""
    g = cands.groupBy(vp).agg(F.sum(F.col("everywhere").cast("int")).alias("ne"), F.sum(F.col("often").cast("int")).alias("no"), F.min(F.when(F.col("everywhere"), F.col(ip))).alias("ie"), F.min(F.when(F.col("often"), F.col(ip))).alias("io"))
    return g.select(vp, F.when(F.col("ne") == 1, F.col("ie")).when(F.col("no") == 1, F.col("io")).alias(ip)).filter(F.col(ip).isNotNull())
