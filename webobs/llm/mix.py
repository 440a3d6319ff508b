"""Mixing sources to target weights (problem 8): balanced sampling by the cube method."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webobs.llm.tokens import DEFAULT, with_tokens
from webobs.runtime import cut, stage


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for the constraints (total size, number of units), in the order given.

    Three fractional units at a time move along the null space of their constraint columns - for the columns
    (size_i, 1) that is the cross product (s2 - s3, s3 - s1, s1 - s2) - until one is 0 or 1, so both totals stay as they
    are; which way is drawn so that probabilities keep their expectation. At most two fractional units remain.
    """
    p = p.astype(float).copy()
    p[p < 1e-12], p[p > 1 - 1e-12] = 0.0, 1.0
    live = np.flatnonzero((p > 0) & (p < 1)).tolist()
    hold: list[int] = []
    draws, at = rng.random(len(live) + 1), 0
    for i in live:
        hold.append(i)
        if len(hold) < 3:
            continue
        a, b, c = hold
        sa, sb, sc = size[a], size[b], size[c]
        u = (sb - sc, sc - sa, sa - sb)
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, v in zip(hold, u):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if draws[at] < down / (up + down) else -down
        at += 1
        for k, v in zip(hold, u):
            p[k] += step * v
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        hold = [k for k in hold if 0 < p[k] < 1]
        while len(hold) > 2:  # a zero component kept all three fractional
            hold.pop(0)
    return p


def outcomes(p: np.ndarray) -> list[tuple[float, tuple[float, ...]]]:
    """(probability, values) of a rounding of one or two units that keeps their probabilities and, as nearly as can be, their sum."""
    if len(p) == 1:
        return [(p[0], (1.0,)), (1 - p[0], (0.0,))]
    a, b = p
    over = max(0.0, a + b - 1)
    return [(q, v) for q, v in ((over, (1.0, 1.0)), (a - over, (1.0, 0.0)), (b - over, (0.0, 1.0)), (1 - a - b + over, (0.0, 0.0))) if q > 0]


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, mass: float = 0.0, up: float = 0.0) -> tuple[np.ndarray, float]:
    """The last units of a source, made whole with their inclusion probabilities and a total close to what these sum to; and what is owed.

    mass: the expected total of units that come later, whose probabilities may be scaled by up to 1 + up. What these are to
    make good is given back as owed (too much is positive).

    Units are taken by classes of size (powers of 2), the largest first: a flight leaves two units at most, which are rounded at
    random. What that puts the total off is owed by the smaller units, whose probabilities are scaled to make it good. Before
    the draw it is known how far off each outcome is, and the part that is owed is chosen so that no outcome takes a
    probability past 0 or 1: as the error has the expectation 0, so has that part, and every unit keeps its probability over all
    draws. In the end the total is off by about the smallest units that are enough to make good what larger ones left.
    """
    p, out, owed = p.astype(float), np.where((p > 0) & (p < 1), 0.0, p), 0.0
    live = np.flatnonzero((p > 0) & (p < 1))
    kind = np.floor(np.log2(np.maximum(size, 1))).astype(int)
    for k in sorted(set(kind[live].tolist()), reverse=True):
        own, rest = live[kind[live] == k], live[kind[live] < k]
        mine, less = float((p[own] * size[own]).sum()), float((p[rest] * size[rest]).sum()) + mass
        q = flight(p[own] * (1 - owed / (mine + less)), size[own], rng)
        owed *= less / (mine + less)
        left = np.flatnonzero((q > 0) & (q < 1))
        if len(left):
            every = outcomes(q[left])
            off = [float(((np.array(v) - q[left]) * size[own][left]).sum()) for _, v in every]
            # Room to scale the smaller units: down to 0, up until the first of them is certain.
            room = less, less * min([*((1 - p[rest]) / p[rest]), *([up] if mass > 0 else [])], default=0.0)
            part = min([1.0, *(max(0.0, ((room[0] - owed) if x > 0 else (room[1] + owed)) / abs(x)) for x in off if x)])
            at = int(np.searchsorted(np.cumsum([w for w, _ in every])[:-1], rng.random(), "right"))
            q[left] = every[at][1]
            owed += part * off[at]
        out[own] = q
    return out, owed


def mixture(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = DEFAULT, block: int = 5_000, held: int = 500, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, n_used): how often each document is used, so that sources reach their shares of all tokens.

    The mixture is as large as the plan allows: the total T is the least of max_repeats x tokens / target_share over the
    sources. A document of a source is used floor(f) times, f = share x T / tokens of the source, and once more with
    probability f - floor(f) <= 1, balanced by the cube method on tokens and documents. Flights run in blocks of about `block`
    documents, and what each leaves (at most two) joins the next round; some documents of a source, chosen by hash, stay out
    of the blocks and make with the last of these the landing, of at most about a block. The large documents of a source, at
    most half a block, are drawn before all others, which make good what these put the total off. Probabilities are kept throughout, and
    f <= max_repeats bounds the use of every document. Documents of sources without a plan, with a null source, and without
    tokens aren't used. A planned source without tokens has no part in the mixture: the others keep their shares in proportion.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("doc_id is not null")
    known = plan.filter("target_share > 0").groupBy("source").agg(F.first("target_share").alias("share"), F.first("max_repeats").alias("most"))  # one row a source
    d = stage(with_tokens(d.join(F.broadcast(known.select("source")), "source", "left_semi"), "text", path).filter("n_tokens > 0"))
    spark = d.sparkSession
    stats = {r["source"]: r for r in d.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("top")).collect()}  # one row a source
    rows = [r for r in known.collect() if r["source"] in stats]
    if not rows:
        return d.select("doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("n_used")).limit(0)
    total = min(r["most"] * stats[r["source"]]["t"] / r["share"] for r in rows)
    f = {r["source"]: min(float(r["most"]), r["share"] * total / stats[r["source"]]["t"]) for r in rows}
    whole = {s: int(x + 1e-12) for s, x in f.items()}
    # Documents of over 2 / block of a source's tokens, of which there are at most block / 2, are drawn first. Held out by hash
    # are `held` others, or so many that they outweigh the largest of the rest 20 times, but no more than a block.
    edge = {s: min(float(v["top"]), 2 * v["t"] / block) for s, v in stats.items()}
    part = {s: min(max(held / v["n"], 20 * edge[s] / v["t"]), block / v["n"], 1.0) for s, v in stats.items()}
    plan_f = spark.createDataFrame([(s, whole[s], max(0.0, f[s] - whole[s]), int(part[s] * 1_000_000), edge[s], -(-stats[s]["n"] // block)) for s in f], "source string, whole long, p double, apart long, edge double, blocks long")
    d = d.join(F.broadcast(plan_f), "source")
    schema = "source string, doc_id long, n_tokens long, p double"

    def fly(last: bool):
        def run(key, g):
            import pandas as pd

            g = g.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
            size, rng = g["n_tokens"].to_numpy(float), np.random.default_rng([seed, int(key[1]), int(g["doc_id"].iloc[0])])
            p = landing(g["p"].to_numpy(), size, rng)[0] if last else flight(g["p"].to_numpy(), size, rng)
            return pd.DataFrame({"source": g["source"], "doc_id": g["doc_id"], "n_tokens": g["n_tokens"], "p": p})

        return run

    hashed = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), n)
    todo = d.filter("p > 0 and p < 1").select("source", "doc_id", "n_tokens", "p", "apart", "edge", "blocks")
    got = spark.createDataFrame([], schema)
    large = stage(todo.filter(F.col("n_tokens") > F.col("edge")).select(*_FLOWN))
    big = {r["source"]: r["t"] for r in large.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a source
    if big:
        rest = {s: (f[s] - whole[s]) * (stats[s]["t"] - t) for s, t in big.items()}
        ups = {s: (1 - (f[s] - whole[s])) / (f[s] - whole[s]) for s in big}

        def first(key, g):
            import pandas as pd

            g = g.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
            p, owed = landing(g["p"].to_numpy(), g["n_tokens"].to_numpy(float), np.random.default_rng([seed, 0]), rest[key[0]], ups[key[0]])
            return pd.DataFrame({"source": g["source"], "doc_id": g["doc_id"], "n_tokens": g["n_tokens"], "p": p, "owed": owed})

        drawn = stage(large.groupBy("source").applyInPandas(first, schema + ", owed double"))
        scale = [(r["source"], 1 - r["owed"] / rest[r["source"]] if rest[r["source"]] else 1.0) for r in drawn.groupBy("source").agg(F.max("owed").alias("owed")).collect()]  # one row a source
        got = got.union(drawn.filter("p = 1").select(*_FLOWN))
        todo = todo.filter(F.col("n_tokens") <= F.col("edge")).join(F.broadcast(spark.createDataFrame(scale, "source string, scale double")), "source", "left")
        todo = todo.withColumn("p", F.least(F.lit(1.0), F.col("p") * F.coalesce("scale", F.lit(1.0)))).select("source", "doc_id", "n_tokens", "p", "apart", "edge", "blocks")
        got = got.union(todo.filter("p = 1").select(*_FLOWN))
        todo = todo.filter("p > 0 and p < 1")
    apart = (F.col("blocks") == 1) | (hashed(F.lit(1_000_000), 1) < F.col("apart"))
    last = todo.filter(apart).select(*_FLOWN)
    blocks = max(-(-v["n"] // block) for v in stats.values())
    if blocks > 1:
        todo = todo.filter(~apart).withColumn("blk", hashed(F.col("blocks"), 2)).drop("apart", "edge", "blocks")
        while True:
            flown = stage(todo.groupBy("source", "blk").applyInPandas(fly(False), schema))
            got, left = got.union(flown.filter("p = 1")), flown.filter("p > 0 and p < 1")
            if 2 * blocks <= block:  # at most two of each block are left
                break
            blocks = -(-2 * blocks // block)
            todo = left.withColumn("blk", hashed(F.lit(blocks), 3 + blocks))
        last = last.union(left)
    end = last.withColumn("blk", F.lit(0)).groupBy("source", "blk").applyInPandas(fly(True), schema)
    chosen = got.union(end).filter("p = 1").select("doc_id", F.lit(1).cast("long").alias("more"))
    return d.join(chosen, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("n_used")).filter("n_used > 0")


_FLOWN = ("source", "doc_id", "n_tokens", "p")


def shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_tokens, most_used) of a mixture."""
    s = cut(mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_used")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("n_used").alias("most_used")))
    total = s.agg(F.sum("n_tokens")).first()[0] or 1
    return s.join(plan.select("source", "target_share"), "source").select("source", "target_share", F.round(F.col("n_tokens") / total, 6).alias("actual_share"), "n_docs", "n_tokens", "most_used")
