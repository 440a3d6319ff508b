"""Points near points, and regions that contain points (problem 4), by a trapezoidal decomposition into slabs.

The plane of longitude and latitude is cut into horizontal slabs. The boundary of a region inside a slab is a left and a
right edge; edges are ordered by longitude, and a point is located by binary search among the edges of its slab. Slabs are
distributed as tiles (slab, cell of longitude); a tile with more rows than `block` is split into blocks of edges and points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def valid_point(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Both coordinates present, in range (so not NaN), and not both 0."""
    y, x = F.col(lat), F.col(lon)
    return y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x) & y.between(-90, 90) & x.between(-180, 180) & ~((y == 0) & (x == 0))


def _sweep(km: float, radius: float):
    """Locates points among edges. Rows come sorted by tile; edges of a tile are kept until the tile ends."""

    def near(ed: dict, pt: dict) -> pa.RecordBatch | None:
        order = np.lexsort((ed["left"], ed["tile"]))
        ed = {k: v[order] for k, v in ed.items()}
        # One sorted axis for all tiles: the rank of the tile times a span wider than any longitude.
        tiles, span = np.unique(ed["tile"]), 2000.0
        rank = np.searchsorted(tiles, pt["tile"])
        hit = (rank < len(tiles)) & (tiles[np.minimum(rank, len(tiles) - 1)] == pt["tile"])
        pt, rank = {k: v[hit] for k, v in pt.items()}, rank[hit]
        if not len(rank):
            return None
        e_rank = np.searchsorted(tiles, ed["tile"])
        axis = e_rank * span + ed["left"]
        widest = np.zeros(len(tiles))
        np.maximum.at(widest, e_rank, ed["right"] - ed["left"])
        hi = np.searchsorted(axis, rank * span + pt["lon"] + 1e-5, "right")
        lo = np.searchsorted(axis, rank * span + pt["lon"] - widest[rank] - 1e-5, "left")
        out_a, out_b, at = [], [], 0
        n = hi - lo
        ends = np.cumsum(n)
        while at < len(n):  # in blocks, so that a dense tile needs no large arrays
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
            m = n[at:to]
            p = np.repeat(np.arange(at, to), m)
            e = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:to], m)
            la, lb = np.radians(ed["lat"][e]), np.radians(pt["lat"][p])
            h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(pt["lon"][p] - ed["lon"][e]) / 2) ** 2
            ok = 2 * radius * np.arcsin(np.minimum(1, np.sqrt(h))) <= km
            up = (pt["lat"][p] > ed["lat"][e]) | ((pt["lat"][p] == ed["lat"][e]) & (pt["id"][p] > ed["id"][e]))
            ok &= up
            out_a.append(ed["id"][e[ok]])
            out_b.append(pt["id"][p[ok]])
            at = to
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        names = ("tile", "edge", "id", "lat", "lon", "left", "right")

        def flush(x: dict) -> Iterator[pa.RecordBatch]:
            # Edges are searched by classes of width (powers of 2), so a disk near a pole doesn't widen the search of others.
            e = x["edge"].astype(bool)
            pt = {k: v[~e] for k, v in x.items()}
            kind = np.floor(np.log2(np.maximum(x["right"] - x["left"], 1e-9)))
            for c in np.unique(kind[e]) if len(pt["tile"]) else ():
                own = e & (kind == c)
                if (r := near({k: v[own] for k, v in x.items()}, pt)) is not None:
                    yield r

        for b in batches:
            if not b.num_rows:
                continue
            held.append({k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)})
            if held[0]["tile"][0] == held[-1]["tile"][-1]:
                continue  # still the first tile
            x = {k: np.concatenate([h[k] for h in held]) for k in names}
            done = np.searchsorted(x["tile"], x["tile"][-1], "left")
            yield from flush({k: v[:done] for k, v in x.items()})
            held = [{k: v[done:] for k, v in x.items()}]
        if held:
            yield from flush({k: np.concatenate([h[k] for h in held]) for k in names})

    return run


def near_classes(points: DataFrame, km: float, block: int = 20_000, radius: float = EARTH_KM) -> DataFrame:
    """(a, b): pairs of rows of points (id, lat, lon; distinct places) at most km apart, each pair once in one order.

    Each point's disk is a region. Its upper half (places further north) is put as an edge into the tiles it covers, at
    most two slabs, and each point is located in its own tile. Longitudes wrap at 180 degrees; a disk that holds a pole
    covers its slabs whole. A tile that holds more than `block` edges and points is split into equal blocks by hash, and
    every block of edges meets every block of points of that tile, so a hot tile is no single task.
    """
    ang = km / radius
    deg = max(math.degrees(ang), 1e-7)
    h = max(2 * deg * 1.0001, 180.0 / 2_000_000_000)
    slab_of = lambda y: F.floor((y + 90) / h).cast("long")

    def cells(slab: Column) -> Column:
        """Cells of a slab: as wide as the widest disk that can touch it, at least."""
        far = F.least(F.lit(90.0), F.greatest(F.abs(slab * h - 90), F.abs((slab + 1) * h - 90)) + deg)
        c = F.cos(F.radians(far))
        w = F.when((far >= 90 - 1e-9) | (c <= math.sin(ang)), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(ang) / c))))
        return F.greatest(F.lit(1), F.floor(360 / (2 * w * 1.0001)).cast("long"))

    cell_of = lambda x, n: F.pmod(F.floor((x + 180) / 360 * n).cast("long"), n)
    p = points.select("id", "lat", "lon")
    own = p.withColumn("slab", slab_of(F.col("lat"))).withColumn("n", cells(F.col("slab"))).withColumn("cell", cell_of(F.col("lon"), F.col("n")))
    own = own.select("slab", "cell", F.lit(0).alias("edge"), "id", "lat", "lon", "lon", "lon").toDF("slab", "cell", "edge", "id", "lat", "lon", "left", "right")
    c = F.cos(F.radians(F.col("lat")))
    # The half-width of the disk in degrees of longitude; the margin covers rounding.
    wide = F.when((F.abs(F.col("lat")) + deg >= 90 - 1e-9) | (c <= math.sin(ang)), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(ang) / c))) * 1.000001 + 1e-9)
    e = p.withColumn("w", wide).withColumn("slab", F.explode(F.sequence(slab_of(F.col("lat")), slab_of(F.least(F.lit(90.0), F.col("lat") + deg * 1.000001)))))
    e = e.withColumn("n", cells(F.col("slab")))
    first, last = F.floor((F.col("lon") - F.col("w") + 180) / 360 * F.col("n")).cast("long"), F.floor((F.col("lon") + F.col("w") + 180) / 360 * F.col("n")).cast("long")
    e = e.withColumn("cell", F.explode(F.when(last - first + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.col("n"))))))
    # An edge is seen from its cell: shifted by a turn where it crosses 180 degrees.
    e = e.withColumn("turn", F.when(F.col("lon") - F.col("w") < -180, F.array(F.lit(0.0), F.lit(360.0))).when(F.col("lon") + F.col("w") > 180, F.array(F.lit(-360.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0)))).withColumn("turn", F.explode("turn"))
    e = e.select("slab", "cell", F.lit(1).alias("edge"), "id", "lat", "lon", (F.col("lon") - F.col("w") + F.col("turn")).alias("left"), (F.col("lon") + F.col("w") + F.col("turn")).alias("right"))
    rows = own.union(e)
    hot = rows.groupBy("slab", "cell").count().filter(F.col("count") > block).select("slab", "cell", F.ceil(F.col("count") / block).cast("int").alias("k"))
    rows = rows.join(hot, ["slab", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("k"))
    every = F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)
    rows = rows.withColumn("blk", F.explode(F.when(F.col("edge") == 1, F.transform(every, lambda j: mine * F.col("k") + j)).otherwise(F.transform(every, lambda j: j * F.col("k") + mine))))
    rows = rows.withColumn("tile", F.xxhash64("slab", "cell", "blk"))
    got = rows.select("tile", "edge", "id", "lat", "lon", "left", "right").repartition("tile").sortWithinPartitions("tile")
    # A disk whose edge was shifted may meet a point twice.
    return got.mapInArrow(_sweep(km, radius), "a long, b long").distinct()


def pairs_within(members: DataFrame, group: str, id_col: str, block: int = 4_000) -> DataFrame:
    """(a, b), a < b: all pairs of ids of one group, for results that are pairs by definition.

    A group of more than `block` ids is cut into k blocks of ids, and the pairs of each two blocks are made apart, so no
    task holds a whole hot group.
    """
    m = members.select(F.col(group).alias("g"), F.col(id_col).alias("id"))
    n = m.groupBy("g").count().filter("count > 1").select("g", F.ceil(F.col("count") / block).cast("int").alias("k"))
    m = m.join(n, "g").withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    left = m.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", F.col("s").alias("x"), F.col("t").alias("y"), F.col("id").alias("a"))
    right = m.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", F.col("t").alias("x"), F.col("s").alias("y"), F.col("id").alias("b"))
    return left.join(right, ["g", "x", "y"]).filter("a < b").select("a", "b")


def pairs_across(links: DataFrame, members: DataFrame, group: str, id_col: str, block: int = 4_000) -> DataFrame:
    """(a, b), a < b: for each link (a, b) of groups, all pairs of an id of one and an id of the other.

    Groups of more than `block` ids are cut into blocks, and each two blocks of linked groups meet in rows of their own, so
    two linked hot groups are no single task.
    """
    m = members.select(F.col(group).alias("g"), F.col(id_col).alias("id"))
    n = m.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    m = m.join(n, "g").select("g", "id", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("s"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    l = links.select("a", "b").join(n.toDF("a", "ka"), "a").join(n.toDF("b", "kb"), "b")
    l = l.withColumn("sa", every("ka")).withColumn("sb", every("kb")).select("a", "b", "sa", "sb")
    got = l.join(m.toDF("a", "x", "sa"), ["a", "sa"]).join(m.toDF("b", "y", "sb"), ["b", "sb"])
    return got.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_pairs(df: DataFrame, id_col: str, lat: str = "latitude", lon: str = "longitude", km: float = 5.0, block: int = 20_000) -> DataFrame:
    """(a, b), a < b: pairs of rows at most km apart on the sphere; equal points count.

    Rows without a usable point (see valid_point) are left out. Equal points are searched once: places are found by an
    aggregate, near places by near_classes, and rows are joined to them at the end.
    """
    rows = df.filter(valid_point(lat, lon)).select(F.col(id_col).cast("long").alias("id"), (F.col(lat) + 0.0).alias("lat"), F.when(F.col(lon) == 180, -180.0).otherwise(F.col(lon) + 0.0).alias("lon"))
    places = rows.groupBy("lat", "lon").agg(F.min("id").alias("place"))
    member = rows.join(places, ["lat", "lon"]).select("place", "id")
    near = near_classes(places.select(F.col("place").alias("id"), "lat", "lon"), km, block)
    return pairs_within(member, "place", "id").union(pairs_across(near, member, "place", "id"))


def locate_in_regions(points: DataFrame, id_col: str, regions: DataFrame, region_col: str, ring_col: str, lat: str = "latitude", lon: str = "longitude", slab: float = 1.0, block: int = 50_000) -> DataFrame:
    """(point id, region): regions whose polygon holds the point.

    regions has one row per polygon with ring_col: array<struct<lat, lon>>, a simple ring in degrees; one that crosses 180
    degrees goes on beyond it (181 for -179), and points meet it at their longitude and at that a turn east and west. Points on an edge count as inside for lower and left edges only. Every boundary edge is cut at slab borders;
    a point meets the edges of its slab, ordered by longitude, and lies inside where an odd number of edges of the
    region lies left of it. Rings of under three corners hold nothing.
    """
    i = F.col("i")
    ring = F.col(ring_col)
    edges = regions.filter(F.size(ring) >= 3).select(F.col(region_col).alias("region"), ring.alias("ring"), F.posexplode(ring).alias("i", "a"))
    edges = edges.select("region", "a", F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1).alias("b")).select(
        "region",
        *(F.when(F.col("a.lat") <= F.col("b.lat"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"{c}0") for c in ("lat", "lon")),
        *(F.when(F.col("a.lat") <= F.col("b.lat"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(f"{c}1") for c in ("lat", "lon")),
    ).filter("lat0 < lat1")
    edges = edges.withColumn("slab", F.explode(F.sequence(F.floor(F.col("lat0") / slab), F.floor(F.col("lat1") / slab))))
    # Points get a turn more or less only where rings lie beyond 180 degrees; -180 and 180 are one meridian, so rings that touch it count.
    far = edges.agg(F.min(F.least("lon0", "lon1")), F.max(F.greatest("lon0", "lon1"))).first()
    low, high = (far[0], far[1]) if far[0] is not None else (0.0, 0.0)
    x = F.col(lon)
    turns = F.filter(F.array(x, x - 360, x + 360), lambda v: (v == x) | v.between(low, high))
    pts = points.filter(valid_point(lat, lon)).select(F.col(id_col).alias("id"), F.col(lat).alias("y"), F.explode(turns).alias("x")).withColumn("slab", F.floor(F.col("y") / slab))

    def inside(key, ed, pt):
        import pandas as pd

        ids, regs = [], []
        y, x = pt["y"].to_numpy(), pt["x"].to_numpy()
        for region, g in ed.groupby("region", sort=True):
            ys = np.unique(np.r_[g["lat0"], g["lat1"]])  # sub-slabs: no edge ends inside one, so edges keep their order
            band = np.searchsorted(ys, y, "right") - 1
            for k in np.unique(band[(band >= 0) & (band < len(ys) - 1)]):
                mid, pk = (ys[k] + ys[k + 1]) / 2, np.flatnonzero(band == k)
                e = g[(g["lat0"] <= ys[k]) & (g["lat1"] >= ys[k + 1])]
                slope = (e["lon1"] - e["lon0"]) / (e["lat1"] - e["lat0"])
                e = e.assign(s=slope, m=e["lon0"] + slope * (mid - e["lat0"])).sort_values("m")
                lo, hi = np.zeros(len(pk), int), np.full(len(pk), len(e))
                a, s, y0 = e["lon0"].to_numpy(), e["s"].to_numpy(), e["lat0"].to_numpy()
                while (lo < hi).any():  # binary search for all points of the band at once
                    j = (lo + hi) // 2
                    jj = np.minimum(j, len(e) - 1)
                    left = a[jj] + s[jj] * (y[pk] - y0[jj]) <= x[pk]
                    lo, hi = np.where((lo < hi) & left, j + 1, lo), np.where((lo < hi) & ~left, j, hi)
                odd = pk[lo % 2 == 1]
                ids.append(pt["id"].to_numpy()[odd])
                regs.append(np.full(len(odd), region))
        return pd.DataFrame({"id": np.concatenate(ids) if ids else [], "region": np.concatenate(regs) if regs else []})

    # A slab's points and regions are cut into blocks by hash, as many as their counts ask for; each two blocks meet once.
    n = pts.groupBy("slab").agg(F.ceil(F.count("*") / block).cast("long").alias("kp"))
    n = n.join(edges.groupBy("slab").agg(F.ceil(F.count("*") / block).cast("long").alias("ke")), "slab")
    of = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    pts = pts.join(n, "slab").select("id", "y", "x", "slab", of("id", "kp").alias("bp"), every("ke").alias("be"))
    edges = edges.join(n, "slab").select("region", "lat0", "lon0", "lat1", "lon1", "slab", of("region", "ke").alias("be"), every("kp").alias("bp"))
    kinds = dict(pts.dtypes) | dict(edges.dtypes)
    got = edges.groupBy("slab", "bp", "be").cogroup(pts.groupBy("slab", "bp", "be")).applyInPandas(inside, f"id {kinds['id']}, region {kinds['region']}")
    return got.distinct() if low <= -180 or high >= 180 else got  # a point may meet a ring at two of its longitudes
