"""From traceroute hops to anycast sites."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.functions.net import is_bogon, is_ipv4, subnet
from webobs.operators.graph import components


def least_rtt(hops: DataFrame, trace: str = "trace_id") -> DataFrame:
    """(trace, ip, rtt, hop_index): each address of a trace once, least rtt, first hop. Silent hops are left out."""
    return hops.filter("ip is not null and rtt is not null").groupBy(trace, "ip").agg(F.min("rtt").alias("rtt"), F.min("hop_index").alias("hop_index"))


def usable_traces(hops: DataFrame, most: int = 64) -> DataFrame:
    """(trace_id): successful traces with hops up to `most` and only valid addresses."""
    bad = F.max((F.col("ip").isNotNull() & ~is_ipv4(F.col("ip"))).cast("int"))
    return hops.groupBy("trace_id").agg(F.max("hop_index").alias("top"), F.min(F.col("is_successful").cast("int")).alias("ok"), bad.alias("bad")).filter((F.col("top") <= most) & (F.col("ok") == 1) & (F.col("bad") == 0)).select("trace_id")


def second_last(hops: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the second-highest hop index of each key (which may have several rows); keys with one index have none.

    One shuffle by key; the rows of a trace are few (hops are at most some dozens).
    """
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("hop_index")))
    return hops.withColumn("__r", rank).filter("__r = 2").drop("__r")


def greedy_sites(sets: list[tuple[int, set]]) -> list[tuple[int, int]]:
    """(vantage, site): in order, each joins the first site whose founding set meets its set, else founds one; founding sets never grow."""
    sites: list[set] = []
    out = []
    for v, s in sets:
        k = next((i for i, f in enumerate(sites) if f & s), None)
        if k is None:
            k = len(sites)
            sites.append(s)
        out.append((v, k))
    return out


def site_groups(ends: DataFrame, dest: str, vantage: str, net: str) -> DataFrame:
    """(dest, vantage, site): greedy_sites per destination; a site is named by its founding vantage.

    Vantages in different components of the (vantage, network) graph of a destination never meet, so the ordered pass runs
    per component and no task needs a whole destination. A vantage without any network meets no other and is a site of its own.
    """
    e = ends.select(dest, vantage, net).filter(F.col(net).isNotNull()).distinct()
    lone = ends.groupBy(dest, vantage).agg(F.count(net).alias("__n")).filter("__n = 0").select(dest, vantage, F.col(vantage).alias("site"))
    e = e.withColumn("__v", F.xxhash64(F.lit("v"), dest, vantage)).withColumn("__n", F.xxhash64(F.lit("n"), dest, net))
    comp = components(e.select(F.col("__v").alias("a"), F.col("__n").alias("b")))
    kinds = dict(ends.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        order = sorted((v, set(x[net])) for v, x in g.groupby(vantage))
        got = greedy_sites(order)
        first: dict[int, int] = {}
        for v, k in got:
            first.setdefault(k, v)
        return pd.DataFrame({dest: g[dest].iloc[0], vantage: [v for v, _ in got], "site": [first[k] for _, k in got]})

    return e.join(comp.select(F.col("id").alias("__v"), "comp"), "__v").groupBy("comp").applyInPandas(run, f"{dest} {kinds[dest]}, {vantage} {kinds[vantage]}, site {kinds[vantage]}").union(lone)


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, w = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(w / 2) ** 2)))


def greedy_places(points: list[tuple], km: float = 100.0) -> list[int]:
    """Cluster numbers of (lat, lon, ...) points: in order, each joins the first cluster with any member within km, else founds one."""
    clusters: list[list[tuple]] = []
    out = []
    for p in points:
        k = next((i for i, c in enumerate(clusters) if any(_km(p, m) <= km for m in c)), None)
        if k is None:
            k = len(clusters)
            clusters.append([])
        clusters[k].append(p)
        out.append(k)
    return out


def place_of(points: list[tuple], km: float = 100.0) -> tuple:
    """Of (lat, lon, rtt, id[, vantages]) points: the one with the least rtt in the cluster of most vantages (the first of equals)."""
    if len(points) == 1:
        return points[0]
    k = greedy_places(points, km)
    size = dict.fromkeys(k, 0)
    for p, c in zip(points, k):
        size[c] += p[4] if len(p) > 4 else 1
    best = max(size, key=lambda c: (size[c], -c))
    return min((p for p, c in zip(points, k) if c == best), key=lambda p: (p[2], p[3]))


def located_sites(groups: DataFrame, vantages: DataFrame, dest: str, near_ms: float = 3.0) -> DataFrame:
    """(dest, site, n_vantages, near_id, lat, lon): where a site lies, by vantages within near_ms of it (J08 on these).

    groups: (dest, vantage, site, rtt); vantages: (vantage, lat, lon). Only vantages within near_ms decide. Those of equal
    coordinates are one point, which has their number, the place of their first in the order and their least rtt.
    """
    g = groups.join(vantages, "vantage").filter("rtt <= {} and lat is not null and lon is not null".format(near_ms))
    point = g.groupBy(dest, "site", "lat", "lon").agg(F.min(F.struct("rtt", "vantage")).alias("m"), F.min("vantage").alias("first"), F.count("*").alias("c"))
    kinds = dict(groups.dtypes)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("first")
        p = place_of([(y, z, m["rtt"], m["vantage"], c) for y, z, m, c in zip(x["lat"], x["lon"], x["m"], x["c"])])
        return pd.DataFrame({dest: [x[dest].iloc[0]], "site": [x["site"].iloc[0]], "n_vantages": [int(x["c"].sum())], "near_id": [p[3]], "lat": [p[0]], "lon": [p[1]]})

    return point.groupBy(dest, "site").applyInPandas(run, f"{dest} {kinds[dest]}, site {kinds['site']}, n_vantages long, near_id {kinds['vantage']}, lat double, lon double")


def hostnames(hops: DataFrame) -> DataFrame:
    """(ip, hostname, vantages): the inverted index of names, bogons left out."""
    h = hops.filter(F.col("ip").isNotNull() & F.col("hostname").isNotNull() & ~is_bogon(F.col("ip")))
    return h.groupBy("ip", "hostname").agg(F.count_distinct("loc_id").alias("vantages"))


def destination_names(hops: DataFrame, target: str = "target_host") -> DataFrame:
    """(dest_ip, hosts): the sorted names under which each destination address was reached."""
    return hops.filter(F.col("dest_ip").isNotNull() & F.col(target).isNotNull()).groupBy("dest_ip").agg(F.array_sort(F.collect_set(target)).alias("hosts"))


def reached(hops: DataFrame) -> DataFrame:
    """(dest_ip, loc_id, rtt): the least round trip of each vantage to a destination that answered; no answer, no row."""
    return hops.filter("ip = dest_ip and rtt is not null").groupBy("dest_ip", "loc_id").agg(F.min("rtt").alias("rtt"))


def end_networks(hops: DataFrame, prefix: int) -> DataFrame:
    """(dest_ip, loc_id, net): networks of the second-last answering hops of each trace whose destination answered.

    The destination itself is no such network; a vantage whose traces have no other end hop has one row with a null net.
    """
    h = least_rtt(hops.filter("dest_ip is not null"), "trace_id").join(hops.groupBy("trace_id").agg(F.min("loc_id").alias("loc_id"), F.min("dest_ip").alias("dest_ip")), "trace_id")
    h = h.join(h.filter("ip = dest_ip").select("trace_id"), "trace_id", "left_semi")
    ends = second_last(h, ["trace_id"]).filter("ip <> dest_ip").select("trace_id", subnet(F.col("ip"), prefix).alias("net"))
    return h.select("trace_id", "dest_ip", "loc_id").distinct().join(ends, "trace_id", "left").select("dest_ip", "loc_id", "net").distinct()


def geolocated(groups: DataFrame, rtts: DataFrame, vantages: DataFrame, sites: DataFrame, candidates: DataFrame, near_ms: float = 3.0) -> DataFrame:
    """(dest_ip, site, site_id, how, votes): the replica site where each group of vantages of a destination lies.

    groups: (dest_ip, loc_id, site); rtts: (dest_ip, loc_id, rtt); vantages: (vantage, lat, lon); candidates: (dest_ip, loc_id,
    site_id). With vantages within near_ms of the destination it is the replica nearest to the deciding one (located_sites;
    'near', votes = their number); else the replica that most vantages' traces allow, the smallest of equals ('votes').
    Groups with neither have no row.
    """
    from webobs.operators.geo import nearest

    g = groups.join(rtts, ["dest_ip", "loc_id"]).select("dest_ip", F.col("loc_id").alias("vantage"), "site", "rtt")
    at = located_sites(g, vantages, "dest_ip")
    near = nearest(at, ["dest_ip", "site", "n_vantages"], sites, "site_id", "lat", "lon").select("dest_ip", "site", "site_id", F.lit("near").alias("how"), F.col("n_vantages").alias("votes"))
    v = groups.join(candidates, ["dest_ip", "loc_id"]).groupBy("dest_ip", "site", "site_id").agg(F.count("*").alias("votes"))
    v = v.groupBy("dest_ip", "site").agg(F.max_by(F.struct("site_id", "votes"), F.struct(F.col("votes"), -F.col("site_id"))).alias("m")).select("dest_ip", "site", "m.site_id", F.lit("votes").alias("how"), "m.votes")
    return near.union(v.join(near.select("dest_ip", "site"), ["dest_ip", "site"], "left_anti"))
