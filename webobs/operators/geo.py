"""Vantage points, replica sites and places. Site tables go to the tasks in blocks of bounded size; points are never joined with all sites."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.operators.near import EARTH_KM, haversine
from webobs.runtime import cut

KM_PER_MS = 100.0


BLOCK = 50_000  # sites that go to every task at once


def _site_blocks(sites: DataFrame, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The stated site table, collected in blocks of about BLOCK rows: a column each. Sites without coordinates are left out."""
    s = sites.select(*columns).filter(F.col("s_lat").isNotNull() & F.col("s_lon").isNotNull())
    blocks = max(1, -(-s.count() // BLOCK))
    for k in range(blocks):
        rows = (s if blocks == 1 else s.filter(F.pmod(F.xxhash64(*columns), F.lit(blocks)) == k)).collect()
        yield [np.array([r[i] for r in rows]) for i in range(len(columns))]


def _distances(lat: np.ndarray, lon: np.ndarray, s_lat: np.ndarray, s_lon: np.ndarray) -> np.ndarray:
    """Great-circle distances (km), points x sites."""
    p, q = np.radians(lat)[:, None], np.radians(s_lat)[None, :]
    a = np.sin(np.radians(s_lat[None, :] - lat[:, None]) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(s_lon[None, :] - lon[:, None]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _each_site(points: DataFrame, keys: list[str], sites: DataFrame, site: str, lat: str, lon: str, value: Column, pick: Callable, extra: str, scope: tuple[Column, str] | None = None) -> DataFrame:
    """pick(distances, values, site ids, point scopes, site scopes) -> (point, site id, further columns) over slices of points, in the tasks.

    The site table is read by every task as arrays, at most BLOCK rows at a time; points are neither joined nor shuffled.
    Points without coordinates are left out.
    """
    kinds, skind = dict(points.dtypes), dict(sites.dtypes)[site]
    arrow = sites.sparkSession.createDataFrame([], sites.select(site).schema).toArrow().schema.field(0).type
    p = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*keys, F.col(lat).cast("double").alias("__y"), F.col(lon).cast("double").alias("__x"), value.cast("double").alias("__v"), (scope[0] if scope else F.lit("")).alias("__s"))
    n = len(keys)

    def over(sid, s_lat, s_lon, s_scope):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, 1_000_000 // max(1, len(sid)))  # bounds the matrix
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    c = b.slice(lo, step)
                    y, x, v = (c.column(n + i).to_numpy(zero_copy_only=False) for i in range(3))
                    at, which, more = pick(_distances(y, x, s_lat, s_lon), v, sid, np.array(c.column(n + 3).to_pylist(), object), s_scope)
                    yield pa.RecordBatch.from_arrays([*(c.column(i).take(pa.array(at)) for i in range(n)), pa.array(sid[which].tolist(), arrow), *map(pa.array, more)], [*keys, site, *(z.split()[0] for z in extra.split(", "))])

        return run

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{site}` {skind}", extra])
    columns = [site, "s_lat", "s_lon", *([scope[1]] if scope else [])]
    parts = [p.mapInArrow(over(sid, s_lat.astype(float), s_lon.astype(float), rest[0] if rest else None), schema) for sid, s_lat, s_lon, *rest in _site_blocks(sites, columns)]
    return reduce(DataFrame.union, parts)


def top_sites(points: DataFrame, keys: list[str], sites: DataFrame, site: str, k: int = 1, lat: str = "latitude", lon: str = "longitude", target: Column | None = None, scope: tuple[Column, str] | None = None) -> DataFrame:
    """(keys, site, dist, rank): for each point the k sites with the least round(|distance - target|, 6) (target 0: the nearest), ties by site.

    scope: (column of points, column of sites) that must be equal; null equals nothing. A row of points stands for itself, so
    keys should name it.
    """

    def pick(d, v, sid, ps, ss):
        d = np.round(np.abs(d - v[:, None]), 6)
        if ss is not None:
            d[~np.array(ps[:, None] == ss[None, :], bool) | np.array([x is None for x in ps], bool)[:, None]] = np.inf
        m = min(k, d.shape[1])
        if not m:
            return np.zeros(0, int), np.zeros(0, int), [np.zeros(0)]
        # All that tie with the k-th are ordered by site before the k are taken.
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        at, which = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        o = np.lexsort((sid[which], d[at, which], at))
        at, which = at[o], which[o]
        first = np.searchsorted(at, at, "left")
        keep = np.arange(len(at)) - first < k
        return at[keep], which[keep], [d[at[keep], which[keep]]]

    got = _each_site(points, keys, sites, site, lat, lon, F.lit(0.0) if target is None else target, pick, "dist double", scope)
    w = Window.partitionBy(*keys).orderBy("dist", site)  # at most k sites of each block for a point
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sites_within(points: DataFrame, keys: list[str], sites: DataFrame, site: str, reach: Column, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(keys, site, dist): the sites at most `reach` km from each point; a null reach is none."""

    def pick(d, v, sid, ps, ss):
        at, which = np.nonzero(d <= np.where(np.isnan(v), -1.0, v)[:, None])
        return at, which, [d[at, which]]

    return _each_site(points, keys, sites, site, lat, lon, reach, pick, "dist double")


def nearest(points: DataFrame, keys: list[str], sites: DataFrame, site: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(keys, site, dist): the nearest site of each point, the smallest site of equals."""
    return top_sites(points, keys, sites, site, 1, lat, lon).select(*keys, site, "dist")


def plausible(dist: Column, rtt: Column, km_per_ms: float = KM_PER_MS) -> Column:
    """Whether a round trip of rtt ms can reach dist km away."""
    return dist <= rtt * km_per_ms


def allowed_by_all(checks: DataFrame, group: str, sites: DataFrame, site: str, rtt: str = "rtt", km_per_ms: float = KM_PER_MS) -> DataFrame:
    """(group, site): sites that the round trip of every row of checks (group, latitude, longitude, rtt) of a group allows.

    A site is kept if as many rows allow it as the group has: two counts, so a group with very many rows is only summed up.
    """
    n = checks.groupBy(group).agg(F.count("*").alias("n"))
    ok = sites_within(checks, [group], sites, site, F.col(rtt) * km_per_ms).groupBy(group, site).agg(F.count("*").alias("k"))
    return ok.join(n, group).filter("k = n").select(group, site)


def hint_places(hints: DataFrame, cities: DataFrame, codes: DataFrame, spread: float | None = 0.5) -> DataFrame:
    """(id, city, lat, lon): the place a hint names; ids whose hint names none, or several places far apart, have no row.

    hints: (id, hint); cities: (city, admin, lat, lon, population), lower-cased names; codes: (code, city) of airports.
    A name of several words that occurs in the hint wins; then a token that is an airport code, if its city's name or
    'ixp' is among the tokens too; then a token that is a city's name. Of two or more places of that name those whose admin is
    among the tokens are kept, if any. What is left must lie within `spread` degrees on both axes (the first by
    population is given); with spread=None the most populous is taken instead.
    """
    from webobs.functions.text import split_hint
    from webobs.operators.joins import contains_first

    t = hints.select("id", "hint", split_hint(F.col("hint")).alias("toks"))
    names = cities.filter(F.contains("city", F.lit(" "))).groupBy("city").agg(F.max("population").alias("p")).withColumn("ord", -F.col("p"))
    long = contains_first(hints, "id", "hint", names, "city", "ord").select("id", F.col("name").alias("city"), F.lit(1).alias("way"))
    one = t.select("id", "toks", F.explode("toks").alias("tok"))
    code = one.join(codes, one["tok"] == codes["code"]).filter(F.array_contains("toks", F.lit("ixp")) | F.array_contains("toks", F.col("city"))).select("id", "city", F.lit(2).alias("way"))
    plain_ = one.join(cities.select(F.col("city").alias("tok")).distinct(), "tok").select("id", F.col("tok").alias("city"), F.lit(3).alias("way"))
    best = long.union(code).union(plain_).groupBy("id").agg(F.min(F.struct("way", "city")).alias("m")).select("id", "m.city")
    c = best.join(cities, "city").join(t.select("id", "toks"), "id").withColumn("own", F.coalesce(F.array_contains("toks", F.col("admin")), F.lit(False)))
    n = c.groupBy("id").agg(F.max("own").alias("any"))
    c = c.join(n, "id").filter(F.col("own") | ~F.col("any"))
    g = c.groupBy("id").agg(F.max_by(F.struct("city", "lat", "lon"), F.struct("population", "lat", "lon")).alias("m"), (F.max("lat") - F.min("lat")).alias("dy"), (F.max("lon") - F.min("lon")).alias("dx"))
    if spread is not None:
        g = g.filter((F.col("dy") <= spread) & (F.col("dx") <= spread))
    return g.select("id", "m.*")


def verified_hops(hops: DataFrame, vantages: DataFrame, by_name: DataFrame, by_net: DataFrame, prefix: int = 24, km_per_ms: float = KM_PER_MS) -> DataFrame:
    """hops with the place (h_lat, h_lon) their name or else their network tells, if the round trip from the vantage allows it.

    hops: (target, vantage, hop_index, ip, hostname, rtt); vantages: (vantage, v_lat, v_lon); by_name: (hostname, lat, lon);
    by_net: (net, lat, lon) of networks of length `prefix`. A name that tells a place isn't overruled by the network. A hop
    whose column `own` (if there is one) is true lies in the destination's own networks and is placed by name only.
    """
    from webobs.functions.net import subnet

    h = hops.filter("ip is not null and rtt is not null").withColumn("net", subnet(F.col("ip"), prefix))
    h = h.join(by_name.toDF("hostname", "n_lat", "n_lon"), "hostname", "left").join(by_net.toDF("net", "a_lat", "a_lon"), "net", "left").join(vantages, "vantage")
    named = F.col("n_lat").isNotNull()
    free = ~F.coalesce("own", F.lit(False)) if "own" in h.columns else F.lit(True)
    h = h.withColumn("h_lat", F.when(named, F.col("n_lat")).when(free, F.col("a_lat"))).withColumn("h_lon", F.when(named, F.col("n_lon")).when(free, F.col("a_lon")))
    ok = plausible(haversine(F.col("v_lat"), F.col("v_lon"), F.col("h_lat"), F.col("h_lon")), F.col("rtt"), km_per_ms)
    return h.filter(F.col("h_lat").isNotNull() & ok).drop("n_lat", "n_lon", "a_lat", "a_lon", "net")


def site_candidates(ends: DataFrame, middle: DataFrame, sites: DataFrame, k: int = 3, km_per_ms: float = KM_PER_MS, typical: float = 66.7) -> DataFrame:
    """(target, vantage, site_id, way): replica sites a vantage's trace allows.

    ends: (target, vantage, v_lat, v_lon, rtt) at the destination; middle: verified_hops. 'all' are the sites within reach of
    the vantage and, for every verified hop, within reach of the hop in the rest of the round trip (at least 0.3 ms).
    Where no site passes, of the sites within reach of the vantage the k whose distance from the verified hop nearest in time is
    most like its rest of the round trip are given as 'residual'.
    """
    from webobs.operators.joins import for_all

    key = ["target", "vantage"]
    e = sites_within(ends, [*key, "rtt"], sites, "site_id", F.col("rtt") * km_per_ms, "v_lat", "v_lon").select(*key, "site_id", F.col("rtt").alias("end_rtt"))
    e = cut(e.join(sites.select("site_id", "s_lat", "s_lon"), "site_id"))
    gap = F.greatest(F.abs(F.col("end_rtt") - F.col("rtt")), F.lit(0.3))
    m = middle.select(*key, "rtt", "h_lat", "h_lon")
    good = cut(for_all(e, m, key, plausible(haversine(F.col("h_lat"), F.col("h_lon"), F.col("s_lat"), F.col("s_lon")), gap, km_per_ms)).select(*key, "site_id"))
    none = ends.join(good.select(*key).distinct(), key, "left_anti").select(*key, F.col("rtt").alias("end_rtt"))
    anchor = m.join(none, key).withColumn("gap", gap).groupBy(*key).agg(F.min(F.struct("gap", "h_lat", "h_lon")).alias("a")).select(*key, "a.*")
    off = e.join(anchor, key).withColumn("off", F.round(F.abs(haversine(F.col("h_lat"), F.col("h_lon"), F.col("s_lat"), F.col("s_lon")) - F.col("gap") * typical), 6))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("off", "site_id"))  # the sites within reach of one vantage
    rest = off.withColumn("r", rank).filter(F.col("r") <= k).select(*key, "site_id")
    return good.withColumn("way", F.lit("all")).union(rest.withColumn("way", F.lit("residual")))
