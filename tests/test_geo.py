"""Places from hints, and candidates of sites, on small invented tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webobs.operators import geo


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hint_places(spark):
    hints = spark.createDataFrame([(1, "Sao Paulo, BR"), (2, "lim ixp"), (3, "lim"), (4, "Limaton"), (5, "Twin, aa"), (6, "Twin"), (7, None), (8, ""), (9, "AS (AS64500)")], "id long, hint string")
    cities = spark.createDataFrame([("sao paulo", "br", -23.5, -46.6, 9), ("limaton", "pe", -12.0, -77.0, 5), ("twin", "aa", 1.0, 1.0, 1), ("twin", "bb", 50.0, 50.0, 7)], "city string, admin string, lat double, lon double, population long")
    codes = spark.createDataFrame([("lim", "limaton")], "code string, city string")
    got = {r["id"]: (r["city"], r["lat"]) for r in geo.hint_places(hints, cities, codes).collect()}
    assert got == {1: ("sao paulo", -23.5), 2: ("limaton", -12.0), 4: ("limaton", -12.0), 5: ("twin", 1.0)}
    most = {r["id"]: r["lat"] for r in geo.hint_places(hints, cities, codes, spread=None).collect()}
    assert most[6] == 50.0 and most[5] == 1.0


def test_site_candidates(spark):
    sites = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 5.0), (3, 0.0, 60.0)], "site_id long, s_lat double, s_lon double")
    v = spark.createDataFrame([(7, 0.0, 0.0)], "vantage long, v_lat double, v_lon double")
    hops = spark.createDataFrame([("t", 7, 2, "198.18.0.1", "a", 1.5), ("t", 7, 3, "198.18.9.1", None, 1.0), ("t", 7, 4, "198.18.0.2", "far", 1.0), ("t", 7, 5, None, None, None)], "target string, vantage long, hop_index int, ip string, hostname string, rtt double")
    by_name = spark.createDataFrame([("a", 0.0, 0.9), ("far", 0.0, 90.0)], "hostname string, lat double, lon double")
    by_net = spark.createDataFrame([(3323070720, 0.0, 0.5)], "net long, lat double, lon double")
    m = geo.verified_hops(hops, v, by_name, by_net)
    assert rows(m.select("hop_index", "h_lon")) == [(2, 0.9), (3, 0.5)]
    ends = spark.createDataFrame([("t", 7, 2.0)], "target string, vantage long, rtt double").join(v, "vantage")
    assert rows(geo.site_candidates(ends, m, sites)) == [("t", 7, 1, "all")]
    tight = spark.createDataFrame([("t", 7, 0.4)], "target string, vantage long, rtt double").join(v, "vantage")
    assert rows(geo.site_candidates(tight, m, sites)) == []  # no site within reach of the vantage
    wide = spark.createDataFrame([("t", 7, 6.0)], "target string, vantage long, rtt double").join(v, "vantage")
    between = spark.createDataFrame([("t", 7, 5.9, 0.0, 3.0)], "target string, vantage long, rtt double, h_lat double, h_lon double")
    assert rows(geo.site_candidates(wide, between, sites)) == [("t", 7, 1, "residual"), ("t", 7, 2, "residual")]  # of those within reach


def test_top_sites_equal_brute_force(spark):
    r = random.Random(4)
    pts = [(i, r.uniform(-90, 90), r.uniform(-180, 180), r.choice(["a", "b", None]), r.uniform(0, 9000)) for i in range(60)] + [(98, None, 1.0, "a", 1.0), (99, 10.0, 20.0, "a", None)]
    sites = [(i, r.uniform(-90, 90), r.uniform(-180, 180), r.choice(["a", "b", "c", None])) for i in range(25)] + [(50, 10.0, 20.0, "a"), (51, 10.0, 20.0, "a"), (52, 10.0, None, "a")]
    p = spark.createDataFrame(pts, "id long, latitude double, longitude double, cc string, far double")
    s = spark.createDataFrame(sites, "site_id long, s_lat double, s_lon double, s_cc string")
    km = lambda a, b, c, d: 2 * 6371 * math.asin(min(1, math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2)))

    def best(x, k, to=0.0, cc=False):
        if x[1] is None:
            return []
        d = sorted((round(abs(km(x[1], x[2], z[1], z[2]) - to), 6), z[0]) for z in sites if z[2] is not None and (not cc or (x[3] is not None and x[3] == z[3])))
        return [(x[0], z, i + 1) for i, (_, z) in enumerate(d[:k])]

    cols = ("id", "site_id", "rank")
    for block in (50_000, 4):
        with pytest.MonkeyPatch.context() as mp:
            mp.setattr(geo, "BLOCK", block)
            assert rows(geo.top_sites(p, ["id"], s, "site_id", 3).select(*cols)) == sorted(y for x in pts for y in best(x, 3))
            assert rows(geo.top_sites(p, ["id"], s, "site_id", 2, scope=(F.col("cc"), "s_cc")).select(*cols)) == sorted(y for x in pts for y in best(x, 2, cc=True))
            assert rows(geo.top_sites(p.filter("far is not null"), ["id"], s, "site_id", 3, target=F.col("far")).select(*cols)) == sorted(y for x in pts if x[4] is not None for y in best(x, 3, x[4]))
            assert rows(geo.sites_within(p, ["id"], s, "site_id", F.col("far")).select("id", "site_id")) == sorted((x[0], z[0]) for x in pts for z in sites if None not in (x[1], x[4], z[2]) and km(x[1], x[2], z[1], z[2]) <= x[4])
    assert rows(geo.top_sites(p, ["id"], s.limit(0), "site_id", 3)) == [] and rows(geo.nearest(p.limit(0), ["id"], s, "site_id")) == []


def test_many_sites_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 4)
    sites = spark.createDataFrame([(i, float(i), 0.0) for i in range(11)], "site_id long, s_lat double, s_lon double")
    p = spark.createDataFrame([(1, 3.2, 0.0), (2, None, 0.0)], "id long, latitude double, longitude double")
    assert geo.sites_within(p, ["id"], sites, "site_id", F.lit(30_000.0)).count() == 11
    assert rows(geo.nearest(p, ["id"], sites, "site_id").select("id", "site_id")) == [(1, 3)]
