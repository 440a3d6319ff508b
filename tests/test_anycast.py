"""The analysis of anycast sites against a plain version of its definition, on the smallest tables and on invented cases."""

import os
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from webobs.operators import anycast
from webobs.plans import catalog

DATA = os.environ.get("WEBOBS_TEST_DATA", "/root/testdata/sf0.001")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def number(ip, bits=32):
    p = (ip or "").split(".")
    if len(p) != 4 or not all(x.isdigit() and len(x) <= 3 and int(x) < 256 for x in p):
        return None
    n = sum(int(x) << s for x, s in zip(p, (24, 16, 8, 0)))
    return n >> (32 - bits) << (32 - bits)


def plain_analysis():
    """(sites, report, candidates) by loops over everything."""
    km = lambda a, b, c, d: anycast._km((a, b), (c, d))
    v = {r["loc_id"]: (r["latitude"], r["longitude"]) for r in table("vp_location") if r["latitude"] is not None and r["longitude"] is not None and abs(r["latitude"]) <= 90 and abs(r["longitude"]) <= 180}
    sites = sorted((r["site_id"], r["latitude"], r["longitude"]) for r in table("replica_site"))
    traces = defaultdict(list)
    for h in table("trace_hop"):
        traces[h["trace_id"]].append(h)
    some = lambda x: x is not None and x == x

    def fold(hops):  # address -> (rtt, first hop)
        out = {}
        for h in hops:
            if h["ip"] is not None and some(h["rtt"]):
                a = out.get(h["ip"], (9e9, 9e9))
                out[h["ip"]] = min(a[0], h["rtt"]), min(a[1], h["hop_index"])
        return out

    usable = {t: hs for t, hs in traces.items() if all(h["is_successful"] for h in hs) and max(h["hop_index"] for h in hs) <= 64 and all(h["ip"] is None or number(h["ip"]) is not None for h in hs)}

    def ends(some_traces):
        nets, rtts = defaultdict(lambda: defaultdict(set)), {}
        for hs in some_traces.values():
            dest, loc, f = hs[0]["dest_ip"], hs[0]["loc_id"], fold(hs)
            if dest not in f:
                continue
            rtts[dest, loc] = min(rtts.get((dest, loc), 9e9), f[dest][0])
            at = sorted({i for _, i in f.values()})
            nets[dest][loc] |= {number(ip, 30) for ip, (_, i) in f.items() if len(at) > 1 and i == at[-2] and ip != dest}
        return nets, rtts

    nets, rtts = ends(usable)
    groups = {}  # (dest, founding vantage) -> vantages
    for dest, by in nets.items():
        found = []
        for loc in sorted(by):
            k = next((f for f in found if by[f] & by[loc]), None)
            if k is None:
                found.append(loc)
                k = loc
            groups.setdefault((dest, k), []).append(loc)
    count = defaultdict(int)
    for d, _ in groups:
        count[d] += 1
    groups = {k: x for k, x in groups.items() if count[k[0]] > 1}
    # The dictionary of places.
    cities = defaultdict(list)
    for r in table("vp_location"):
        if r["city"] is not None and r["latitude"] is not None and r["longitude"] is not None:
            cities[r["city"].lower(), None if r["country_code"] is None else r["country_code"].lower()].append((r["latitude"], r["longitude"]))
    code = {}
    for (c, _), p in cities.items():
        code.setdefault(c[:3], []).append(((len(p), c), (sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p))))
    by_net = {}
    for r in sorted(table("vp_location"), key=lambda r: r["loc_id"]):
        if r["loc_id"] in v and number(r["ip_addr"]) is not None:
            by_net.setdefault(number(r["ip_addr"], 24), v[r["loc_id"]])

    def candidates(hops_of, loc, dest, rtt, own):
        y, x = v[loc]
        mids = []
        for h in hops_of:
            if h["ip"] is None or not some(h["rtt"]) or h["ip"] == dest:
                continue
            name = (h["hostname"] or "").split(".")
            at = max(code[name[1]])[1] if len(name) > 1 and name[1] in code else None
            if at is None and number(h["ip"], 30) not in own:
                at = by_net.get(number(h["ip"], 24))
            if at and km(y, x, *at) <= h["rtt"] * 100:
                mids.append((max(abs(rtt - h["rtt"]), 0.3), *at))
        reach = [s for s in sites if km(y, x, s[1], s[2]) <= rtt * 100]
        good = [s[0] for s in reach if all(km(a, b, s[1], s[2]) <= g * 100 for g, a, b in mids)]
        if good or not mids:
            return good, "all"
        g, a, b = min(mids)
        return [i for _, i in sorted((round(abs(km(a, b, s[1], s[2]) - g * 66.7), 6), s[0]) for s in reach)[:3]], "residual"

    hops = defaultdict(list)
    for hs in usable.values():
        hops[hs[0]["dest_ip"], hs[0]["loc_id"]] += hs
    out = []
    for (dest, k), members in groups.items():
        near = [(v[m][0], v[m][1], rtts[dest, m], m) for m in members if rtts[dest, m] <= 3 and m in v]
        if near:
            y, x, _, _ = anycast.place_of(near)
            out.append((dest, k, len(members), min((round(km(y, x, s[1], s[2]), 6), s[0]) for s in sites)[1], "near", len(near)))
            continue
        votes = defaultdict(int)
        for m in members:
            if m in v:
                for s in candidates(hops[dest, m], m, dest, rtts[dest, m], nets[dest][k])[0]:
                    votes[s] += 1
        best = max(votes, key=lambda s: (votes[s], -s)) if votes else None
        out.append((dest, k, len(members), best, "votes" if votes else None, votes[best] if votes else None))
    last = {}
    for d, k, _, s, _, _ in sorted(out, key=lambda r: r[:2]):
        if s is not None:
            last |= {m: s for m in groups[d, k]}
    report = {}
    for (_, loc), x in rtts.items():
        report[loc] = min(report.get(loc, 9e9), x)
    every = defaultdict(list)
    for hs in traces.values():
        every[hs[0]["dest_ip"], hs[0]["loc_id"]] += hs
    reach = {}
    for (d, loc), hs in every.items():
        x = [h["rtt"] for h in hs if h["ip"] == d and some(h["rtt"])]
        if x and loc in v:
            reach[d, loc] = min(x)
    c = [(d, loc, s, way) for (d, loc), x in reach.items() for got, way in [candidates(every[d, loc], loc, d, x, ())] for s in got]
    return out, [(loc, x, last.get(loc)) for loc, x in report.items()], c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_analysis_equals_plain_version(spark):
    sites, report, cands = plain_analysis()
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in catalog.QUERIES["anycast_sites"](spark, DATA).select("dest_ip", "site", "vantages", "site_id", "how", "votes").collect()), key=key)
    assert got == sorted(sites, key=key) and len(sites) > 10 and any(s[4] for s in sites)
    got = sorted((tuple(r) for r in catalog.QUERIES["vantage_report"](spark, DATA).select("loc_id", "rtt", "reached_site").collect()), key=key)
    assert got == sorted(report, key=key)
    assert rows(catalog.QUERIES["site_candidates"](spark, DATA)) == sorted(cands)


def test_largest_cluster_of_vantages_wins(spark):
    g = spark.createDataFrame([("d", i, 0, r) for i, r in enumerate([1.0, 1.0, 1.0, 0.5, 0.6, 9.0])], "dest_ip string, vantage long, site long, rtt double")
    v = spark.createDataFrame([(0, 10.0, 10.0), (1, 10.0, 10.0), (2, 10.0, 10.0), (3, 50.0, 50.0), (4, 50.1, 50.1), (5, 0.0, 0.0)], "vantage long, lat double, lon double")
    assert rows(anycast.located_sites(g, v, "dest_ip").select("n_vantages", "near_id", "lat")) == [(5, 0, 10.0)]


def test_sites_of_vantages_without_networks(spark):
    e = spark.createDataFrame([("d", 1, None), ("d", 2, 8), ("d", 3, 8), ("d", 3, 12), ("d", 4, 12), ("d", 5, None)], "dest_ip string, loc_id long, net long")
    assert rows(anycast.site_groups(e, "dest_ip", "loc_id", "net")) == [("d", 1, 1), ("d", 2, 2), ("d", 3, 2), ("d", 4, 4), ("d", 5, 5)]
