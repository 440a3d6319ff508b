"""Core operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from webobs.operators import anycast, classify, dedup, graph, interval, joins, similarity, slices, tfidf


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def find(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        x, y = sorted((f(a), f(b)))
        p[y] = x
    return {x: f(x) for x in p}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [e for e in edges if e[0] != e[1]] + [(7, 7), (None, 3)]
    got = {a: b for a, b in rows(graph.components(spark.createDataFrame(edges, "a long, b long")))}
    want = find([e for e in edges if None not in e and e[0] != e[1]])
    assert got == {k: min(x for x in want if want[x] == v) for k, v in want.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbering_and_tiles(spark):
    v = list(range(50))
    random.Random(3).shuffle(v)
    df = spark.createDataFrame([(x,) for x in v], "x long")
    assert [r["n"] for r in slices.numbered(df, ["x"]).orderBy("x").collect()] == list(range(50))
    assert rows(slices.tiles(df, ["x"], 7).groupBy("tile").count()) == [(1, 8)] + [(i, 7) for i in range(2, 8)]
    assert slices.numbered(df.limit(0), ["x"]).count() == 0


def test_interval_join(spark):
    r = random.Random(5)
    pts = [(i % 2, r.uniform(0, 100), f"ip{i}") for i in range(200)] + [(0, 10.0, "edge"), (0, None, "none")]
    win = [(i % 2, s := r.uniform(0, 90), s + r.uniform(0, 25), i) for i in range(40)] + [(0, 10.0, 20.0, 99), (1, 5.0, 5.0, 98), (1, 9.0, 3.0, 97)]
    p = spark.createDataFrame(pts, "m long, ts double, ip string")
    w = spark.createDataFrame(win, "m long, s double, e double, vp long")
    got = rows(interval.interval_join(p, w, "m", "ts", "s", "e", 7.0).select("ip", "vp"))
    assert got == sorted((ip, v) for m, t, ip in pts for n, s, e, v in win if t is not None and m == n and s < t < e)


def test_assignment_order(spark):
    c = spark.createDataFrame([(0, "a", True, True), (1, "a", True, True), (1, "b", True, True), (2, "b", True, True), (5, "z", False, True)], "vp long, ip string, everywhere boolean, often boolean")
    assert rows(interval.assign(c, "vp", "ip")) == [(0, "a"), (1, "b"), (5, "z")]
    assert rows(interval.first_round(c, "vp", "ip")) == [(0, "a"), (2, "b"), (5, "z")]


def test_longest_prefix_and_for_all(spark):
    ips = spark.createDataFrame([(167772161,), (167772417,), (1,)], "n long")
    nets = spark.createDataFrame([(167772160, 24, "a"), (167772160, 8, "b"), (167772161, 32, "c")], "lo long, p int, v string")
    assert rows(joins.longest_prefix(ips, "n", nets, "lo", "p", "v")) == [(1, None), (167772161, "c"), (167772417, "b")]
    c = spark.createDataFrame([("h", 1), ("h", 2), ("g", 1)], "k string, site long")
    k = spark.createDataFrame([("h", 5), ("h", 1)], "k string, most long")
    assert rows(joins.for_all(c, k, ["k"], F.col("site") <= F.col("most")).select(c["k"], "site")) == [("g", 1), ("h", 1)]


def test_dedup(spark):
    d = spark.createDataFrame([(1, "B", "https://a.x/"), (2, "A", "http://a.x"), (3, "C", "ftp://a.x"), (4, "D", None), (5, "E", "http://a.x//"), (6, "F", "http://a://b")], "id long, name string, url string")
    assert rows(dedup.by_canonical_url(d, "url", "name", "id")) == [("a.x", "http://a.x", "B"), ("a.x/", "http://a.x/", "E")]
    t = spark.createDataFrame([(1, "x", "1.2.3.4"), (2, "x", "longer.host"), (3, "x", "host"), (4, None, "q"), (5, "", None)], "id long, text string, url string")
    assert [(r["id"], r["n"]) for r in dedup.by_content_hash(t, "text", "url", "id").orderBy("id").collect()] == [(3, 3), (5, 1)]
    m = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "c", 4), (2, "d", 5), (3, None, 6)], "g long, v string, o long")
    assert rows(dedup.mode_first(m, "g", "v", "o")) == [(1, "b", 2), (2, "c", 1)]


def test_overlap_links_equal_brute_force(spark):
    import math

    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        s = set(r.sample(base, r.randrange(3, 40)))
        docs.append((i, sorted(s)))
        if i % 4 == 0:
            docs.append((1000 + i, sorted((s - {r.choice(sorted(s))}) | {f"n{i}"})))
    docs += [(2000, docs[0][1]), (2001, [])]
    df = spark.createDataFrame(docs, "id long, s array<string>")
    for least in (0.4, 0.6, 0.8):
        got = {(a, b) for a, b, _ in rows(similarity.overlap_links(df, "id", "s", least))}
        seen, reps = set(), []
        for i, s in sorted(docs):
            if s and tuple(s) not in seen:
                seen.add(tuple(s))
                reps.append((i, set(s)))
        want = {(a, b) for k, (a, x) in enumerate(reps) for b, y in reps[k + 1 :] if x & y and len(x & y) / (math.log(max(len(x), len(y))) + min(len(x), len(y))) >= least}
        assert got == want


def test_sequence_ratio():
    assert similarity.sequence_ratio([], ["a"]) == 0.0
    assert similarity.sequence_ratio(["a", "b"], ["a", "b"]) == pytest.approx(2 / 3)


def test_tag_links_lose_no_pair(spark):
    r = random.Random(3)
    base = [[r.choice(["div", "a", "li", "p"]) for _ in range(n)] for n in (26, 30, 40, 90)]
    docs = [(1, ["p"]), (2, [])]
    for b in base * 12:
        s = list(b)
        for _ in range(r.randrange(5)):  # scattered edits: every run of 6 tags around one is another
            k = r.randrange(len(s))
            s[k : k + r.randrange(2)] = [r.choice(["div", "a", "li", "tr"])]
        docs.append((len(docs) + 1, s))
    docs += [(len(docs) + 1, docs[4][1]), (len(docs) + 2, docs[4][1][::-1])]
    first = {}
    for i, s in docs:
        if s:
            first.setdefault(tuple(s), i)
    want = sorted((i, j, similarity.sequence_ratio(s, t)) for s, i in first.items() for t, j in first.items() if i < j and similarity.sequence_ratio(s, t) >= 0.8)
    df = spark.createDataFrame(docs, "id long, tags array<string>")
    for block in (64, 1):
        assert rows(similarity.tag_links(df, "id", "tags", 0.8, block=block)) == want
    assert len(want) > 100 and similarity.tag_links(df.limit(0), "id", "tags").count() == 0


def test_cluster_keywords_equal_refit(spark):
    import math

    r = random.Random(2)
    docs = [(i, f"c{i % 3}", [r.choice("abcdefgh") * 4 for _ in range(r.randrange(0, 9))]) for i in range(30)]
    df = spark.createDataFrame(docs, "id long, c string, w array<string>")
    got = {(c, w): s for c, w, s, _ in rows(tfidf.cluster_keywords(df, "id", "c", "w", 0.0, 99))}
    n, dfc = len(docs), {}
    for _, _, w in docs:
        for x in set(w):
            dfc[x] = dfc.get(x, 0) + 1
    vec = {}
    for i, _, w in docs:
        v = {x: w.count(x) * (math.log((1 + n) / (1 + dfc[x])) + 1) for x in set(w)}
        norm = math.sqrt(sum(y * y for y in v.values()))
        vec[i] = {x: y / norm for x, y in v.items()}
    for c in ("c0", "c1", "c2"):
        rest = [d for d in docs if d[1] != c]
        s = {}
        for i, k, _ in docs:
            if k == c:
                for x, y in vec[i].items():
                    s[x] = s.get(x, 0) + y
        s = {x: y * math.log((len(rest) + 1) / (sum(x in d[2] for d in rest) + 1)) for x, y in s.items()}
        total = sum(s.values())
        for x, y in s.items():
            if y / total > 0:
                assert got[c, x] == pytest.approx(y / total, abs=1e-9)


def test_greedy_sites_and_places():
    assert anycast.greedy_sites([(1, {1}), (2, {2}), (3, {1, 2}), (4, {3, 2})]) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    pts = [(0.0, 0.0, 2.0, 1), (0.0, 0.5, 1.0, 2), (10.0, 0.0, 0.5, 3)]
    assert anycast.greedy_places(pts) == [0, 0, 1]
    assert anycast.place_of(pts)[3] == 2 and anycast.place_of(pts[2:])[3] == 3


def test_located_sites_count_vantages(spark):
    at = {v: (10.0, 20.0) for v in range(30)} | {40: (50.0, 1.0), 41: (50.1, 1.0)}
    g = spark.createDataFrame([("d", v, 1, 0.5 if v == 40 else 1.0 + v / 100) for v in at], "dest string, vantage long, site long, rtt double")
    v = spark.createDataFrame([(v, y, x) for v, (y, x) in at.items()], "vantage long, lat double, lon double")
    assert rows(anycast.located_sites(g, v, "dest")) == [("d", 1, 32, 0, 10.0, 20.0)]


def test_site_groups_follow_order(spark):
    e = spark.createDataFrame([("d", 1, 10), ("d", 2, 20), ("d", 3, 10), ("d", 3, 20), ("e", 9, 10), ("e", 9, None)], "dest string, v long, net long")
    assert rows(anycast.site_groups(e, "dest", "v", "net")) == [("d", 1, 1), ("d", 2, 2), ("d", 3, 1), ("e", 9, 9)]


def test_refinement_stops(spark):
    pool = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)], "id long, truth boolean")

    def interpret(samples, p):
        k = samples.filter("truth").count()
        return p.withColumn("said", (F.col("id") < 2 * k) & F.col("truth")).withColumn("label", F.lit(1)).withColumn("label2", F.col("id").cast("int")).withColumn("feature", F.array(F.lit(1))).withColumn("feature2", F.array(F.lit(2)))

    s, trail = classify.refine(pool.filter("id in (1, 3, 5, 7)"), pool, interpret, "id", rounds=6)
    assert s.count() == 4 and trail == sorted(trail) and len(trail) >= 2
