"""Injected sources, sinks and small operators: searching, scoring, lookups, bodies, caps."""

import json

from pyspark.sql import functions as F

from webobs.functions import text as T
from webobs.functions import urls as U
from webobs.operators import joins, slices
from webobs.sources import readers as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_pages_with_limits(spark):
    def ask(term, page):
        if term == "bad":
            raise OSError("broken")
        if term == "busy":
            raise R.RateLimited("later")
        return [f"{term}/{page}/{i}" for i in range(3)] if page < (4 if term == "long" else 2) else []

    t = spark.createDataFrame([("long",), ("short",), ("bad",), ("busy",), (None,)], "term string")
    got = rows(R.search(t, "term", ask, num=7))
    assert sum(r[0] == "long" and r[2] for r in got) == 7 and sum(r[0] == "short" and r[2] for r in got) == 3
    assert [r for r in got if not r[2]] == [("bad", None, False, "broken"), ("busy", None, False, "later")]


def test_scorer_with_retries(spark):
    class Ask:
        def __init__(self):
            self.n = 0

        def __call__(self, x):
            self.n += 1
            if x == "down" or (x == "shaky" and self.n % 3):
                raise TimeoutError("slow")
            return "none" if x == "odd" else f"class {len(x)} of 9"

    d = spark.createDataFrame([(1, "down"), (2, "shaky"), (3, "fine"), (4, "odd"), (5, None)], "id long, t string").coalesce(1)
    got = {r["id"]: (r["label"], r["error"]) for r in R.scored(d, "id", "t", Ask(), tries=5).collect()}
    assert got == {1: (None, "slow"), 2: (5, None), 3: (4, None), 4: (None, None), 5: (None, None)}


def test_addresses_are_looked_up_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def lookup(h):
        with open(log, "a") as f:
            f.write(h + "\n")
        if h == "gone.example":
            raise OSError
        return ["198.18.0.2", "198.18.0.1", "fe80::1%eth0", "198.18.0.1"]

    known = spark.createDataFrame([("old.example", ["198.18.9.9"])], "host string, ips array<string>")
    h = spark.createDataFrame([("A.example",), ("a.example",), ("old.example",), ("gone.example",), (None,), ("",)], "h string")
    got, grown = R.addresses(h, "h", known, lookup)
    assert rows(got) == [("a.example", ["198.18.0.1", "198.18.0.2", "fe80::1"]), ("gone.example", []), ("old.example", ["198.18.9.9"])]
    assert rows(R.addresses(h, "h", grown, lookup)[0]) == rows(got)
    assert sorted(open(log).read().split()) == ["a.example", "gone.example"]


def test_bodies_and_sizes(spark):
    assert R.decoded("grün".encode("latin-1"), "iso-8859-1") == "grün" and R.decoded(b'<meta charset="windows-1252">\x80').endswith("€")
    assert R.decoded(b"\xff\xfeh\x00i\x00") == "hi" and R.decoded(b"\xe9", "no-such") == "é" and R.decoded("日本".encode()) == "日本"
    u = spark.createDataFrame([("big",), ("ok",), ("told",)], "u string")
    got = {r["url"]: (r["success"], r["error"], r["content"]) for r in R.fetch(u, "u", lambda x: (x + "/", b"x" * (50 if x == "big" else 5), "ascii"), most=10, head=lambda x: 99 if x == "told" else None).collect()}
    assert got == {"big": (False, "too large", None), "ok": (True, None, "xxxxx"), "told": (False, "too large", None)}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", {"x": 1.5}), ("b", {}), (None, {})], "k string, v map<string,double>")
    R.write_map(d, str(tmp_path / "m"), "k", "v")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()) == ['{"a":{"x":1.5}}', '{"b":{}}']
    R.write_json(d, str(tmp_path / "j"), one_file=True)
    assert len([f for f in (tmp_path / "j").iterdir() if f.suffix == ".json"]) == 1
    assert json.loads(spark.read.text(str(tmp_path / "j")).filter("value like '%\"a\"%'").first()[0]) == {"k": "a", "v": {"x": 1.5}}
    assert R.reset(spark, str(tmp_path / "j")) and not R.reset(spark, str(tmp_path / "j"))
    b = R.background(spark.createDataFrame([(2, "Ab news groups"), (1, "Some words"), (3, None)], "id long, t string"), "id", "t", most=1)
    assert rows(b) == [(1, ["some", "words"])]


def test_public_suffixes(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "r string")
    h = ["a.b.com", "com", "x.co.uk", "co.uk", "a.x.co.uk", "a.b.ck", "b.ck", "x.a.b.ck", "www.ck", "y.www.ck", "host.zzz", "198.18.0.1", "", None]
    got = {r["h"]: r["fld"] for r in joins.registrable_by(spark.createDataFrame([(x,) for x in h], "h string"), "h", rules, "r").collect()}
    assert got == {"a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "a.x.co.uk": "x.co.uk", "a.b.ck": "a.b.ck", "b.ck": None, "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "y.www.ck": "www.ck", "host.zzz": "host.zzz", "198.18.0.1": None, "": None, None: None}


def test_links_as_the_standard_resolves_them(spark):
    from urllib.parse import urljoin

    bases = ["http://h.example/b/c", "http://h.example/b/c/", "http://h.example", "https://h.example/a?q=1#f", "http://h.example/x/y/z"]
    links = ["g", "./g", "g/", "/g", "//o.example/g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "mailto:a@b", "http://o.example/../x"]
    d = spark.createDataFrame([(b, l) for b in bases for l in links] + [(None, "g"), ("http://h.example/", None)], "b string, l string")
    got = {(r["b"], r["l"]): r["t"] for r in d.select("b", "l", U.resolve(F.col("b"), F.col("l")).alias("t")).collect()}
    assert got.pop((None, "g")) is None and got.pop(("http://h.example/", None)) is None
    for (b, l), t in got.items():
        want = urljoin(b, l) if not l.startswith("http") else l
        if l == "":
            want = b.split("#")[0]  # as the RFC, without the fragment
        if b == "http://h.example" and want == b + l and l and l[0] not in "?#/":
            want = f"{b}/{l}"
        assert t == want or t.rstrip("/") == want.rstrip("/"), (b, l, t, want)


def test_words_slices_and_caps(spark):
    d = spark.createDataFrame([(1, "Größe des Cafés, naïve; router-x 链路 3.14"), (2, None), (3, "")], "id long, t string")
    got = dict(d.select("id", T.basic_words_udf()("t")).collect())
    assert got == {1: ["große", "cafes", "naive", "router"], 2: [], 3: []}
    n = spark.range(50).toDF("id")
    a, b = ([r["id"] for r in slices.shuffled(n, F.col("id"), s).orderBy("n").collect()] for s in (1, 2))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b and a == [r["id"] for r in slices.shuffled(n.repartition(7), F.col("id"), 1).orderBy("n").collect()]
    c = slices.capped(n.withColumn("k", F.col("id") % 3), ["k"], ["id"], 2)
    assert sorted(r["id"] for r in c.collect()) == [0, 1, 2, 3, 4, 5]
