"""Training-data operators against brute force, round trips and cases with known answers; nulls, ties, empty and long texts."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webobs.functions.vectext import Words
from webobs.llm import boilerplate as bp
from webobs.llm import copies, leak, match, mix, neardup, residue, split, tokens


def words(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- word vectors ----
def test_words_of_batches():
    t = ["a bb  ccc", "", None, "ccc", " x ", "ä é bb"]
    w = Words(pa.array(t))
    got = [[bytes(w.raw[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [(s or "").split() for s in t]
    i, h = w.hashes(1)
    flat = [x for s in t for x in (s or "").split()]
    assert len({(x, int(y)) for x, y in zip(flat, h)}) == len(set(flat)) == len(set(h.tolist()))
    assert len(Words(pa.array([], pa.string())).hashes(3)[0]) == 0
    w = Words(pa.array(["a·b – “ccc”, x_y»", "…", "é·", "ªº。链"]), punctuation=True)
    assert [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "b", "ccc", "x", "y", "é", "ªº", "链"] and list(w.first) == [0, 5, 5, 6, 8]
    assert len(Words(pa.array(["ÄB"]), lower=True).hashes(1)[0]) == 1 and Words(pa.array(["ÄB"]), lower=True).hashes(1)[1][0] == Words(pa.array(["äb"])).hashes(1)[1][0]


# ---- 5: formatting ----
def key(n, u):
    head, _, tail = (u or "").partition("?")
    return tuple(sorted(words(n))), tuple(words(head)), tuple(sorted(tuple(words(p)) for p in re.split("[&;]", tail) if words(p)))


def records():
    base = [("LG One", "http://a.example/x?b=1&c=2"), ("one, lg", "HTTP://A.EXAMPLE/X?c=2;b=1"), ("One-LG", "http : // a.example/x/?b=1&c=2&"), (None, "http://b.example"), ("--", "http://b.example/"), ("", None), (None, None), ("LG One", "https://a.example/x?b=1&c=2"), ("LG One LG", "http://a.example/x?b=1&c=2"), ("Ä_b", "u?"), ("ä b", "u"), ("x" * 5000, "y?" + "p=1&" * 500)]
    return [(i, *base[i % len(base)]) for i in range(120)] + [(1000 + i, "hot", "http://hot.example") for i in range(90)]


def test_copies_equal_brute_force(spark):
    data = records()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "row_id long, name string, url string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(7)).repartition(5)
    by = {}
    for i, n, u in sorted(data):
        by.setdefault(key(n, u), []).append(i)
    want = sorted((v[0], x) for v in by.values() for x in v[1:])
    assert rows(copies.duplicates(df, copies.record_key())) == want  # the hot run spans all range partitions
    got = copies.collapse(df, copies.record_key()).select("row_id", "n_copies")
    assert rows(got) == sorted((v[0], len(v)) for v in by.values())
    assert rows(copies.duplicates(df.limit(0), copies.record_key())) == []


# ---- 6: near duplicates ----
def near_truth(data, k, above, least, inclusive=False):
    sets, seq = {}, {}
    for i, t in data:
        w = words(t)
        if len(w) >= least:
            seq[i] = tuple(w)
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    p = {i: i for i in sets}

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] | sets[b])
        s = len(sets[a] & sets[b]) / u if u else 0
        if seq[a] == seq[b] or s > above or (inclusive and s >= above and u):
            x, y = sorted((f(a), f(b)))
            p[y] = x
    return sorted((i, f(i)) for i in sets)


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        j = r.randrange(len(w))
        w[j : j + r.randrange(2)] = [f"z{r.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicates_equal_brute_force(spark, small):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    data, i = [], 0
    for g in range(8):
        w = [r.choice(vocab) for _ in range(120)]
        for k in range(r.choice([1, 3, 30])):  # one hot group of many alike
            data.append((i, " ".join(edited(r, w, r.randrange(0, 9)))))
            i += 1
    data += [(900, data[0][1].upper().replace(" ", ", ")), (901, None), (902, ""), (903, "one two"), (904, "one two"), (905, "w " * 100_000)]
    df = spark.createDataFrame(data, "page_id long, content string").withColumn("id", F.lit("clash")).withColumn("bucket", F.lit(0))
    got = rows(neardup.near_duplicates(df, "page_id", "content", 3, 0.7, False, 60, small=small))
    assert got == near_truth(data, 3, 0.7, 60)
    pairs = rows(neardup.grouped_pairs(neardup.near_duplicates(df, "page_id", "content", 3, 0.7, False, 60, small=small)))
    by = {}
    for a, g in got:
        by.setdefault(g, []).append(a)
    assert pairs == sorted(p for v in by.values() for p in itertools.combinations(sorted(v), 2))
    assert rows(neardup.near_duplicates(df, "page_id", "content")) == near_truth([x for x in data if words(x[1])], 5, 0.8, 1, True)
    assert rows(neardup.near_duplicates(df.limit(0), "page_id", "content")) == []


def test_probminhash_estimates_weighted_similarity():
    r = np.random.default_rng(5)
    e = r.integers(1, 2**62, 300).astype(np.uint64)
    wa, wb = r.uniform(0.1, 5, 300), r.uniform(0.1, 5, 300)
    m = 4096
    sig = neardup.probminhash(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[e, e], np.r_[wa, wb], 3, m)
    want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(300)) for i in range(300))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and not sig[2].any()


def test_hot_buckets_and_short_texts_make_few_pairs(spark, monkeypatch):
    r = random.Random(12)
    frame = [f"frame{i}" for i in range(60)]  # shared by all: two of them have a similarity of about 0.5
    unlike = [(i, " ".join([*frame, *(f"u{i}x{j}" for j in range(30))])) for i in range(1500)]
    like = [(5000 + i, " ".join([*frame, *(f"same{j}" for j in range(30)), f"z{i}"])) for i in range(300)]
    short = [(10_000 + i, f"two w{i}") for i in range(1500)]
    short += [(20_000, "two w5"), (20_001, "word")]
    r.shuffle(data := unlike + like + short)
    df = spark.createDataFrame(data, "page_id long, content string")
    made, real = [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda p, *a, **k: (made.append(p.count()), real(p, *a, **k))[1])
    got = dict(rows(neardup.near_duplicates(df, "page_id", "content", 3, 0.7)))
    assert {got[i] for i, _ in like} == {5000} and all(got[i] == i for i, _ in unlike) and got[20_000] == 10_005 and len(set(got.values())) == 1500 + 1 + 1501
    assert sum(made) < 30 * len(data)


def test_probability_jaccard_and_counted_runs(spark):
    r = np.random.default_rng(3)
    for _ in range(20):
        x, y = r.integers(0, 4, 30).astype(float), r.integers(0, 4, 30).astype(float)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(30)) for i in range(30) if x[i] and y[i])
        assert abs(neardup.probability_jaccard(x, y) - want) < 1e-9
    a = " ".join(f"w{i}" for i in range(40))
    data = [(1, a), (2, a + " w0" * 3), (3, a + " w0" * 400), (4, a.replace("w7 ", "q "))]
    df = spark.createDataFrame(data, "page_id long, content string")
    assert rows(neardup.near_duplicates(df, "page_id", "content", 1, 0.8, counted=True)) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert rows(neardup.near_duplicates(df, "page_id", "content", 1, 0.8)) == [(i, 1) for i in range(1, 5)]
    many = [(i, a if i % 2 else a.replace("w1", "v1").replace("w2", "v2") + f" x{i}") for i in range(60)]
    df = spark.createDataFrame(many, "page_id long, content string")
    assert {g for _, g in rows(neardup.near_duplicates(df, "page_id", "content", 1, 0.8, counted=True, small=2))} == {0, 1}


def test_prefix_pairs_lose_nothing(spark):
    r = random.Random(13)
    base = [[f"b{k}w{i}" for i in range(50)] for k in range(4)]
    data = [(i, " ".join(edited(r, base[i % 4], r.randrange(0, 12))), i if i % 3 else i % 4) for i in range(200)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t, _ in data}
    comp = {i: c for i, _, c in data}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if comp[a] != comp[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = set(rows(neardup.prefix_pairs(spark.createDataFrame(data, "id long, text string, comp long"), 3, 0.7, block=20)))
    assert want <= got and len(want) > 100


# ---- 7: leaks ----
def test_leaks(spark):
    r = random.Random(6)
    item = [f"Item{i}, word" if i % 7 == 0 else f"it{i}" for i in range(60)]
    item = " ".join(item).split()
    other = [f"q{i}" for i in range(30)]
    short = [f"s{i}" for i in range(10)]
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]

    def quote(a, n, swap=0):
        q = item[a : a + n]
        for j in range(swap):
            q[2 + 9 * j] = "zzz"
        return q

    docs = {
        1: noise(20) + quote(5, 18) + noise(9), 2: noise(5) + quote(10, 17) + noise(9), 3: [w.upper() + "!" for w in quote(0, 18, 2)] + noise(5), 4: quote(0, 18, 2)[:9] + ["extra"] + quote(0, 18)[9:] + noise(3),
        5: noise(3) + item + noise(3), 6: noise(40), 7: noise(2) + other[:18] + noise(1) + item[20:50], 8: short, 9: short[:9], 10: quote(3, 27, 3) + noise(4), 11: noise(150_000) + quote(30, 20), 12: ["\n".join(item)],
        13: noise(4) + short[:4] + ["zz"] + short[5:],
    }
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(20, None), (21, ""), (22, " \n ")], "doc_id long, text string").withColumn("t", F.lit(1))
    q = spark.createDataFrame([(100, " ".join(item)), (101, " ".join(other)), (102, " ".join(short)), (103, None), (104, " ... ")], "item_id long, text string")
    want = [(1, 100), (3, 100), (5, 100), (7, 100), (7, 101), (8, 102), (10, 100), (11, 100), (12, 100), (13, 102)]
    assert rows(leak.leaks(d, q).select("doc_id", "item_id")) == want
    assert rows(leak.leaks(d, q, chunk=50).select("doc_id", "item_id")) == want  # items in several chunks
    assert rows(leak.leaks(d, q.limit(0))) == [] and rows(leak.leaks(d.limit(0), q)) == []


# ---- 1: matching ----
def test_matching(spark):
    a = spark.createDataFrame(
        [(1, "64500", "Bazotrel Networks GmbH"), (2, "64501", "BAZOTREL-AS Bazotrel Networks, GmbH"), (3, "64502", "Bazotrel Cloud Ltd"), (4, "64503", "Kimodavel Telecom (Town)"), (5, "x", None), (6, "64504", " "), (7, "64505", "Rönatökas Fibre"), (8, "64506", "Plidorgamcable Oy"), (1, "64500", "Bazotrel Networks GmbH")],
        "as_id long, asn string, orgname string",
    ).withColumn("form", F.lit("clash"))
    n = spark.createDataFrame(
        [(10, "Bazotrel Networks", None, None), (11, "Networks Bazotrel", 64500, "http://bazotrel-net.example"), (12, "Bazotrel Cloud", 1, ""), (13, "Kimodvael Telecom", None, "https://www.kimodavel.example"), (14, "KMDVTE", 64503, "https://kimodavel.example"), (15, None, None, None), (16, "Ronatokas", 64505, "ronatokas.example"), (17, "Plidorgam Cable", None, "http://other.example"), (18, "Bazotrel Mobile", None, "http://bazotrel-mobile.example"), (19, "Town | Plidorgam Cable", None, None)],
        "net_id long, name string, asn long, website string",
    )
    got = rows(match.match(a, n))
    assert [(x, y) for x, y, _ in got] == sorted([(1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (4, 13), (4, 14), (7, 16), (8, 17), (8, 19)])
    assert all(0 <= c <= 1 for _, _, c in got)
    assert rows(match.match(a.limit(0), n)) == [] and rows(match.match(a, n.limit(0))) == []


def test_nearest_of_both_sides(spark):
    a = spark.createDataFrame([(1, None, "Zorbatel Cloud"), (2, None, "Zorbatil Cloud"), (3, None, "Plidorgam Cable"), (4, None, "Plidorgma Cable"), (5, None, "Kimodavel Mobile")], "as_id long, asn string, orgname string")
    n = spark.createDataFrame([(10, "Zorbatel Cloud", None, None), (11, "Zorbatil Cloud", None, None), (12, "Plidorgam Cable", None, None), (13, "Kimodavol Mobile", None, None)], "net_id long, name string, asn long, website string")
    got = rows(match.match(a, n))
    # Two organisations one edit apart aren't mixed up; a misspelled row goes with the right one beside it, and a lone one too.
    assert [x[:2] for x in got] == [(1, 10), (2, 11), (3, 12), (4, 12), (5, 13)]


def test_matching_of_an_organisation_of_many_forms(spark):
    a = spark.createDataFrame([(i, str(64500 + i), f"Zorbatel {x}{y}qua Networks GmbH") for i, (x, y) in enumerate(itertools.islice(itertools.product("bdfgklmn", "aeiouyrs"), 60))], "as_id long, asn string, orgname string")
    n = spark.createDataFrame([(100, "Zorbatel Networks", None, None), (101, "Bazotrel Networks", None, None)], "net_id long, name string, asn long, website string")
    assert [(x, y) for x, y, _ in rows(match.match(a, n))] == [(i, 100) for i in range(60)]
    left = spark.createDataFrame([(1, 7, "x", "name"), (2, 7, "d", "name"), (2, 8, "x", "site")], "id long, token long, kind string, field string")
    right = spark.createDataFrame([(i, 7) for i in range(70)] + [(5, 8)], "id long, token long")
    one, many = (rows(match.candidates(left, right, block=k)) for k in (1000, 4))
    assert [x[:2] for x in one] == [(l, r) for l in (1, 2) for r in range(70)] and [x[:2] + x[3:] for x in one] == [x[:2] + x[3:] for x in many]


# ---- 2 and 3: template and residue ----
def site(r, host, n, lang="en", start=0, furniture=True):
    org = host.split(".")[1].capitalize()
    top = [f"{org} GmbH", "[Home](/home)", "[Contact](/contact)", "Status", f"{org} NOC"]
    foot = [f"© 2020 {org} GmbH. All rights reserved.", "Back to top"]
    out = []
    for k in range(n):
        body = [f"Report {r.randrange(10**6)} of {r.choice('abcdefgh') * 5}"] + [" ".join(f"tok{r.randrange(10**5)}" for _ in range(r.randrange(8, 30))) + "." for _ in range(4)] + r.sample(["Ping", "Traceroute"], r.randrange(3))
        page = [*top, f"Home {'>›/'[k % 3]} {org} > {body[0]}", "", *body, *foot, f"Visitors today: {r.randrange(9999)} | Your address: 198.18.0.{k}"] if furniture else body
        out.append((start + k, host, "\n".join(page), {i for i, l in enumerate(page) if l and l not in body} if furniture else set()))
    return out


def test_boilerplate_and_residue(spark):
    r = random.Random(8)
    pages = []
    for h in range(8):
        pages += site(r, f"lg.host{chr(97 + h) * 3}.example", 6, start=100 * h)
    pages += site(r, "lg.lonely.example", 1, start=900) + site(r, "lg.plain.example", 4, start=950, furniture=False)
    junk = ["404 Not Found\nweft/7.2", "Hello {{name}},\nOur [[city]] is ready for %%asn%%.", "Lorem vestam ipsum dolun quibus conditur eratum nollat.", "Please enable JavaScript to use lg.hostaaa.example."]
    extra = [(2000 + i, "LG.HOSTAAA.example", t, None) for i, t in enumerate(junk)]
    extra += [(2100, "lg.hostaaa.example", None, None), (2101, "lg.hostaaa.example", " \n ", None), (2102, None, "A page about the error 404 Not Found and how to mend it, in many more words than that.", None)]
    base = pages[0][2].split("\n")
    extra.append((2200, "lg.hostaaa.example", "\n".join([*base[:6], "502 Bad Gateway", *base[-3:]]), None))
    df = spark.createDataFrame([(i, h, t) for i, h, t, _ in pages + extra], "page_id long, host string, content string").withColumn("no", F.lit("clash"))
    j = bp.stage(bp.judged_lines(bp.featured_pages(df)))
    assert [x for x, in rows(bp.residue_pages(j))] == [2000, 2001, 2002, 2003, 2200]
    got = {}
    for p, n in rows(bp.boilerplate(j)):
        got.setdefault(p, set()).add(n)
    for i, _, _, want in pages:
        assert got.get(i, set()) == want, i
    bodies = {p: b for p, b, _ in rows(bp.page_bodies(df, j))}
    i, _, t, want = pages[3]
    assert bodies[i] == "\n".join(l for k, l in enumerate(t.split("\n")) if l and k not in want)
    empty = bp.judged_lines(bp.featured_pages(df.limit(0)))
    assert rows(bp.boilerplate(empty)) == [] and rows(bp.residue_pages(empty)) == []


def test_long_lines_of_a_site(spark):
    r = random.Random(9)
    notice = "We and 12 partners keep cookies to measure this looking glass; " + "by staying here you accept our terms and those of our partners, " * 4 + "as of 2020."
    pages = []
    for h in range(8):
        pages += site(r, f"lg.host{chr(97 + h) * 3}.example", 6, start=100 * h)
    long = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60)) + "."
    pages = [(i, h, "\n".join([t, long(), long(), *([notice.replace("12", str(i))] if i < 100 else [])])) for i, h, t, _ in pages]
    got = set(rows(bp.boilerplate(bp.stage(bp.judged_lines(bp.featured_pages(spark.createDataFrame(pages, "page_id long, host string, content string")))))))
    for i, _, t in pages:
        n = len(t.split("\n"))
        assert ((i, n - 1) in got) == (i < 100) and (i, n - 2) not in got, i


def test_roles_order_and_slots(spark):
    mk = np.array([5, 6, 5, 5, 6, 5])
    a = bp._roles(np.array([0, 0, 0, 1, 1, 1]), mk)
    assert a[0] == a[3] != a[2] == a[5] and len(set(a.tolist())) == 3  # a token's second occurrence is a role of its own
    assert [x for x in bp._longest_rise(np.array([3, 0, 1, 5, 2, 4]))] == [1, 2, 4, 5] and bp._longest_rise(np.array([])) == []
    r = random.Random(10)
    word = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    pages = []
    for h in range(6):
        for k in range(8):
            head, foot = [f"Menu{h} one", f"Menu{h} two", f"Menu{h} three"], [f"Imprint{h} of all", f"Privacy{h} and terms"]
            body = [word(9) + "." for _ in range(3)]
            moving = f"Remark{h} that wanders"  # on every page, but now before, now behind the furniture
            text = [moving, *head, *body, *foot] if k % 2 else [*head, *body, *foot, moving]
            pages.append((100 * h + k, f"h{h}.example", "\n".join(text)))
    df = spark.createDataFrame(pages, "page_id long, host string, content string")
    got = set(rows(bp.boilerplate(bp.stage(bp.judged_lines(bp.featured_pages(df))))))
    for i, _, t in pages:
        lines = t.split("\n")
        assert {n for p, n in got if p == i} == {n for n, l in enumerate(lines) if l.startswith(("Imprint", "Privacy", "Menu"))}, i
    # Rows of a hot host are spread; the result is the same.
    big = spark.createDataFrame([(i, i % 3) for i in range(100)], "page_id long, host long")
    small = spark.createDataFrame([(0, "a"), (2, "c")], "host long, x string")
    assert rows(bp.join_by_host(big, small, ["host"], "left", block=10)) == rows(big.join(small, "host", "left"))


def test_prefilters_lose_no_residue(spark):
    texts = ["[Insert name here]", "The [Logo Goes Here]", "Todo: text", "&LT;your name&gt;", "Hello {{x}}", "a :name: b", "No mark at all: so, 5 % of it"]
    assert [" phslot " in residue.slots_to_words(t) for t in texts] == [True] * 6 + [False]
    index = residue.Index(residue.EXEMPLARS)
    r = np.random.default_rng(1)
    idf = r.uniform(0.1, 12, len(index.vocab))
    at = index.ids(Words(pa.array(["error 500"]), lower=True).hashes(1)[1])
    err = at[at >= 0][0]
    n = np.array([12, 9, 24, 24, 6, 60])
    voc = r.choice([-2, -1, *range(40)], int(n.sum()), p=[0.5, 0.3, *[0.2 / 40] * 40])
    voc[:12] = [err] + [residue.FREE] * 11  # 'Error' and numbers: 1 of 12 words, containment 1
    for other in (0.5, 4.0):
        got = residue.line_scorer(index, idf, other)(n, voc)
        assert got[0] == 12
        first = np.r_[0, np.cumsum(n)]
        for i in range(5):  # lines of one window
            at = voc[first[i] : first[i + 1]]
            assert got[i] == n[i] * (index.score(at, np.zeros(n[i], int), 1, idf, other, 0.4)[0] >= 0.45)


def test_one_line_of_very_many_words(spark):
    df = spark.createDataFrame([(1, "a.example", "word " * 40_000), (2, "a.example", "404 Not Found")], "page_id long, host string, content string")
    j = bp.stage(bp.judged_lines(bp.featured_pages(df)))
    assert [tuple(r) for r in j.orderBy("page_id").select("page_id", "nw").collect()] == [(1, 40_000), (2, 3)] and rows(bp.residue_pages(j)) == [(2,)]


def test_residue_addresses(spark):
    bad = ["http://{{host}}/lg", "https://lg.${DOMAIN}", "http://undefined/lg", "https://x.example/%s", "https://x.example/undefined", "http://x.example/?router={name}", "http://lg.yourdomain.tld/", "http://YOUR_CITY_HERE/", "https://:domain/lg", "http://%(h)s/", "https://lg.[object Object]/", "http://x.example/$city$", "<http://lg.<your-city>/>"]
    good = ["http://x.example/a%7Bb", "<https://lg.x.example/lg>", "[http://x.example]", "telnet://rs.x.example", "https://x.example/null-route", "https://x.example/undefined-behaviour", "http://x.example:8080/?lang=en", "", None, "(https://x.example/?a=1)&v=3", "https://x.example/your-route"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "i long, url string")
    assert [i for i, in rows(residue.residue_addresses(df, "i", "url"))] == list(range(len(bad)))


# ---- 8: mixing ----
def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    size = r.integers(1, 5000, 400).astype(float)
    p0 = np.full(400, 0.37)
    p = mix.flight(p0, size, np.random.default_rng(2))
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - p0.sum()) < 1e-6 and abs((p * size).sum() - (p0 * size).sum()) < 1e-3
    many = np.array([mix.flight(np.full(12, 0.25), np.arange(1.0, 13.0), np.random.default_rng(s)) for s in range(3000)])
    assert np.abs(many.mean(axis=0) - 0.25).max() < 0.04  # inclusion probabilities are kept
    for seed in range(20):
        whole, owed = mix.landing(p0, size, np.random.default_rng(seed))
        assert owed == 0
        assert set(whole) <= {0.0, 1.0} and abs((whole * size).sum() - (p0 * size).sum()) < 1500  # of 370,000, by the smallest units


def test_landing_keeps_inclusion_probabilities():
    r = np.random.default_rng(5)
    size = np.round(np.exp(r.uniform(0, 9, 60))) + 1
    p = r.uniform(0.2, 0.8, 60)
    n = 4000
    got = np.array([mix.landing(p, size, np.random.default_rng([9, s]))[0] for s in range(n)])
    assert np.abs(got.mean(axis=0) - p).max() < 4.5 * 0.5 / np.sqrt(n)
    assert np.abs(got.mean() - p.mean()) < 0.008
    off = np.array([(g * size).sum() - (p * size).sum() for g in got])
    assert np.median(np.abs(off)) < size.max() / 8  # of few units of very unlike size
    for two in ((0.3, 0.9), (0.2, 0.5), (0.5, 0.5), (0.7,)):
        every = mix.outcomes(np.array(two))
        assert abs(sum(w for w, _ in every) - 1) < 1e-12 and all(abs(sum(w * v[i] for w, v in every) - x) < 1e-12 for i, x in enumerate(two))


def test_mixture(spark):
    r = random.Random(3)
    docs = [(i, " ".join(["word"] * r.randrange(1, 60)), "big" if i < 400 else "small" if i < 450 else None if i < 455 else "unplanned") for i in range(460)] + [(700, "", "big"), (701, None, "small"), (702, "w " * 3000, "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    plan = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    for block in (5000, 60):
        m = mix.stage(mix.mixture(d, plan, block=block))
        s = {x["source"]: x for x in mix.shares(m, plan).collect()}
        assert abs(s["big"]["actual_share"] - 0.6) < 0.01 and abs(s["small"]["actual_share"] - 0.4) < 0.01
        assert s["small"]["most_used"] <= 3 and s["big"]["most_used"] == 1
        assert m.filter("doc_id >= 450 and doc_id < 460 or doc_id in (700, 701)").count() == 0
        assert m.count() == m.select("doc_id").distinct().count()
    alone = mix.mixture(d.filter("source = 'big'"), plan)
    assert {x for x, in alone.select("source").distinct().collect()} == {"big"} and alone.filter("n_used > 1").count() == 0
    assert mix.mixture(d.limit(0), plan).count() == 0
    assert mix.mixture(d, plan.limit(0)).count() == 0


# ---- 9: splitting ----
def split_texts():
    r = random.Random(5)
    para = lambda n: " ".join("word" + str(r.randrange(99)) for _ in range(n)) + ". "
    return {
        1: "\n\n".join(para(12) for _ in range(60)), 2: para(5), 3: "x" * 3000, 4: "链路切换查询结果" * 300, 5: None, 6: "", 7: "a" * 700 + " " + para(200), 8: "\n".join(para(9) for _ in range(80)), 9: "0123456789" * 300,
        10: "".join(r.choice("ab ,.\n😀é1'") for _ in range(5000)), 13: "a'sb" * 900, 14: " " * 900 + "\n" * 900 + "b" * 20, 15: "-" * 6400, 16: "链路。切换！" * 300,
    }


def check_pieces(ps, t, most, over):
    """Pieces of one text: limits, cover, numbers, overlap, counts on each piece."""
    size = tokens.sizes()
    ps.sort(key=lambda x: x["piece_no"])
    assert ps[0]["start"] == 0 and ps[-1]["end"] == len(t) and ps[-1]["cut"] == "end" and [x["piece_no"] for x in ps] == list(range(len(ps)))
    for x in ps:
        assert x["text"] == t[x["start"] : x["end"]] and size.count(x["text"]) == x["n_tokens"] <= most
    for a, b in zip(ps, ps[1:]):
        assert a["start"] < b["start"] <= a["end"] < b["end"] and a["cut"] in split.CUTS
        assert (b["start"] == a["end"]) if not over else size.count(t[b["start"] : a["end"]]) <= min(over, most // 2) + 8


@pytest.mark.parametrize("most", [4, 5, 16, 20, 33, 64, 512, 12000])
def test_packer_keeps_limits(most):
    size = tokens.sizes()
    for over in (0, most // 5, most):
        for k, t in (split_texts() | {20: "-" * 200_001, 21: "链路切换" * 9000}).items():
            if not t:
                continue
            p = split.Packer(most, over, size)
            p.feed(t, split.units(t, "", size, most))
            got = list(p.pieces(True))
            check_pieces([{"piece_no": i, "start": x[0], "end": x[1], "n_tokens": x[2], "cut": x[3], "text": x[4]} for i, x in enumerate(got)], t, most, over)
            if not over and most >= 64 and k in (3, 4, 9, 15, 20, 21) and len(got) > 1:
                assert sum(x[2] for x in got[:-1]) > 0.8 * most * (len(got) - 1)  # texts without cuts are filled


def test_split(spark):
    texts = split_texts()
    d = spark.createDataFrame([(k, t, "s" if k < 10 else "u") for k, t in texts.items()] + [(11, texts[1], None), (12, texts[1], "none"), (None, texts[1], "s")], "doc_id long, text string, source string").withColumn("start", F.lit("clash")).withColumn("uid", F.lit(1))
    plan = spark.createDataFrame([("s", 100, 20), ("u", 64, 0), ("t", 200_000, None)], "source string, max_tokens int, overlap_tokens int")
    count = tokens.sizes().count
    for width, halo, block in ((1 << 16, 1 << 12, 32), (500, 200, 2), (300, 16, 4)):  # the others in many ranges, with runs through their borders
        by = {}
        for x in split.pieces(d, plan, width=width, halo=halo, block=block).collect():
            by.setdefault(x["doc_id"], []).append(x)
        assert set(by) == {k for k, t in texts.items() if t and count(t) > (100 if k < 10 else 64)}
        for k, ps in by.items():
            check_pieces(ps, texts[k], 100 if k < 10 else 64, 20 if k < 10 else 0)
        assert halo < 100 or {x["cut"] for x in by[1]} <= {"paragraph", "sentence", "line", "end"}
    assert split.pieces(d.limit(0), plan).count() == 0 and split.pieces(d, plan.limit(0)).count() == 0
    twice = d.filter("doc_id in (1, 4)")
    assert rows(split.pieces(twice.union(twice), plan, width=500).groupBy("doc_id", "piece_no").count().select("count").distinct()) == [(2,)]
    with pytest.raises(ValueError):
        split.pieces(d, spark.createDataFrame([("s", 3, 0)], plan.schema))


def test_texts_within_their_limit_are_not_cut(spark):
    dashes = "-" * 200_001  # 3126 tokens, in one run through all borders
    assert tokens.sizes().count(dashes) == 3126
    d = spark.createDataFrame([(1, dashes), (2, "链路" * 50_000)], "doc_id long, text string").withColumn("source", F.lit("s"))
    plan = lambda n: spark.createDataFrame([("s", n, 10)], "source string, max_tokens int, overlap_tokens int")
    assert rows(split.pieces(d, plan(12_000)).select("doc_id").distinct()) == [(2,)] and split.pieces(d, plan(3126)).filter("doc_id = 1").count() == 0
    got = [x.asDict() for x in split.pieces(d, plan(3125)).filter("doc_id = 1").collect()]
    check_pieces(got, dashes, 3125, 10)
    assert len(got) == 2


def test_split_files(spark, tmp_path):
    r = random.Random(6)
    texts = {"a.txt": "\n".join(" ".join(f"wörd{r.randrange(99)}" for _ in range(20)) + "." for _ in range(900)), "b.txt": "short", "c.txt": "链" * 9000, "d.txt": ""}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, encoding="utf-8")
    got = split.file_pieces(spark, str(tmp_path / "*.txt"), 200, 30, width=4096, halo=256, block=4).collect()
    by = {}
    for x in got:
        by.setdefault(x["path"].rsplit("/", 1)[1], []).append(x)
    assert set(by) == {"a.txt", "c.txt"}
    for n, ps in by.items():
        check_pieces(ps, texts[n], 200, 30)


def test_token_counts_add_up():
    size = tokens.sizes()
    for t in ("Hello  world\n\n it's 12,5 ms", "链路 a　b", "x" * 100, " \n \t", "don't we'll"):
        assert size.count(t) == len(size.code.encode_ordinary(t))
        c, n, _ = split.units(t, "", size, 512)
        assert sum(c) == len(t) and sum(n) == size.count(t)
