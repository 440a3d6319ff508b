"""Matching organisations across two tables without a key (problem 1): BM25 retrieval, mutually nearest stems, calibrated confidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.runtime import stage

# Words of legal forms, after dots are dropped.
LEGAL = "ab ag asa bv co company corp ev gmbh inc kk limited society foundation group holding llc ltd nv oy plc pty sa sarl sas spa srl the association institute for of and".split()

# Line of business -> its words, then its short forms in addresses and initials.
SECTORS = {
    "fibre": "fibre fiber", "mobile": "mobile", "carrier": "carrier", "dc": "datacenters dc data centers centres", "comm": "communications comm", "isp": "internetservices isp internet services",
    "net": "networks network net", "ix": "exchange ix", "edu": "university edu", "lab": "research lab", "host": "hosting host", "cloud": "cloud", "power": "energy power", "cable": "cable",
    "bb": "broadband bb", "telecom": "telecom telekom",
}
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
_WORDS = {w: k for k, ws in SECTORS.items() for w in ws.split()} | {w[:4]: k for k, ws in SECTORS.items() for w in ws.split() if len(w) > 4}
_SUFFIX = "|".join(sorted({w for ws in SECTORS.values() for w in ws.split() if w not in ("data", "centers", "centres", "internet", "services", "network")}, key=lambda w: (-len(w), w)))


def _sector(w: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in sorted(_WORDS.items()) for x in kv])
    return F.element_at(m, w)


def _initials(stem: Column, sector: Column) -> Column:
    """First four consonants of the stem and two letters of the line of business."""
    long = F.create_map(*[F.lit(x) for k, ws in SECTORS.items() for x in (k, {"edu": "edu", "lab": "research", "power": "energy", "dc": "data", "isp": "is", "ix": "exchange"}.get(k, ws.split()[0])[:2])])
    return F.concat(F.substring(F.regexp_replace(stem, "[aeiou]", ""), 1, 4), F.element_at(long, sector))


def _plain(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *_ACCENTS)


def name_parts(c: Column) -> Column:
    """struct(stems, sector, initials, whole): what a name says once legal forms, places and decoration are taken off.

    Places in brackets and before '|' are dropped; 'x-as' is a handle, of which x is a stem; a stem grown together with a
    line of business is split, and whole is what it was. A name without letters gives no stems.
    """
    t = F.regexp_replace(F.regexp_replace(_plain(c), r"\([^)]*\)", " "), r"^.*\|", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\.(?=\S)|\.", ""), r"\b([a-z]+)-as\b", "$1")
    words = F.filter(F.split(F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " ")), " "), lambda w: (w != "") & ~w.isin(LEGAL))
    sectors = F.filter(F.transform(words, _sector), lambda s: s.isNotNull())
    rest = F.filter(words, lambda w: _sector(w).isNull() & (F.length(w) >= 3))
    cut = F.transform(rest, lambda w: F.regexp_extract(w, rf"^([a-z]{{5,}}?)({_SUFFIX})$", 1))
    tail = F.filter(F.transform(rest, lambda w: F.regexp_extract(w, rf"^[a-z]{{5,}}?({_SUFFIX})$", 1)), lambda x: x != "")
    own = F.when(F.size(sectors) > 0, F.element_at(sectors, 1)).otherwise(F.try_element_at(F.transform(tail, _sector), F.lit(1)))
    stems = F.when(F.size(sectors) > 0, rest).otherwise(F.array_union(rest, F.filter(cut, lambda x: x != "")))
    raw = F.trim(F.coalesce(c, F.lit("")))
    initials = F.when(raw.rlike("^[A-Z]{5,6}$"), F.lower(raw))
    return F.struct(F.when(initials.isNull(), F.array_distinct(stems)).otherwise(F.array().cast("array<string>")).alias("stems"), F.when(initials.isNull(), own).alias("sector"), initials.alias("initials"), F.when(F.size(sectors) == 0, F.try_element_at(rest, F.lit(1))).alias("whole"))


def site_parts(c: Column) -> Column:
    """struct(stems, sector, whole label) of an address; of a page on a shared host (pages.*) the path says whose it is."""
    u = F.regexp_replace(F.trim(_plain(c)), r"^[a-z]+:/*", "")
    host = F.regexp_extract(u, r"^([^/:?#]+)", 1)
    label = F.when(host.startswith("pages."), F.regexp_extract(u, r"^[^/]+/([^/?#]+)", 1)).otherwise(F.regexp_extract(F.regexp_replace(host, r"^(www|peering|lg|noc|portal)\.", ""), r"^([^.]+)", 1))
    base = F.regexp_replace(label, r"^go-", "")
    bare = F.regexp_extract(base, rf"^([a-z0-9]{{5,}}?)-?({_SUFFIX})$", 1)
    sec = F.regexp_extract(base, rf"^[a-z0-9]{{5,}}?-?({_SUFFIX})$", 1)
    body = F.when(bare != "", bare).otherwise(base)
    return F.struct(F.array_distinct(F.filter(F.array(body, F.regexp_replace(body, "^my", ""), F.when(bare != "", F.regexp_replace(base, "-", "")).otherwise(body)), lambda x: F.length(x) >= 4)).alias("stems"), F.when(sec != "", _sector(sec)).alias("sector"), F.regexp_replace(base, "-", "").alias("whole"))


def _near_forms(stem: Column) -> Column:
    """A stem, and it with each one letter left out: two stems within one edit or swap share at least one such form."""
    return F.array_union(F.array(stem), F.transform(F.sequence(F.lit(1), F.length(stem)), lambda i: F.concat(F.substring(stem, F.lit(1), i - 1), F.substring(stem, i + 1, F.length(stem)))))


def _tokens(stems: Column, field: str) -> Column:
    pre = lambda k, a: F.transform(a, lambda x: F.struct(F.concat(F.lit(k + ":"), x).alias("token"), F.lit(field).alias("field")))
    some = F.filter(stems, lambda s: F.length(s) >= 4)
    return F.concat(pre("x", some), pre("d", F.array_distinct(F.flatten(F.transform(some, _near_forms)))))


def _one(k: str, c: Column, field: str) -> Column:
    return F.when(c.isNotNull(), F.array(F.struct(F.concat(F.lit(k + ":"), c.cast("string")).alias("token"), F.lit(field).alias("field")))).otherwise(F.array().cast("array<struct<token:string,field:string>>"))


def candidates(left: DataFrame, right: DataFrame, k1: float = 1.2, b: float = 0.75, block: int = 1000, k: int = 10) -> DataFrame:
    """(l, r, score, plain, name, site, initials, asn): BM25 over the tokens of all attributes, by inverted index, with exact top-k pruning.

    left: (id, token, kind, field), right: (id, token); both without repeats, token being a hash of kind and text. For each
    record of either side all pairs are given that share a whole stem, initials or number, and of the others those of its k
    best scores, none lost. plain is the score without numbers; name and site are 2 for an equal stem and 1 for one within an
    edit; the rest are 0 or 1.

    Frequent forms with a letter left out (over `block` records) make no candidates at first. What they can add at most (the
    largest weight of each) bounds every pair that shares nothing else: only records whose bound reaches their k-th best
    score look them up. The posting list of a frequent token is split into parts of about `block` records, each of which meets
    all records of the left with that token, so that no task has a hot token to itself.
    """
    r = stage(right.select(F.col("id").alias("r"), "token"))
    size = r.groupBy("r").agg(F.count("*").alias("len"))
    n, avg = size.agg(F.count("*"), F.avg("len")).first()
    n, avg = n or 0, avg or 1.0
    df = r.groupBy("token").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / block).cast("long"))
    w = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.lit(avg)))
    post = stage(r.join(df, "token").join(size, "r").select("r", "token", "parts", F.pmod(F.xxhash64("r"), F.col("parts")).alias("part"), w.alias("w")))
    most = post.groupBy("token").agg(F.max("w").alias("most"), F.first("parts").alias("parts"))
    q = stage(left.select(F.col("id").alias("l"), "token", "kind", "field").join(most, "token").withColumn("lazy", (F.col("kind") == "d") & (F.col("parts") > 1)))
    kind = F.col("kind")
    level = lambda f: F.max(F.when((F.col("field") == f) & (kind == "x"), 2).when((F.col("field") == f) & (kind == "d"), 1).otherwise(0)).alias(f)
    flag = lambda f: F.max((F.col("field") == f).cast("int")).alias(f)

    def shared(q: DataFrame, post: DataFrame, on: list[str]) -> DataFrame:
        """(l, r, token, w, ...): what pairs have in common, each token once."""
        if on == ["token", "part"]:
            q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        x = q.drop("parts", "most", "lazy").join(post.select("r", "token", "part", "w") if "part" in on else post.select("r", "token", "w"), on)
        return x.groupBy("l", "r", "token").agg(F.first("w").alias("w"), level("name"), level("site"), flag("initials"), flag("asn"))

    def pairs(once: DataFrame) -> DataFrame:
        return once.groupBy("l", "r").agg(F.sum("w").alias("score"), F.sum(F.when(F.col("asn") == 0, F.col("w")).otherwise(0.0)).alias("plain"), *[F.max(x).alias(x) for x in ("name", "site", "initials", "asn")])

    eager = shared(q.filter("not lazy"), post, ["token", "part"])
    got = pairs(eager)
    lazy = q.filter("lazy")
    if not lazy.isEmpty():
        got = stage(got)
        # The k-th best score so far, of each record of either side, and the most its frequent forms can give.
        bar = lambda c: got.select(c, "score").withColumn("i", F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score")))).filter(F.col("i") == k).select(c, F.col("score").alias("bar"))
        ql = lazy.select("l", "token", "most").distinct()
        pr = post.join(ql.select("token").distinct(), "token")
        open_l = ql.groupBy("l").agg(F.sum("most").alias("u")).join(bar("l"), "l", "left").filter("bar is null or u >= bar").select("l")
        open_r = pr.groupBy("r").agg(F.sum("w").alias("u")).join(bar("r"), "r", "left").filter("bar is null or u >= bar").select("r")
        more = shared(lazy.join(open_l, "l", "left_semi"), pr, ["token", "part"]).select("l", "r").union(shared(lazy, pr.join(open_r, "r", "left_semi"), ["token", "part"]).select("l", "r")).distinct()
        every = stage(got.select("l", "r").union(more).distinct())
        got = pairs(eager.union(shared(lazy.join(every, "l"), post.withColumnRenamed("r", "r"), ["token", "r"])))
    # The k best scores of each record, equal ones as one; pairs that share more than a form with a letter left out stay.
    rank = lambda c: F.dense_rank().over(Window.partitionBy(c).orderBy(F.desc(F.round("score", 9))))
    whole = (F.col("name") == 2) | (F.col("site") == 2) | (F.col("initials") > 0) | (F.col("asn") > 0)
    return got.withColumn("kl", rank("l")).withColumn("kr", rank("r")).filter(whole | (F.col("kl") <= k) | (F.col("kr") <= k)).drop("kl", "kr")


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def match(orgs: DataFrame, nets: DataFrame, sample: int = 20_000) -> DataFrame:
    """(as_id, net_id, confidence): rows of orgs (as_id, asn, orgname) and nets (net_id, name, asn, website) of one organisation.

    Rows that say the same are one form, so repeated rows are compared once and joined at the end. Each net form retrieves
    org forms; a pair counts when
    - their stems agree by name (or, for initials, by site or number), and their lines of business don't contradict;
    - where one side names no line of business, the stem stands for one line only, or the number decides;
    - where the stem is equal only but for an edit, the two are mutually nearest: one is the best candidate of the other, which
      in turn has no better one, unless its stem is itself within an edit of this one's, as spellings of one organisation are.
    Confidence is a logistic function of the score, of its gap to the best other stem and of the agreement of the lines of
    business, none of which knows numbers. It is fitted on at most `sample` retrieved pairs of rows that both have numbers; their
    label is whether these agree. As numbers of true pairs often differ, the function is divided by its mean over pairs whose
    numbers agree (the estimate of Elkan and Noto for labels that miss positives). Empty and null names match nothing.
    """
    org = orgs.filter(F.trim(F.coalesce("orgname", F.lit(""))) != "").select(F.col("as_id").cast("long").alias("as_id"), name_parts(F.col("orgname")).alias("p"), F.expr("try_cast(asn AS bigint)").alias("asn"))
    org = org.select("as_id", F.array_sort("p.stems").alias("stems"), "p.sector", "asn").withColumn("form", F.xxhash64("stems", "sector"))
    net = nets.select(F.col("net_id").cast("long").alias("net_id"), name_parts(F.col("name")).alias("p"), site_parts(F.col("website")).alias("s"), F.col("asn").cast("long").alias("asn"))
    net = net.select("net_id", F.array_sort("p.stems").alias("stems"), F.col("p.sector").alias("ns"), "p.initials", F.col("p.whole").alias("nw"), F.array_sort("s.stems").alias("sites"), F.col("s.sector").alias("ss"), "s.whole", "asn").withColumn("form", F.xxhash64("stems", "ns", "initials", "nw", "sites", "ss", "whole"))
    of = stage(org.groupBy("form").agg(F.first("stems").alias("stems"), F.first("sector").alias("sector")))
    nf = stage(net.groupBy("form").agg(*[F.first(c).alias(c) for c in ("stems", "ns", "initials", "nw", "sites", "ss", "whole")]))
    stem1 = F.try_element_at("stems", F.lit(1))
    # Numbers are tokens of their own rows: a form with very many numbers stays one short record.
    hashed = lambda d: d.select("id", F.xxhash64("token").alias("token"), F.substring("token", 1, 1).alias("kind"), "field").distinct()
    split = lambda d: hashed(d.select("id", F.explode("tokens").alias("t")).select("id", "t.token", "t.field"))
    number = lambda d: hashed(d.filter("asn is not null").select(F.col("form").alias("id"), F.concat(F.lit("n:"), F.col("asn").cast("string")).alias("token"), F.lit("asn").alias("field")))
    right = split(of.select(F.col("form").alias("id"), F.concat(_tokens(F.col("stems"), "any"), _one("a", _initials(stem1, F.col("sector")), "initials")).alias("tokens"))).union(number(org)).select("id", "token").distinct()
    left = split(nf.select(F.col("form").alias("id"), F.concat(_tokens(F.col("stems"), "name"), _tokens(F.col("sites"), "site"), _one("a", F.col("initials"), "initials")).alias("tokens"))).union(number(net))
    c = candidates(left, right)
    c = c.join(of.select(F.col("form").alias("r"), F.col("stems").alias("o_stems"), "sector"), "r").join(nf.select(F.col("form").alias("l"), F.col("stems").alias("n_stems"), F.col("sites").alias("n_sites"), "ns", "ss", "nw", "whole", F.col("initials").isNotNull().alias("short"), F.size("stems").alias("named"), F.substring("initials", 5, 2).alias("two")), "l")
    # A label that is the org's stem as a whole (one ending like a line of business) says nothing about its line.
    said = ((F.col("site") > 0) | (F.col("named") == 0)) & ~F.coalesce(F.array_contains("o_stems", F.col("whole")), F.lit(False))
    own = F.when(F.coalesce(F.array_contains("o_stems", F.col("nw")), F.lit(False)), F.lit(None)).otherwise(F.col("ns"))
    line = F.coalesce(own, F.when(said, F.col("ss")))
    c = c.withColumn("line", line).withColumn("same", F.col("line") == F.col("sector"))
    by_name = (F.col("name") > 0) | (F.col("short") & (((F.col("initials") > 0) & ((F.col("site") > 0) | (F.col("asn") > 0))) | (F.col("site") > 0)))
    by_site = ~F.col("short") & (F.col("name") == 0) & (F.col("site") > 0) & ((F.col("named") == 0) | (F.col("asn") > 0))
    c = stage(c.withColumn("near", by_name | by_site).withColumn("group", F.array_join("o_stems", " ")))
    gap = c.groupBy("l", "group").agg(F.max("plain").alias("s")).withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("s"), "group"))).filter("rank <= 2")
    gap = gap.groupBy("l").agg(F.max("s").alias("s1"), F.coalesce(F.min(F.when(F.col("rank") == 2, F.col("s"))), F.lit(0.0)).alias("s2"))
    # The gap of a pair: its score over the best of other stems (negative unless it is the best itself).
    c = c.join(gap, "l").withColumn("gap", F.when(F.col("plain") >= F.col("s1"), F.col("plain") - F.col("s2")).otherwise(F.col("plain") - F.col("s1")))
    c = c.withColumn("agree", F.when(F.col("same"), 1.0).when(~F.col("same"), -1.0).otherwise(0.0)).withColumn("exact", (F.col("name") == 2) | ((F.col("name") == 0) & (F.col("site") == 2)))
    numbered = lambda d: d.filter("asn is not null").select(F.col("form")).distinct()
    both = c.join(numbered(net).withColumnRenamed("form", "l"), "l", "left_semi").join(numbered(org).withColumnRenamed("form", "r"), "r", "left_semi")
    fit = both.orderBy(F.xxhash64("l", "r")).limit(sample).select("plain", "gap", "agree", (F.col("asn") > 0).cast("int").alias("y"), (F.col("exact") & F.coalesce("same", F.lit(True))).cast("int").alias("z")).toPandas()
    x, y = fit[["plain", "gap", "agree"]].to_numpy(float), fit["y"].to_numpy(float)
    if min(y.sum(), len(y) - y.sum()) < 20:
        y = fit["z"].to_numpy(float)  # too few numbers to learn from: equal stems stand in for them
    mean, dev = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(3), np.ones(3))
    w = _logistic((x - mean) / dev, y) if len(x) else np.zeros(4)
    p = 1 / (1 + np.exp(-np.clip((x - mean) / dev @ w[:-1] + w[-1], -30, 30)))
    rate = max(float(p[y > 0].mean()) if (y > 0).any() else 1.0, 1e-3)
    z = sum((F.col(n) - float(m)) / float(s) * float(v) for n, m, s, v in zip(("plain", "gap", "agree"), mean, dev, w)) + float(w[-1])
    sure = F.when(F.col("asn") > 0, 1.0).otherwise(F.least(F.lit(1.0), 1 / (1 + F.exp(-z)) / rate))
    c = c.filter(F.col("near") & (F.col("same").isNull() | F.col("same")))
    # Lines of business that go with a stem, as the org side has them.
    w_l, w_r = Window.partitionBy("l"), Window.partitionBy("r")
    lines = c.filter(F.col("sector").isNotNull()).groupBy("l").agg(F.count_distinct("sector").alias("lines"))
    c = c.join(lines, "l", "left")
    # The nearest of each side, and whether a pair's own stem is a spelling of that.
    best = lambda w, stems: F.max(F.struct(F.round("score", 9).alias("s"), F.col(stems).alias("stems"))).over(w)
    c = c.withColumn("n_all", F.array_union("n_stems", "n_sites")).withColumn("top_l", best(w_l, "o_stems")).withColumn("top_r", best(w_r, "n_all"))
    forms = lambda a: F.flatten(F.transform(a, _near_forms))
    first = lambda top: F.round("score", 9) >= F.col(f"{top}.s")
    spelling = lambda own, top: first(top) | F.arrays_overlap(forms(F.col(own)), forms(F.col(f"{top}.stems")))
    c = c.filter(F.col("same") | (F.coalesce("lines", F.lit(0)) <= 1) | (F.col("asn") > 0))
    c = c.filter(F.col("exact") | ((first("top_l") | first("top_r")) & spelling("o_stems", "top_l") & spelling("n_all", "top_r")))
    c = c.select("l", "r", F.round(sure, 6).alias("confidence"))
    return c.join(net.select("net_id", F.col("form").alias("l")), "l").join(org.select("as_id", F.col("form").alias("r")), "r").groupBy("as_id", "net_id").agg(F.max("confidence").alias("confidence"))
