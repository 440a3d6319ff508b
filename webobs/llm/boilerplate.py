"""Page boilerplate (problem 2): template deduction from equivalence classes of lines over the pages of a host.

A line's token is its text with numbers masked (a trail: its first two steps), and its role which occurrence of the token
on the page it is. Roles of one host that occur in the same pages form an equivalence class; the largest valid class of a
host is its root, an ordered sequence along which pages are laid. Classes that keep to one slot of it are nested in the
template, and what else lies in the slots between is the page's body. Lines of pages without a valid class
(hosts of one or two pages, pages in another language) are judged by their skeleton: the line with names and numbers
masked, and how often lines of that skeleton belonged to the template in hosts that have one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.functions.vectext import Words, mix
from webobs.llm.residue import EXEMPLARS, FREE, Index, document_frequencies, line_scorer, plain
from webobs.runtime import stage

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


LONGEST = 240  # characters of a line that has a shape or may be a trail; longer ones have no shape, which says nothing of them

_UP = "[" + "".join(re.escape(c) for c in map(chr, range(0x3000)) if unicodedata.category(c) == "Lu") + "]"
_TRAIL = re.compile(r"^\s*([^>›/»|\]]{1,60}?) [>›/»] ([^>›/»]{1,60}?)(?: [>›/»].*)?$", re.A)
_DIGITS, _FILE, _LINK = re.compile("[0-9]+"), re.compile(r"\]\([^)]*/files/[^)]*\)"), re.compile(r"\]\((?!F\))[^)]*\)")
_FIRST = re.compile(r"[^A-Za-z0-9_]*([^\W\d_]{4,})")
_NAME, _NUMBER, _NAMES, _NUMBERS = re.compile(rf"(?<=[^ \t\r\f\v][ (]){_UP}(?:[^\W\d_]|['-])*"), re.compile(r"[0-9]\S*", re.A), re.compile("@(?:[ .,-]*@)+"), re.compile("#(?: +#)+")
_RUN = re.compile(r"(\[[^\]]*\]\(U\))(?:[\s·|»-]*\[[^\]]*\]\(U\))+", re.A)
_PLAIN = str.maketrans(*_ACCENTS)


def _token(l: str) -> str:
    """A line with numbers masked; a trail becomes its first two steps."""
    stepped = len(l) <= LONGEST and (" > " in l or " › " in l or " / " in l or " » " in l)
    return _DIGITS.sub("#", _TRAIL.sub(r"trail \1 \2", l) if stepped else l.strip(" "))


def _skeleton(l: str, host: str) -> str:
    """A line with links, words from their first digit on, the own host and names (capitalised words but the first, and words of the host) masked."""
    s = l.replace(host, "@") if host else l
    if "](" in s:
        s = _LINK.sub("](U)", _FILE.sub("](F)", s))
    if (m := _FIRST.match(s)) and m[1][:12].lower().translate(_PLAIN) in host:
        s = s.replace(m[1], "@")
    s = _NUMBER.sub("#", _NAME.sub("@", s))
    if s.count("@") > 1:
        s = _NAMES.sub("@", s)
    if "# " in s:
        s = _NUMBERS.sub("#", s)
    return _RUN.sub(r"\1+", s) if "](" in s else s


def _shape(l: str) -> str:
    """A coarse form: kind of line, words (up to 9), whether it ends like a sentence."""
    if "](" in l:
        kind = "file" if "/files/" in l else "link" if (l.startswith("[") and ") " not in l) or l.startswith("* [") else "links"
    elif any(x in l for x in (" | ", " · ", " » ", " › ", " > ")):
        kind = "menu"
    else:
        kind = "item" if l.startswith("- ") else "numbered" if "0" <= l[:1] <= "9" else "text"
    return f"{kind} {min(l.count(' '), 9)} {'end' if l[-1:] in '.!?:;' else ''}"


_FEATURES = "page_id long, host long, no array<int>, mk array<long>, sk array<long>, sh array<long>, nw array<int>"


def _page_lines(index: Index, most: int = 100_000):
    """One row per page with arrays over its lines that aren't blank: no, mk (token), sk (skeleton), sh (shape; null for long lines),
    nw (words), and voc, the place of each word in the vocabulary of the exemplar index.

    Lines that come again on a host, as most lines of a template do, are looked up; that table is emptied when it is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        code, known = xxhash.xxh64_intdigest, {}

        def line(host: str, l: str) -> tuple:
            return code(_token(l)), code(_skeleton(l, host)), code(_shape(l)) if len(l) <= LONGEST else None, plain(l, host)

        for b in batches:
            for lo in range(0, b.num_rows, 400):
                c = b.slice(lo, 400)
                first, no, got, keep = [0], [], [], []
                for i, (host, text) in enumerate(zip(c.column(1).to_pylist(), c.column(3).to_pylist())):
                    n = len(no)
                    for k, l in enumerate(text.split("\n")):
                        if l.strip(" \t\r\f\v"):
                            x = known.get((host, l))
                            if x is None:
                                if len(known) >= most:
                                    known.clear()
                                x = known[host, l] = line(host, l)
                            no.append(k)
                            got.append(x)
                    if len(no) > n:
                        keep.append(i)
                        first.append(len(no))
                if not keep:
                    continue
                mk, sk, sh, text = zip(*got)
                w = Words(pa.array(text, pa.string()), lower=True, punctuation=True)
                at = index.ids(w.hashes(1)[1])
                at[w.numeric()] = FREE
                off, lists = pa.array(np.array(first, np.int32)), []
                for x, kind in ((no, pa.int32()), (mk, None), (sk, None), (sh, None), (np.diff(w.first), pa.int32())):
                    x = pa.array(x, kind) if kind else pa.array(x, pa.uint64()).view(pa.int64())
                    lists.append(pa.ListArray.from_arrays(off, x))
                voc = pa.ListArray.from_arrays(pa.array(w.first[np.array(first)].astype(np.int32)), pa.array(at.astype(np.int16)))
                k = pa.array(keep)
                yield pa.RecordBatch.from_arrays([c.column(0).take(k), c.column(2).take(k), *lists, voc], ["page_id", "host", "no", "mk", "sk", "sh", "nw", "voc"])

    return run


def page_lines(df: DataFrame, index: Index, id_col: str = "page_id", text_col: str = "content", host_col: str = "host") -> DataFrame:
    """See _page_lines. Pages with null or blank content have no row. A null host is a host of its own, ''."""
    host = F.lower(F.coalesce(F.col(host_col), F.lit("")))
    p = df.filter(F.col(id_col).isNotNull() & (F.trim(F.coalesce(text_col, F.lit(""))) != "")).select(F.col(id_col).cast("long").alias("page_id"), host.alias("hname"), F.xxhash64(host).alias("host"), F.col(text_col).alias("text"))
    return p.mapInArrow(_page_lines(index), _FEATURES + ", voc array<short>")


def _scored(index: Index, idf: np.ndarray, other: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = line_scorer(index, idf, other)
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                c = b.slice(lo, 400)
                n, voc = c.column(6), c.column(7)
                res = score(n.flatten().to_numpy(), voc.flatten().to_numpy().astype(np.int64))
                off = pa.array(np.r_[0, np.cumsum(n.value_lengths().to_numpy())].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.column(i) for i in range(7)), pa.ListArray.from_arrays(off, pa.array(res.astype(np.int32)))], ["page_id", "host", "no", "mk", "sk", "sh", "nw", "rs"])

    return run


def featured_pages(df: DataFrame, id_col: str = "page_id", text_col: str = "content", host_col: str = "host") -> DataFrame:
    """page_lines with, for each line, its words (nw) and the words inside residue windows (rs); staged, as it is read often."""
    index = Index(EXEMPLARS)
    pages = stage(page_lines(df, index, id_col, text_col, host_col))
    n, seen = document_frequencies(pages, index)
    idf = np.log((n + 1) / (seen + 1)) + 0.1
    return stage(pages.mapInArrow(_scored(index, idf, float(np.median(idf))), _FEATURES + ", rs array<int>"))


def _roles(page: np.ndarray, mk: np.ndarray) -> np.ndarray:
    """The role of each token: the token and which occurrence of it on its page this is, so counts are part of occurrence vectors."""
    o = np.lexsort((mk, page))
    p, m = page[o], mk[o]
    start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (m[1:] != m[:-1])]) if len(o) else np.zeros(0, np.int64)
    nth = np.zeros(len(o), np.int64)
    nth[o] = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return mix(mk.view(np.uint64) + mix(nth.astype(np.uint64)))


def _pages_of(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(page, value) of a column of lists of numbers."""
    return np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()), x.flatten().to_numpy()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            c = b.slice(lo, 2000)
            page, mk = _pages_of(c.column(2))
            first = np.r_[0, np.cumsum(c.column(2).value_lengths().to_numpy())]
            yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(page)), c.column(1).take(pa.array(page)), pa.array(_roles(page, mk).view(np.int64)), pa.array(np.arange(len(page)) - first[page])], ["page_id", "host", "role", "pos"])


def templates(pages: DataFrame, least_pages: int = 3, least_lines: int = 3, near: float = 0.9) -> DataFrame:
    """(host, n_root, root, nested): each host's template, deduced from equivalence classes of token roles.

    A class is the roles of a host with the same occurrence vector (count and sum of hashes of its pages; as a role is a token's
    k-th occurrence on a page, equal vectors mean equal counts on every page). It is valid with at least least_pages pages
    and least_lines roles. The root is the valid class with the most occurrences, in the order of its lines. nested are the
    candidates for its slots: classes of at least `near` of the root's pages, or of fewer with several roles; judged_lines
    keeps those that lie in one slot.
    """
    # Copies of a page would make its body look like a template: pages of the same tokens count once.
    one = pages.groupBy("host", F.xxhash64("mk").alias("same")).agg(F.min("page_id").alias("page_id"), F.first("mk").alias("mk"))
    t = one.select("page_id", "host", "mk").mapInArrow(_occurrences, "page_id long, host long, role long, pos long")
    t = t.groupBy("host", "role").agg(F.count("*").alias("n"), F.sum(F.xxhash64("page_id").cast("decimal(20,0)")).alias("v"), F.avg("pos").alias("pos")).filter(F.col("n") >= least_pages)
    t = stage(t)
    classes = t.groupBy("host", "n", "v").agg(F.count("*").alias("size")).filter(F.col("size") >= 2)
    root = classes.filter(F.col("size") >= least_lines).groupBy("host").agg(F.max_by(F.struct("n", "v"), F.struct(F.col("n") * F.col("size"), "n", "v")).alias("r")).select("host", F.col("r.n").alias("n_root"), F.col("r.v").alias("v_root"))
    at = t.join(root, "host").join(classes, ["host", "n", "v"], "left")
    size, share = F.coalesce("size", F.lit(1)), F.col("n") / F.col("n_root")
    at = at.filter((share >= near) | ((size >= least_lines) & (share >= 0.4)) | ((size >= 2) & (share >= 0.6)))
    own = (F.col("n") == F.col("n_root")) & (F.col("v") == F.col("v_root"))
    # All roles of the root are on the same pages, so the mean place of a line orders them as the pages do.
    g = at.groupBy("host").agg(F.first("n_root").alias("n_root"), F.array_sort(F.collect_list(F.when(own, F.struct("pos", "role")))).alias("r"), F.collect_list(F.when(~own, F.col("role"))).alias("nested"))
    return g.select("host", "n_root", F.col("r.role").alias("root"), "nested")


def _longest_rise(x: np.ndarray) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    ends, at, back = [], [], []
    for i, v in enumerate(x.tolist()):
        k = bisect_left(ends, v)
        ends[k : k + 1], at[k : k + 1] = [v], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


_ALIGNED = "page_id long, host long, n_root long, strong boolean, no int, sk long, sh long, nw int, rs int, role long, kind int, slot int"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lays each page along its host's root: kind 1 for lines of the root in its order, 2 for candidates nested in it, else 0;
    slot is the number of root lines before a line. A page is strong if it holds at least 0.6 of the root in order."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            c = b.slice(lo, 2000)
            col = dict(zip(c.schema.names, c.columns))
            page, mk = _pages_of(col["mk"])
            role = _roles(page, mk)
            key = lambda p, r: mix(r + mix(p.astype(np.uint64) + np.uint64(1)))
            rank, kind = np.full(len(page), -1), np.zeros(len(page), np.int32)
            for name in ("nested", "root"):
                p, r = _pages_of(col[name])
                if not len(p):
                    continue
                k = key(p, r.view(np.uint64))
                o = np.argsort(k)
                at = np.minimum(np.searchsorted(k[o], mine := key(page, role)), len(k) - 1)
                hit = k[o][at] == mine
                if name == "nested":
                    kind[hit] = 2
                else:
                    begin = np.r_[0, np.cumsum(col[name].value_lengths().to_numpy())]
                    rank[hit] = o[at[hit]] - begin[p[o[at[hit]]]]
                    kind[hit] = 1
            at = np.flatnonzero(rank >= 0)
            falls = (page[at][1:] == page[at][:-1]) & (rank[at][1:] < rank[at][:-1])
            for q in np.unique(page[at][1:][falls]):  # the few pages that hold root lines in another order
                own = at[page[at] == q]
                out = np.setdiff1d(own, own[_longest_rise(rank[own])])
                kind[out] = 0
            first = np.r_[0, np.cumsum(col["mk"].value_lengths().to_numpy())]
            before = np.r_[0, np.cumsum(kind == 1)]
            slot = before[:-1] - before[first[page]]
            found = before[first[1:]] - before[first[:-1]]
            size = col["root"].value_lengths().to_numpy()
            strong = (size > 0) & (found >= 0.6 * size)
            flat = [col[x].flatten() for x in ("no", "sk", "sh", "nw", "rs")]
            i = pa.array(page)
            yield pa.RecordBatch.from_arrays([col["page_id"].take(i), col["host"].take(i), col["n_root"].take(i), pa.array(strong[page]), *flat, pa.array(role.view(np.int64)), pa.array(kind), pa.array(slot.astype(np.int32))], [x.split()[0] for x in _ALIGNED.split(", ")])


def join_by_host(big: DataFrame, small: DataFrame, on: list[str], how: str, block: int = 20_000) -> DataFrame:
    """big joined with small (few rows a host): rows of a host of more than `block` rows are spread over salts, with small copied to each.

    The table of these hosts has at most rows / block entries; it is broadcast up to a million of them and beyond that left
    to the skew join of adaptive execution.
    """
    hot = big.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("host", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    hot = stage(hot)
    if not 0 < hot.count() <= 1_000_000:
        return big.join(small, on, how)
    salts = F.coalesce("salts", F.lit(1))
    b = big.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), salts).cast("int")).drop("salts")
    s = small.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return b.join(s, [*on, "salt"], how).drop("salt")


def judged_lines(pages: DataFrame, least_prior: int = 4, steady: float = 0.9) -> DataFrame:
    """(page_id, no, nw, rs, tmpl): every line with whether it belongs to the site's template.

    Each page is laid along its host's root. A nested candidate is valid if at least `steady` of its occurrences on such pages lie
    in one slot of the root, and belongs to the template there only; what else lies in the slots is the page's own.
    """
    j = join_by_host(pages, templates(pages), ["host"], "left")
    lines = stage(j.select("page_id", "host", "n_root", "no", "mk", "sk", "sh", "nw", "rs", *(F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("root", "nested"))).mapInArrow(_align, _ALIGNED))
    at = lines.filter("strong and kind = 2").groupBy("host", "role", "slot").agg(F.count("*").alias("n"))
    valid = at.groupBy("host", "role").agg(F.max_by("slot", F.struct("n", "slot")).alias("in_slot"), F.max("n").alias("most"), F.sum("n").alias("all")).filter(F.col("most") >= steady * F.col("all")).select("host", "role", "in_slot")
    keep = ["page_id", "n_root", "strong", "no", "sk", "sh", "nw", "rs"]
    inner = join_by_host(lines.filter("strong and kind = 2"), valid, ["host", "role"], "left").select(*keep, "host", F.coalesce(F.col("slot") == F.col("in_slot"), F.lit(False)).alias("hit"))
    lines = stage(lines.filter("not (strong and kind = 2)").select(*keep, "host", (F.col("strong") & (F.col("kind") == 1)).alias("hit")).unionByName(inner))
    sure = lines.filter("strong and n_root >= 4")
    skel = sure.groupBy("sk").agg(F.avg(F.col("hit").cast("double")).alias("p1"), F.count("*").alias("n1"), F.approx_count_distinct("host").alias("h1")).filter(F.col("n1") >= least_prior)
    shape = sure.groupBy("sh").agg(F.avg(F.col("hit").cast("double")).alias("p2"))
    # Shapes are some hundred by construction, so that table is small.
    x = lines.join(skel, "sk", "left").join(F.broadcast(shape), "sh", "left")
    # Where a skeleton is known from several hosts, what it mostly is there overrides the host's own classes; of others a
    # shape that hardly ever is template isn't one here.
    often = F.coalesce("h1", F.lit(0)) >= 5
    strong = x.filter("strong").select("page_id", "no", "nw", "rs", F.when(often & (F.col("p1") < 0.15), False).when(often & (F.col("p1") >= 0.8), True).when(F.col("p2") < 0.1, False).otherwise(F.col("hit")).alias("tmpl"))
    weak = x.filter("not strong").withColumn("known", F.coalesce(F.col("h1"), F.lit(0)) >= 2).withColumn("p", F.coalesce(F.when(F.col("known"), F.col("p1")), F.col("p2"), F.lit(0.0)))
    w = Window.partitionBy("page_id").orderBy("no")  # the lines of one page
    side = lambda c: (F.coalesce(F.lag(c).over(w), F.lit(0.5)) + F.coalesce(F.lead(c).over(w), F.lit(0.5))) / 2
    sharp = F.when(F.col("known"), F.col("p")).otherwise(F.lit(0.25) + F.col("p") / 2)
    weak = weak.withColumn("s", sharp).withColumn("ctx", side("s"))
    weak = weak.select("page_id", "no", "nw", "rs", (F.when(F.col("known"), F.col("p") >= 0.5).otherwise((F.col("p") + F.col("ctx")) / 2 >= 0.5)).alias("tmpl"))
    return strong.unionByName(weak)


def residue_pages(judged: DataFrame, least: float = 0.3) -> DataFrame:
    """(page_id): pages whose body consists of residue: at least `least` of its words lie in residue windows.

    Lines that are residue as a whole count as body even where a host repeats them on its pages.
    """
    body = judged.filter("not tmpl or (nw > 0 and rs >= nw)").groupBy("page_id").agg(F.sum("nw").alias("nw"), F.sum("rs").alias("rs"))
    return body.filter((F.col("nw") > 0) & (F.col("rs") >= least * F.col("nw"))).select("page_id")


def boilerplate(judged: DataFrame) -> DataFrame:
    """(page_id, line_no): lines of the site on pages that have a body of their own (not residue pages)."""
    return judged.filter("tmpl").join(residue_pages(judged), "page_id", "left_anti").select("page_id", F.col("no").alias("line_no"))


def page_bodies(df: DataFrame, judged: DataFrame, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """(page_id, body, n_lines): the body of each page, its lines in order; residue pages and pages without text have no row."""
    keep = judged.filter("not tmpl").join(residue_pages(judged), "page_id", "left_anti").groupBy("page_id").agg(F.array_sort(F.collect_list("no")).alias("keep"))
    p = df.select(F.col(id_col).cast("long").alias("page_id"), F.split(text_col, "\n", -1).alias("l")).join(keep, "page_id")
    return p.select("page_id", F.array_join(F.transform("keep", lambda i: F.element_at("l", i + 1)), "\n").alias("body"), F.size("keep").alias("n_lines"))
