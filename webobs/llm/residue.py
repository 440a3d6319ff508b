"""Template residue, filler and error texts (problem 3): labelled exemplars in an inverted index, TF-IDF containment of windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webobs.functions.vectext import Words
from webobs.runtime import stage

# Labelled exemplars of residue, by kind. PH is any unfilled placeholder; numbers stand for any number.
EXEMPLARS: dict[str, list[str]] = {
    "placeholder": [
        "PH", "PH PH", "Our PH is ready for PH", "Hello PH", "Welcome to PH", "Contact PH", "Location PH", "Looking glass of PH", "IPv4 PH", "Text PH", "Router PH", "Standort PH", "Ciudad PH", "TODO PH",
    ],
    "filler": [
        "lorem ipsum conditur eratum nollat vestam magnil sagit consec vitae lacrit falat ortame tetura mauris tellin ornare quibus ipsera semperi adipen voluna pretia felis dolun rutrem",
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation",
        "xxxx xxxx xxxx", "asdf asdf test test 1", "Your heading", "Title text", "Headline number 1", "Titre ici", "Überschrift",
        "Coming soon - we are still filling section 1 of this template", "Put a few friendly words about your company in this box Double click to edit block 1",
        "This is a demo paragraph number 1 Swap it for your own words before launch", "Texto de muestra 1 cámbielo antes de publicar",
        "Texte provisoire du bloc 1 à remplacer avant mise en ligne", "Hier steht später ein Text Bitte Abschnitt 1 ersetzen",
    ],
    "error": [
        "404 Not Found", "weft/7.2", "502 Bad Gateway", "503 Service Temporarily Unavailable", "500 Internal Server Error", "Interner Fehler 500", "Bitte melden Sie Kennung 1", "Error 500", "Erreur 500 sur HOST",
        "Forbidden", "You lack permission for /lg on this server", "Access denied", "Your address 1.1.1.1 may not open HOST Reference 1", "Too many requests", "Limit of 10 queries reached slow down", "Try again in 10 seconds",
        "Gateway timeout while contacting upstream 1.1.1.1", "Database connection failed timeout after 1 ms in db_open() line 1", "No input file specified", "Fatal undefined function lg_render()", "Warning include(conf/lg.inc) no such file in /srv/lg/index.php on line 1", "The address /lg was not found on HOST",
        "Traceback (most recent call last)", "File /srv/lg/app.py line 1 in view", "KeyError router", "SSL error certificate of HOST does not match",
        "Oops!", "We looked everywhere but this page has gone missing", "Page not found", "Page introuvable", "Seite nicht gefunden", "Die Adresse auf HOST existiert nicht mehr", "Página no encontrada", "El enlace de HOST ya no existe", "Erreur 404 sur HOST",
    ],
    "empty server": [
        "It works!", "Default page of a fresh web server on HOST No content has been added", "Index of /", "Name Last modified Size", "Parent directory", "HOST is parked", "The owner has not published a site yet Buy this name?",
        "This account has been suspended", "Contact the billing desk of your provider", "Site under maintenance", "Back at 1:00", "Wartungsarbeiten", "Unser Dienst ist kurz offline",
    ],
    "scripts": [
        "Please enable JavaScript to use HOST", "You need to turn on scripts to run this app", "Loading...", "If nothing happens allow scripts and reload", "Scripts blocked This interface cannot start",
        "Your browser is not supported", "Cookies and scripts are required", "Sorry HOST does not work properly in browsers with scripting switched off", "Bitte aktivieren Sie JavaScript um HOST zu nutzen",
        "Veuillez activer JavaScript pour continuer", "Active JavaScript en su navegador para seguir", "Checking your browser before opening HOST", "Request id 1", "Verifying connection security wait 1 s", "One more step", "Prove you are a person to reach HOST",
    ],
}

# Labelled exemplars of parts of an address (a label of the host, a step of the path, a value) that stand in for real ones.
ADDRESSES: dict[str, list[str]] = {
    "placeholder": ["PH"],
    "stand-in": ["undefined", "null", "nan", "none", "changeme", "todo", "tbd", "xxx", "yourdomain", "yourhost", "yoursite", "hostname", "domain", "placeholder", "insert", "object object"],
    "instruction": [f"{verb} {what} here" for verb in ("your", "insert", "put your") for what in ("domain", "city", "name", "url", "host", "lg host", "hostname", "company", "router", "site url", "lang", "asn")],
}

_SLOT = (
    r"\{\{[^{}]*\}\}|\$\{\w+\}|#\{\w+\}|\{%[^%]*%\}|<%=?[^%]*%>|&lt;\w[\w -]*&gt;|<your[ _-]\w+>|@@\w+@@|%%\w+%%|(?<!\w)__\w+?__(?!\w)|\$[A-Za-z_]\w*\$|\[\[\w+\]\]"
    r"|\[insert \w+ here\]|\[\w+ goes here\]|(?<![\w{])\{\w+\}(?!\w)|(?<![\w:]):[A-Za-z_]+[A-Za-z0-9_]*:(?![\w:])|TODO: \w+"
)


_SLOTS, _MARK = re.compile("(?i)" + _SLOT, re.A), re.compile(r"(?i)[{$%<]|@@|__|\[\[|&lt;|\[insert |goes here\]|todo: |:[a-z_]\w*:", re.A)


def slots_to_words(l: str) -> str:
    """A line with each unfilled placeholder as the word phslot; lines without any mark of one are passed over."""
    return _SLOTS.sub(" phslot ", l) if _MARK.search(l) else l


def plain(l: str, host: str) -> str:
    """A line with each placeholder and the host as a word; case and punctuation are left to the index."""
    l = slots_to_words(l)
    return l.replace(host, " hostslot ") if host else l


FREE = -2  # a word that weighs nothing: a number, or the own host


class Index:
    """The inverted index: word -> exemplars."""

    def __init__(self, texts: dict[str, list[str]]):
        rows = []
        for kind, xs in texts.items():
            for x in xs:
                rows.append((kind, x))
        self.kinds = [k for k, _ in rows]
        norm = [self._norm(x) for _, x in rows]
        w = Words(pa.array(norm))
        _, h = w.hashes(1)
        self.host = Words(pa.array(["hostslot"])).hashes(1)[1][0]
        keep = ~w.numeric() & (h != self.host)
        doc, h = w.doc[keep], h[keep]
        self.vocab = np.unique(h)
        self.has = np.zeros((len(self.vocab), len(rows)), np.float32)
        self.has[np.searchsorted(self.vocab, h), doc] = 1
        self.bag = np.array([k == "filler" and len(x.split()) > 20 for (k, x) in rows])

    @staticmethod
    def _norm(x: str) -> str:
        x = x.replace("PH", " phslot ").replace("HOST", " hostslot ").lower()
        return re.sub(r"[\W_]+", " ", x).strip()

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for other words, FREE for the host."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        out = np.where(self.vocab[at] == h, at, -1)
        out[h == self.host] = FREE
        return out

    def score(self, at: np.ndarray, win: np.ndarray, n: int, idf: np.ndarray, other: float, cover: float) -> np.ndarray:
        """For n windows of words (places at, window numbers win): the largest TF-IDF containment of a window in an exemplar.

        A word of the vocabulary counts once in a window, other words each time. Exemplars are retrieved by the words they
        share with the window; one that a window covers by less than `cover` doesn't count, but for bags of filler words.
        """
        hit = at >= 0
        total = np.bincount(win[at == -1], minlength=n) * other
        key = np.unique(win[hit] * len(self.vocab) + at[hit])
        row, a = key // len(self.vocab), key % len(self.vocab)
        total = total + np.bincount(row, idf[a], minlength=n)
        best = np.zeros(n)
        full = (self.has * idf[:, None]).sum(axis=0)
        w = self.has * idf[:, None].astype(np.float32)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        for lo in range(0, len(first), 1024):  # in blocks of windows
            at0 = first[lo : lo + 1024]
            end = first[lo + 1024] if lo + 1024 < len(first) else len(row)
            got = np.add.reduceat(w[a[at0[0] : end]], at0 - at0[0], axis=0)
            got[(got < cover * full) & ~self.bag] = 0
            best[row[at0]] = got.max(axis=1)
        return best / np.maximum(total, 1e-9)


def document_frequencies(pages: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """(pages, pages with each word of the vocabulary), over all pages (column voc); one row per task and word is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = 0, len(index.vocab)
        df = np.zeros(v, np.int64)
        for b in batches:
            at = b.column(0).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
            df += np.bincount(np.unique(doc[at >= 0] * v + at[at >= 0]) % v, minlength=v)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v + 1)), pa.array(np.r_[df, n])], ["w", "n"])

    got = {r["w"]: r["n"] for r in pages.select("voc").mapInArrow(count, "w long, n long").groupBy("w").sum("n").toDF("w", "n").collect()}
    return got.get(len(index.vocab), 0), np.array([got.get(i, 0) for i in range(len(index.vocab))], float)


def line_scorer(index: Index, idf: np.ndarray, other: float, window: int = 24, least: float = 0.45, cover: float = 0.4):
    """For lines of n words with places voc: the words of each line inside windows that reach `least`.

    A line of up to `window` words is one window; a longer one is cut into windows of that size, half overlapping.
    """

    def run(n: np.ndarray, voc: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum(n)])
        step = window // 2
        k = np.maximum(1, -(-np.maximum(n - window, 0) // step) + 1)
        line = np.repeat(np.arange(len(n)), k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        lo = first[:-1][line] + j * step
        hi = np.minimum(lo + window, first[1:][line])
        size = np.maximum(hi - lo, 0)
        # No exemplar holds more than all words of the vocabulary in a window; windows that can't reach `least` so are passed over.
        known = np.concatenate([[0], np.cumsum(np.where(voc >= 0, idf[np.maximum(voc, 0)], 0.0))])
        rest = np.concatenate([[0], np.cumsum(voc == -1)])
        known, rest = known[hi] - known[lo], rest[hi] - rest[lo]
        maybe = np.flatnonzero(known >= least * (known + other * rest) - 1e-6)
        sz = size[maybe]
        at = np.arange(sz.sum()) - np.repeat(np.cumsum(sz) - sz, sz) + np.repeat(lo[maybe], sz)
        ok = maybe[index.score(voc[at], np.repeat(np.arange(len(maybe)), sz), len(maybe), idf, other, cover) >= least]
        mark = np.zeros(len(voc) + 1, np.int64)
        np.add.at(mark, lo[ok], 1)
        np.add.at(mark, hi[ok], -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)]) if len(voc) else np.zeros(1, np.int64)
        return inside[first[1:]] - inside[first[:-1]]

    return run


_BLANKS, _WRAP = re.compile("[ \\t\u00a0\u1680\u180e\u2000-\u200a\u202f\u205f\u3000]+"), re.compile(r"^[\s<\[(\"']+(?=[A-Za-z]+ ?:)|[\s,.\"']+$", re.A)
_OPENS, _CLOSES, _SCHEME = re.compile(r"[<\[(]"), re.compile(r"[\s>\])]+$", re.A), re.compile(r"^\s*[a-z]+\s*:[\s/\\]*", re.A)
_STEPS, _PORT, _QUERY, _VALUE = re.compile(r"[/\\]+"), re.compile(r":[0-9]*$"), re.compile(r"\?(.*)$"), re.compile("=(.*)$")
_STAND = re.compile(
    r"\{\{[^{}]*\}\}|\$\{\w+\}|#\{\w+\}|\{\w+\}|\{%[^%]*%\}|<%=?[^%]*%>|<your[ _-]\w+>|@@\w+@@|__\w+__|%\(\w+\)s|%[a-z_]{3,}%|\$\w+\$|\[[a-z_]+\](?=[/:.]|$)"
    r"|[/\\]\s*:[a-z_]+|(?<=[/=.])%[sd](?=[/&;.:]|$)",
    re.A,
)


def address_parts(url: str | None) -> list[str]:
    """The parts of an address: labels of its host, steps of its path, values of its parameters, and each placeholder (phslot) by itself.

    Wrapping brackets and quotes around the whole address and percent-encoded characters are no placeholders. Null has no parts.
    """
    u = _WRAP.sub("", _BLANKS.sub(" ", url or ""))
    if not _OPENS.search(u):  # a closing bracket at the end belongs to the wrapping only if none opens inside
        u = _CLOSES.sub("", u)
    u = _SCHEME.sub("", _STAND.sub("/phslot/", u.lower()))
    host, *steps = _STEPS.split(re.split("[?#]", u, maxsplit=1)[0])
    query = _QUERY.search(u)
    values = [v for p in re.split("[&;]", query[1]) if (m := _VALUE.search(p)) for v in m[1].split("/")] if query else []
    return [p for p in [*_PORT.sub("", host).split("."), *steps, *values] if p]


def residue_addresses(df: DataFrame, id_col: str, url_col: str, least: float = 0.6) -> DataFrame:
    """(id): rows whose address holds an unfilled or stand-in part: a part whose TF-IDF containment in an exemplar reaches `least`.

    Parts are the windows; frequencies of words are counted over all addresses. A part must also cover `least` of the exemplar.
    Rows with a null id are left out; null and empty addresses are none.
    """
    index = Index(ADDRESSES)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [address_parts(u) for u in b.column(1).to_pylist()]
            w = Words(pa.array([p for x in parts for p in x], pa.string()), lower=True, punctuation=True)
            at = index.ids(w.hashes(1)[1])
            at[w.numeric()] = FREE
            off = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(np.diff(w.first).astype(np.int32))), pa.ListArray.from_arrays(pa.array(w.first[off].astype(np.int32)), pa.array(at.astype(np.int16)))], ["id", "n", "voc"])

    d = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).filter("url <> ''")
    d = stage(d.mapInArrow(looked_up, "id long, n array<int>, voc array<short>"))
    total, seen = document_frequencies(d, index)
    idf = np.log((total + 1) / (seen + 1)) + 0.1
    other = float(np.median(idf))

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                c = b.slice(lo, 2000)
                n, voc = c.column(1).flatten().to_numpy(), c.column(2).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(c.num_rows), c.column(1).value_lengths().to_numpy())
                best = index.score(voc, np.repeat(np.arange(len(n)), n), len(n), idf, other, least)
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(np.unique(row[best >= least])))], ["id"])

    return d.mapInArrow(covered, "id long")
