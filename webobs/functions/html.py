"""HTML parsing on the standard library: a small tree, and Arrow UDFs over it. No function raises on bad markup; null in, null out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}
_LETTER = re.compile(r"[^\W\d_]")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], up

    def walk(self) -> Iterator[Node | str]:
        """Elements and texts in document order."""
        stack: list = [self]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.kids))

    def all(self, tag: str, **attrs: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag == tag and all(x.attrs.get(k.rstrip("_")) == v for k, v in attrs.items())]

    def one(self, tag: str, **attrs: str) -> Node | None:
        return next(iter(self.all(tag, **attrs)), None)

    def text(self) -> str:
        return " ".join("".join(x if isinstance(x, str) else " " for x in self.walk()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.up
        if x is not None and x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # the tree as far as it came
        pass
    return b.root


def useful(text: str, least: int = 4, most: int = 50) -> bool:
    return least <= len(text) <= most and bool(_LETTER.search(text))


def ordered_texts(html: str, least: int = 4, most: int = 50) -> list[str]:
    """Useful texts in document order: text nodes, contents of named metas, values of inputs; scripts and styles are left out."""
    out, stack = [], [parse(html)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            t = x.strip()
        elif x.tag in _HIDDEN:
            continue
        else:
            stack.extend(reversed(x.kids))
            t = x.attrs.get("content", "").strip() if x.tag == "meta" and x.attrs.get("name") else x.attrs.get("value", "").strip() if x.tag == "input" else ""
        if useful(t, least, most):
            out.append(t)
    return out


def marked_text(html: str, links: bool = True, longest: int = 200, most: int = 500_000) -> str | None:
    """Plain text with links as [text](href), inputs as '[Input]: ...', and chosen metas first; None for over `most` characters."""
    if len(html) > most:
        return None
    head, body = [], []
    block = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "ul", "ol", "table", "form", "section", "header", "footer", "option", "title"}

    def visit(n: Node) -> None:
        for x in n.kids:
            if isinstance(x, str):
                body.append(x)
            elif x.tag in _HIDDEN:
                continue
            elif x.tag == "a" and x.attrs.get("href") and links:
                body.append(f"[{x.text()}]({x.attrs['href']})")
            elif x.tag == "input":
                if hint := x.attrs.get("placeholder") or x.attrs.get("value"):
                    body.append(f"\n[Input]: {hint}\n")
            elif x.tag == "meta":
                name = x.attrs.get("name", "")
                if any(w in name.lower() for w in ("hyperglass", "title", "description")):
                    head.append(f"[Meta]:{name}:{x.attrs.get('content', '')}")
            else:
                brk = "\n" if x.tag in block else ""
                body.append(brk)
                visit(x)
                body.append(brk)

    visit(parse(html))
    lines = (" ".join(l.split()) for l in [*head, *"".join(body).split("\n")])
    return "\n".join(l for l in lines if 0 < len(l) < longest)


def tag_names(html: str) -> list[str]:
    return [x.tag for x in parse(html).walk() if isinstance(x, Node) and x.tag]


def links_near(html: str, words: list[str], exact: bool = False) -> list[str]:
    """Targets of links inside the element of each text that holds one of words (of a link: the element around it); each once, in order."""
    low, out = words if exact else [w.lower() for w in words], []

    def visit(n: Node) -> None:
        for x in n.kids:
            if isinstance(x, Node):
                if x.tag not in _HIDDEN:
                    visit(x)
            elif any(w in (x if exact else x.lower()) for w in low):
                holder = n.up if n.tag == "a" and n.up else n
                out.extend(a.attrs["href"] for a in holder.all("a") if a.attrs.get("href"))

    visit(parse(html))
    return list(dict.fromkeys(out))


def table_rows(html: str, cells: int | None = None) -> list[list[tuple[str, str | None]]]:
    """Rows of tables as lists of (text, first link); only rows of `cells` cells, if given."""
    rows = []
    for tr in parse(html).all("tr"):
        row = [(c.text(), (a.attrs.get("href") if (a := c.one("a")) else None)) for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")]
        if row and (cells is None or len(row) == cells):
            rows.append(row)
    return rows


def list_after_anchor(html: str, name: str) -> list[tuple[str, str | None]]:
    """(text, first link) of the items of the first list that follows the anchor called name."""
    seen, out = False, []
    for x in parse(html).walk():
        if isinstance(x, Node):
            if x.tag == "a" and name in (x.attrs.get("name"), x.attrs.get("id")):
                seen = True
            elif seen and x.tag in ("ul", "ol"):
                return [(li.text(), (a.attrs.get("href") if (a := li.one("a")) else None)) for li in x.all("li")]
    return out


def _udf(fn, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else fn(h))

    return run


def texts_udf(least: int = 4, most: int = 50):
    return _udf(lambda h: ordered_texts(h, least, most), "array<string>")


def marked_udf(links: bool = True, longest: int = 200):
    return _udf(lambda h: marked_text(h, links, longest), "string")


def tags_udf():
    return _udf(tag_names, "array<string>")


def links_near_udf(words: list[str], exact: bool = False):
    """exact: words in the case given."""
    return _udf(lambda h: links_near(h, words, exact), "array<string>")


def positions(text: str, words: list[str]) -> list[int]:
    """Where any of words begins in text, as a whole word, in any case."""
    return [m.start() for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", text, re.I)]


def positions_udf(words: list[str]):
    return _udf(lambda t: positions(t, words), "array<int>")


def context(text: str, words: list[str], most: int = 10, side: int = 200, whole: int = 2000) -> str | None:
    """Keywords in context: None without a hit; the whole text up to `whole` characters; else windows from `side` characters
    before to `side` after the beginning of each of the last `most` hits (whole words, any case), grown to the next spaces,
    overlapping ones merged, joined by a blank."""
    hits = positions(text, words)
    if not hits:
        return None
    if len(text) <= whole:
        return text
    spans: list[list[int]] = []
    for a in hits[-most:]:
        lo, hi = text.rfind(" ", 0, max(0, a - side)) + 1, text.find(" ", min(len(text), a + side))
        hi = len(text) if hi < 0 else hi
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return " ".join(text[a:b] for a, b in spans)


def context_udf(words: list[str]):
    return _udf(lambda t: context(t, words), "string")


def table_udf(cells: int | None = None):
    return _udf(lambda h: [[{"text": t, "href": a} for t, a in r] for r in table_rows(h, cells)], "array<array<struct<text:string,href:string>>>")


def list_udf(name: str):
    return _udf(lambda h: [{"text": t, "href": a} for t, a in list_after_anchor(h, name)], "array<struct<text:string,href:string>>")
