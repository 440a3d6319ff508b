"""Text scalars on columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the keyword filter.
KEYWORDS = ["looking glass", "lookingglass", "hyperglass", "traceroute", "ping", "route", "bgp"]


def keyword_count(text: Column, words: list[str] = KEYWORDS) -> Column:
    """How many of words occur in text as substrings, whatever the case; 0 for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(t, F.lit(w)).cast("int") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("int"))


def keyword_any(text: Column, words: list[str] = KEYWORDS) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"\\Q{w}\\E" for w in words)), F.lit(False))


def bucket(score: Column) -> Column:
    """Triage: more than 2 keywords verified, 2 unverified, else unrelated."""
    return F.when(score > 2, "verified").when(score == 2, "unverified").otherwise("unrelated")


def letters(text: Column, least: int = 4) -> Column:
    """Lower-cased runs of at least `least` letters, in order; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))


def useful(parts: Column, least: int = 4, most: int = 50) -> Column:
    """Text nodes with least..most characters and a letter."""
    return F.filter(parts, lambda p: F.length(p).between(least, most) & p.rlike(r"\p{L}"))


def shingle_set(words: Column, k: int) -> Column:
    """Distinct runs of k words, as strings; [] for fewer words."""
    # Bound as a lambda's variable, so that the words are made once and not for every run.
    runs = lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(words), runs)[0]


def word_list(text: Column) -> Column:
    """Words of a text split at white space; [] for null and blank texts."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def clean_lines(text: Column, longest: int = 200) -> Column:
    """Lines of 1 to longest - 1 characters, blanks squeezed, in order; null for texts of over 500,000 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(F.regexp_replace(l, r"\s+", " "))), lambda l: F.length(l).between(1, longest - 1))
    return F.when(F.length(text) <= 500_000, F.array_join(lines, "\n"))


def demote_links(text: Column, words: list[str]) -> Column:
    """[label](address) becomes label, unless the label holds one of words."""
    keep = "|".join(words)
    return F.regexp_replace(text, rf"(?i)\[(?![^\]]*(?:{keep}))([^\]]*)\]\([^)]*\)", "$1")


def absolute_urls(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[A-Za-z0-9./?=&:_-]+"), F.lit(0))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags off, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_scripts(html), "<[^>]*>", " "), r"\s+", " "))


def opening_tags(html: Column) -> Column:
    """Names of opening tags in order, scripts' contents left out."""
    return F.transform(F.regexp_extract_all(without_scripts(html), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t))


def first_int(reply: Column) -> Column:
    return F.regexp_extract(reply, "([0-9]+)", 1).try_cast("int")


def feature_slots(reply: Column, slots: int = 4) -> Column:
    """'slot-value' pairs of a reply as an array of `slots` numbers, 0 where a slot is missing; the last pair of a slot counts."""
    pairs = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit("([0-9])-([0-9])"), F.lit(0))

    def one(i: int) -> Column:
        hit = F.filter(pairs, lambda p: F.substring(p, 1, 1) == str(i))
        return F.coalesce(F.substring(F.try_element_at(hit, F.lit(-1)), 3, 1).cast("int"), F.lit(0))

    return F.array(*[one(i + 1) for i in range(slots)])


def split_hint(hint: Column) -> Column:
    """Tokens of a location hint: digits off, lower case; '(as' hints none; with a comma, parts with hyphens removed and split; else at punctuation."""
    h = F.regexp_replace(F.lower(F.coalesce(hint, F.lit(""))), "[0-9]", "")
    parts = F.transform(F.split(h, ","), lambda p: F.trim(p))
    both = F.concat(F.transform(parts, lambda p: F.replace(p, F.lit("-"), F.lit(""))), F.flatten(F.transform(parts, lambda p: F.split(p, "-"))))
    other = F.split(h, r"[\s!-/:-@\[-`{-~]+")
    toks = F.when(F.contains(h, F.lit("(as")), F.array().cast("array<string>")).when(F.contains(h, F.lit(",")), both).otherwise(other)
    return F.array_sort(F.array_distinct(F.filter(F.transform(toks, lambda t: F.trim(t)), lambda t: t != "")))


def basic_words_udf(least: int = 4, most: int = 50):
    """Words as an uncased multilingual word-piece tokenizer has them once its pieces are joined again: lower case, accents off,
    split at blanks and punctuation, CJK characters apart; those of least..most characters with a letter, as the filter of texts."""
    split = re.compile(r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]|[^\W_]+|[^\w\s]|_")

    def words(t):
        if t is None:
            return []
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return [w for w in split.findall(t) if least <= len(w) <= most and any(c.isalpha() for c in w)]

    @F.pandas_udf("array<string>")
    def run(c: pd.Series) -> pd.Series:
        return c.map(words)

    return run


def harvested(kind: Column, text: Column, near: Column, service: int = 3) -> Column:
    """Addresses of a page by its class: of a service page all in its text, of another those `near` a keyword (see html.links_near)."""
    return F.when(kind == service, absolute_urls(text)).otherwise(near)
