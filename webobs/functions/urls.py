"""Address scalars. Every function takes and gives columns; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels under which names are registered one level deeper (a supplied suffix table replaces them).
SECOND_LEVEL = ["co", "com", "net", "org", "ac", "gov"]


def canonical(url: Column) -> Column:
    """struct(ok, scheme, rest): ok for http addresses with exactly one '://'; rest is what follows, less one trailing '/'."""
    parts = F.split(F.trim(url), "://", -1)
    ok = F.coalesce(F.startswith(F.trim(url), F.lit("http")) & (F.size(parts) == 2), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, parts[0]).alias("scheme"), F.when(ok, F.regexp_replace(parts[1], "/$", "")).alias("rest"))


def filename(url: Column, longest: int = 200) -> Column:
    """File name of an address: no scheme, no trailing '/', other '/' as '_', at most `longest` characters."""
    return F.substring(F.translate(F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z]+://", ""), "/$", ""), "/", "_"), 1, longest)


def host(url: Column) -> Column:
    """Lower-cased host name; '' where there is none."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def is_ipv4_text(text: Column) -> Column:
    """Whether text contains a dotted quad."""
    return text.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")


def registrable(host_: Column, second_level: list[str] = SECOND_LEVEL) -> Column:
    """struct(fld, domain): the registrable domain of a host and its first label; null for addresses and single labels."""
    p = F.split(host_, r"\.")
    n = F.size(p)
    deep = (n >= 3) & F.element_at(p, F.when(n >= 2, -2).otherwise(-1)).isin(second_level)
    k = F.when(deep, 3).otherwise(2)
    fld = F.when((n >= 2) & ~is_ipv4_text(host_), F.array_join(F.slice(p, F.greatest(n - k + 1, F.lit(1)), k), "."))
    return F.struct(fld.alias("fld"), F.split(fld, r"\.")[0].alias("domain"))


def asn_in(url: Column) -> Column:
    """The number n of a part 'asN.' that follows '/' or '.', whatever the case; 0 if there is none (or it is too long)."""
    return F.coalesce(F.regexp_extract(F.lower(url), "[/.]as([0-9]+)[.]", 1).try_cast("bigint"), F.lit(0))


def with_scheme(host_: Column, proto: Column) -> Column:
    """proto://host, unless host starts with http already; null for a null or blank host."""
    return F.when(F.trim(host_) == "", F.lit(None)).when(F.startswith(host_, F.lit("http")), host_).otherwise(F.concat(proto, F.lit("://"), host_))


def from_breadcrumb(text: Column) -> Column:
    """Address of a search result from its breadcrumb text 'host › a › b …': a trailing cut-off step is dropped, https by default."""
    steps = F.filter(F.split(F.trim(text), r"\s*›\s*"), lambda s: (s != "") & ~F.endswith(s, F.lit("...")) & ~F.endswith(s, F.lit("…")))
    joined = F.array_join(steps, "/")
    return F.when(F.contains(joined, F.lit("://")), joined).otherwise(F.concat(F.lit("https://"), joined))


def slug(text: Column) -> Column:
    """Lower case, blanks as '_', other characters dropped, '_' squeezed and trimmed."""
    s = F.regexp_replace(F.lower(text), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_-]", ""), "_+", "_"), "^_|_$", "")


def _without_dots(path: Column) -> Column:
    """A path that begins with '/', its '.' and '..' steps carried out."""
    steps = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((F.element_at(steps, -1).isin(".", "..")) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute address, by the rules of RFC 3986: '..' steps, '?q', '#f', '//host', and '' for the base itself. Null in, null out."""
    b = F.trim(base)
    scheme, site = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, whole = F.regexp_extract(b, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_replace(b, "#.*$", "")
    lp, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_replace(link, "^[^?#]*", "")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(site, _without_dots(lp), rest))
        .when(link == "", whole).when(F.startswith(link, F.lit("?")), F.concat(site, path, link)).when(F.startswith(link, F.lit("#")), F.concat(whole, link)).otherwise(F.concat(site, _without_dots(F.concat(folder, lp)), rest))
    )


def probe_form(params: Column, option_name: Column, option: Column, target_name: Column, target: Column) -> Column:
    """A request body: fixed parameters (map), the command and the target, URL-encoded, in order of name."""
    all_ = F.map_concat(params, F.map_from_arrays(F.array(option_name, target_name), F.array(option, target)))
    return F.array_join(F.transform(F.array_sort(F.map_entries(all_)), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def probe_json(params: Column, option_name: Column, option: Column, target_name: Column, target: Column) -> Column:
    """As probe_form, as a JSON object of strings."""
    all_ = F.map_concat(params, F.map_from_arrays(F.array(option_name, target_name), F.array(option, target)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(all_))))


def probe_headers(url: Column, content_type: Column) -> Column:
    """Headers of a posted request: its content type, and the page it comes from with and without a trailing '/'."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.create_map(F.lit("Content-Type"), content_type, F.lit("Origin"), bare, F.lit("Referer"), F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/"))))


def pick_option(values: Column, words: list[str], default: str | None = None) -> Column:
    """First of values (array) that holds any of words, whatever the case, else default."""
    low = lambda v: F.lower(v)
    hit = F.filter(values, lambda v: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low(v), w)))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(default))
