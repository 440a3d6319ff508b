"""Queries over addresses, pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.functions import html as H
from webobs.functions import text as T
from webobs.functions import urls as U
from webobs.functions.vectext import run_sets
from webobs.operators import dedup, graph, joins, similarity, slices, tfidf
from webobs.plans.registry import query
from webobs.runtime import cut, stage

col = F.col

# ---- addresses (lg_page_info) ----
_OKURL = "url IS NOT NULL AND starts_with(trim(url, ' '), 'http') AND len(string_split(trim(url, ' '), '://')) = 2"


@query(f"""
WITH c AS (SELECT row_id, name, string_split(trim(url, ' '), '://')[1] s, regexp_replace(string_split(trim(url, ' '), '://')[2], '/$', '') rest FROM lg_page_info WHERE {_OKURL})
SELECT rest, CASE WHEN bool_or(s = 'http') THEN 'http' ELSE min(s) END || '://' || rest AS url, arg_min_null(name, row_id) AS name FROM c GROUP BY rest
""")
def url_canonical(t):
    return dedup.by_canonical_url(t.lg_page_info, "url", "name", "row_id")


@query("SELECT url, row_id, name FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id) r FROM lg_page_info) WHERE r = 1")
def url_first(t):
    return dedup.first_by(t.lg_page_info.select("url", "row_id", "name"), ["url"], "row_id")


@query("SELECT DISTINCT url FROM lg_page_info")
def url_distinct(t):
    return t.lg_page_info.select("url").distinct()


@query("""
WITH h AS (SELECT row_id, regexp_replace(trim(url, ' '), '^[A-Za-z]+://', '') bare, CASE WHEN row_id % 2 = 0 THEN 'http' ELSE 'https' END proto FROM lg_page_info)
SELECT row_id, CASE WHEN trim(bare, ' ') = '' THEN NULL WHEN starts_with(bare, 'http') THEN bare ELSE proto || '://' || bare END AS url FROM h
""")
def url_scheme_fill(t):
    d = t.lg_page_info.select("row_id", F.regexp_replace(F.trim("url"), "^[A-Za-z]+://", "").alias("bare"), F.when(col("row_id") % 2 == 0, "http").otherwise("https").alias("proto"))
    return d.select("row_id", U.with_scheme(col("bare"), col("proto")).alias("url"))


@query("SELECT row_id, substring(replace(regexp_replace(regexp_replace(trim(url, ' '), '^[A-Za-z]+://', ''), '/$', ''), '/', '_'), 1, 200) AS filename FROM lg_page_info")
def url_filename(t):
    return t.lg_page_info.select("row_id", U.filename(col("url")).alias("filename"))


_HOST = "lower(regexp_extract(trim(url, ' '), '^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1))"


@query(f"SELECT row_id, {_HOST} AS host FROM lg_page_info")
def url_host(t):
    return t.lg_page_info.select("row_id", U.host(col("url")).alias("host"))


@query("SELECT row_id, regexp_matches(url, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') AS has_ip FROM lg_page_info")
def url_has_ip(t):
    return t.lg_page_info.select("row_id", U.is_ipv4_text(col("url")).alias("has_ip"))


@query(f"""
WITH h AS (SELECT row_id, {_HOST} AS h FROM lg_page_info), p AS (SELECT row_id, h, string_split(h, '.') p FROM h),
f AS (SELECT row_id, CASE WHEN len(p) >= 2 AND NOT regexp_matches(h, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') THEN
  CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'com', 'net', 'org', 'ac', 'gov') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END END AS fld FROM p)
SELECT row_id, fld, string_split(fld, '.')[1] AS domain FROM f
""")
def registrable_domain(t):
    return t.lg_page_info.select("row_id", U.registrable(U.host(col("url"))).alias("r")).select("row_id", "r.fld", "r.domain")


@query("""SELECT loc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(hint), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM vp_location""")
def slugify(t):
    return t.vp_location.select("loc_id", U.slug(col("hint")).alias("slug"))


@query("SELECT row_id, coalesce(try_cast(regexp_extract('http://lg.as' || asn || '.example/' || url, '[/.]as([0-9]+)[.]', 1) AS BIGINT), 0) AS asn FROM (SELECT row_id, asn, lower(url) url FROM lg_page_info)")
def url_asn(t):
    return t.lg_page_info.select("row_id", U.asn_in(F.concat(F.lit("http://lg.AS"), col("asn"), F.lit(".example/"), col("url"))).alias("asn"))


@query("SELECT page_id, length(content) AS n FROM page_content WHERE length(content) <= 2500")
def size_filter(t):
    return t.page_content.select("page_id", F.length("content").alias("n")).filter("n <= 2500")


@query(f"""
WITH b AS (SELECT row_id, replace(regexp_replace(trim(url, ' '), '^[A-Za-z]+://', ''), '/', ' › ') || ' › cut...' AS crumb FROM lg_page_info),
s AS (SELECT row_id, array_to_string(list_filter(regexp_split_to_array(trim(crumb, ' '), '\\s*›\\s*'), lambda x: x <> '' AND NOT suffix(x, '...') AND NOT suffix(x, '…')), '/') j FROM b)
SELECT row_id, CASE WHEN contains(j, '://') THEN j ELSE 'https://' || j END AS url FROM s
""")
def breadcrumb_url(t):
    crumb = F.concat(F.replace(F.regexp_replace(F.trim("url"), "^[A-Za-z]+://", ""), F.lit("/"), F.lit(" › ")), F.lit(" › cut..."))
    return t.lg_page_info.select("row_id", U.from_breadcrumb(crumb).alias("url"))


_LINKS_TRIED = ["../d", "../../../d", "./x?y=1#z", "?q=1", "#f", "", "a/./b/../c/", "..", "//h.example/x", "/p/./q/../r?s", "mailto:a@b.example"]
_NORM = """'/' || array_to_string(list_reduce(list_transform(string_split({0}[2:], '/'), lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[]), '/')
 || CASE WHEN string_split({0}[2:], '/')[-1] IN ('.', '..') AND len(list_reduce(list_transform(string_split({0}[2:], '/'), lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[])) > 0 THEN '/' ELSE '' END"""


@query(f"""
WITH p AS (SELECT page_id, trim(url, ' ') b, unnest(list_concat(regexp_extract_all(coalesce(content, ''), '\\]\\(([^)]*)\\)', 1), {_LINKS_TRIED})) AS link FROM page_content),
q AS (SELECT *, regexp_extract(b, '^([A-Za-z]+://[^/?#]*)', 1) site, regexp_extract(b, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) path, regexp_replace(b, '#.*$', '') bare, regexp_extract(link, '^([^?#]*)', 1) lp, regexp_replace(link, '^[^?#]*', '') rest FROM p),
r AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || lp AS under FROM q)
SELECT page_id, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(b, '^([A-Za-z]+:)', 1) || link WHEN starts_with(link, '/') THEN site || {_NORM.format("lp")} || rest
 WHEN link = '' THEN bare WHEN starts_with(link, '?') THEN site || path || link WHEN starts_with(link, '#') THEN bare || link ELSE site || {_NORM.format("under")} || rest END AS target FROM r
""")
def resolve_links(t):
    """Every page's links, and a list of links of all kinds, as absolute addresses."""
    l = F.concat(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\]\(([^)]*)\)"), F.lit(1)), F.array(*map(F.lit, _LINKS_TRIED)))
    p = t.page_content.select("page_id", "url", F.explode(l).alias("link"))
    return p.select("page_id", "link", U.resolve(col("url"), col("link")).alias("target"))


@query("SELECT CASE WHEN url IS NULL THEN 'no address' WHEN NOT starts_with(trim(url, ' '), 'http') THEN 'other scheme' WHEN len(string_split(trim(url, ' '), '://')) <> 2 THEN 'malformed' ELSE 'kept' END AS verdict, count(*) AS n FROM lg_page_info GROUP BY 1")
def url_rejects(t):
    """How many addresses the canonical form keeps, and why it rejects others."""
    u = F.trim("url")
    why = F.when(col("url").isNull(), "no address").when(~F.startswith(u, F.lit("http")), "other scheme").when(F.size(F.split(u, "://", -1)) != 2, "malformed").otherwise("kept")
    return t.lg_page_info.groupBy(why.alias("verdict")).agg(F.count("*").alias("n"))


_RULES = ["example", "test", "net.example", "co.example", "*.test", "!mobile.test"]


@query(f"""
WITH h AS (SELECT DISTINCT {{_HOST}} AS host FROM lg_page_info), p AS (SELECT host, string_split(host, '.') p FROM h WHERE host <> ''), i AS (SELECT host, p, unnest(range(1, len(p) + 1)) i FROM p),
c AS (SELECT host, len(p) n, len(p) - i + 1 k, array_to_string(p[i:], '.') s, array_to_string(list_concat(['*'], p[i + 1:]), '.') w FROM i),
r AS (SELECT host, n, max(CASE WHEN '!' || s IN (SELECT unnest({_RULES})) THEN 1000 + k - 1 WHEN s IN (SELECT unnest({_RULES})) OR (k > 1 AND w IN (SELECT unnest({_RULES}))) THEN k END) m FROM c GROUP BY 1, 2)
SELECT host, CASE WHEN n > coalesce(m % 1000, 1) AND NOT regexp_matches(host, '^[0-9]{{{{1,3}}}}(\\.[0-9]{{{{1,3}}}}){{{{3}}}}$') THEN array_to_string(string_split(host, '.')[n - coalesce(m % 1000, 1):], '.') END AS fld FROM r
""".format(_HOST=_HOST))
def suffix_domain(t):
    """Registrable domains by a table of public suffixes, with wildcard and exception rules."""
    rules = t._spark.createDataFrame([(x,) for x in _RULES], "rule string")
    hosts = t.lg_page_info.select(U.host(col("url")).alias("host")).filter("host <> ''").distinct()
    return joins.registrable_by(hosts, "host", rules, "rule").select("host", "fld")


# ---- texts (documents) ----
@query("""
WITH d AS (SELECT md5(text) AS hash, doc_id, site, CASE WHEN regexp_matches(coalesce(site, ''), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN 1 ELSE 0 END ip, length(coalesce(site, '')) n FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ip, n, doc_id) k, count(*) OVER (PARTITION BY hash) c FROM d)
SELECT hash, doc_id, site, c AS n FROM r WHERE k = 1
""")
def md5_dedup(t):
    return dedup.by_content_hash(t.documents, "text", "site", "doc_id")


_WORDS = ["looking glass", "lookingglass", "hyperglass", "traceroute", "ping", "route", "bgp"]
_COUNT = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in _WORDS)


@query(f"SELECT doc_id, {_COUNT} AS score FROM documents")
def keyword_score(t):
    return t.documents.select("doc_id", T.keyword_count(col("text")).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE ({_COUNT}) > 0")
def keyword_any(t):
    return t.documents.filter(T.keyword_any(col("text"))).select("doc_id")


@query(f"SELECT CASE WHEN s > 2 THEN 'verified' WHEN s = 2 THEN 'unverified' ELSE 'unrelated' END AS bucket, count(*) AS n FROM (SELECT {_COUNT} s FROM documents) GROUP BY 1")
def triage_buckets(t):
    return t.documents.groupBy(T.bucket(T.keyword_count(col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT doc_id, generate_subscripts(parts, 1) i, unnest(list_transform(parts, lambda x: length(x))) n FROM
 (SELECT doc_id, string_split(lower(text), 'router') parts FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 6 AS pos, max(i) OVER (PARTITION BY doc_id) m FROM p)
SELECT doc_id, pos::BIGINT AS pos FROM o WHERE i < m AND m - i <= 10
""")
def keyword_positions(t):
    """Character positions (from 0) of the last 10 occurrences of a word in each text."""
    parts = F.split(F.lower("text"), "router", -1)
    d = t.documents.filter("text is not null").select("doc_id", F.transform(parts, lambda p: F.length(p)).alias("n"))
    d = d.select("doc_id", F.posexplode("n").alias("i", "n"), F.size("n").alias("m"))
    w = Window.partitionBy("doc_id").orderBy("i")
    return d.withColumn("pos", F.sum("n").over(w) + col("i") * 6).filter("i < m - 1 and m - 1 - i <= 10").select("doc_id", "pos")


_SPANS = """
 p AS (SELECT doc_id, generate_subscripts(parts, 1) i, unnest(list_transform(parts, lambda x: length(x))) n, total FROM
  (SELECT doc_id, string_split(lower(text), 'route') parts, length(text) total FROM documents WHERE text IS NOT NULL)),
 o AS (SELECT doc_id, i, total, sum(n) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 5 AS pos, max(i) OVER (PARTITION BY doc_id) m FROM p),
 s AS (SELECT doc_id, greatest(pos - 200, 0) lo, least(pos + 200, total) hi FROM o WHERE i < m),
 g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END fresh FROM s),
 k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) isle FROM g)
"""


@query(f"WITH {_SPANS} SELECT doc_id, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM k GROUP BY doc_id, isle")
def merge_spans(t):
    """Windows from 200 characters before to 200 after the beginning of a word, overlapping and touching ones merged."""
    d = t.documents.filter("text is not null").select("doc_id", F.length("text").alias("total"), F.transform(F.split(F.lower("text"), "route", -1), lambda p: F.length(p)).alias("n"))
    d = d.select("doc_id", "total", F.posexplode("n").alias("i", "n"), F.size("n").alias("m"))
    w = Window.partitionBy("doc_id").orderBy("i")
    s = d.withColumn("pos", F.sum("n").over(w) + col("i") * 5).filter("i < m - 1").select("doc_id", F.greatest(col("pos") - 200, F.lit(0)).alias("lo"), F.least(col("pos") + 200, col("total")).alias("hi"))
    o = Window.partitionBy("doc_id").orderBy("lo", "hi")
    s = s.withColumn("fresh", F.when(col("lo") <= F.max("hi").over(o.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    s = s.withColumn("isle", F.sum("fresh").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "isle").agg(F.min("lo").cast("long").alias("lo"), F.max("hi").cast("long").alias("hi")).drop("isle")


@query()
def kwic_context(t):
    """Text around keywords: null without a hit, whole if short, else the merged windows of the last 10 hits, grown to blanks."""
    return t.documents.select("doc_id", H.context_udf(["router", "looking glass", "traceroute"])("text").alias("context"))


@query()
def keyword_word_positions(t):
    """Where any of several keywords begins in each text, as whole words."""
    return t.documents.filter("text is not null").select("doc_id", F.explode(H.positions_udf(["router", "looking glass", "traceroute"])("text")).alias("pos"))


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '\\p{L}{4,}', 0)"


@query(f"SELECT doc_id, len({_TOK}) AS n, md5(array_to_string({_TOK}, ' ')) AS digest FROM documents")
def tokens(t):
    w = T.letters(col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.encode(F.array_join(w, " "), "UTF-8")).alias("digest"))


@query("""SELECT page_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT page_id, list_filter(string_split(content, chr(10)), lambda p: length(p) BETWEEN 4 AND 50 AND regexp_matches(p, '\\p{L}')) l FROM page_content WHERE content IS NOT NULL)""")
def token_filter(t):
    l = T.useful(F.split("content", "\n", -1))
    return t.page_content.filter("content is not null").select("page_id", F.size(l).cast("long").alias("n"), F.md5(F.encode(F.array_join(l, "|"), "UTF-8")).alias("digest"))


_SH = """
 w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') w FROM documents),
 sh AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) s FROM w WHERE len(w) >= 5)
"""


@query(f"WITH {_SH} SELECT doc_id, len(s) AS n FROM sh")
def shingles(t):
    s = T.shingle_set(T.word_list(col("text")), 5)
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n")).filter("n > 0")


def _sets(t):
    """(page_id, s): hashes of each page's shingles, made once and staged."""
    return stage(run_sets(t.page_content, "page_id", "content", 5))


_LINKS = f"""
 {_SH.replace("doc_id", "page_id").replace("text,", "content,").replace("documents", "page_content")}, h AS (SELECT page_id, md5(array_to_string(list_sort(s), chr(1))) h, s FROM sh), c AS (SELECT h, min(page_id) rep, any_value(s) s FROM h GROUP BY h),
 e AS (SELECT rep, len(s) n, unnest(s) x FROM c), b AS (SELECT a.rep a, b.rep b, any_value(a.n) na, any_value(b.n) nb, count(*) o FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
 l AS (SELECT a, b, o / (ln(greatest(na, nb)) + least(na, nb)) sim FROM b WHERE o / (ln(greatest(na, nb)) + least(na, nb)) >= 0.8)
"""


@query(f"""
WITH {_LINKS}, d AS (SELECT x rep, count(*) k FROM (SELECT a x FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
SELECT h.page_id, c.rep AS class, coalesce(d.k, 0) AS links FROM h JOIN c USING (h) LEFT JOIN d ON d.rep = c.rep
""")
def jaccard_pairs(t):
    """Each page's class of equal shingle sets and the number of classes with similarity of at least 0.8 to it."""
    d = _sets(t)
    links = similarity.overlap_links(d, "page_id", "s", 0.8)
    deg = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return similarity.classes(d, "page_id", "s").join(deg, "rep", "left").select(col("id").alias("page_id"), col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""
WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) k FROM l)
SELECT a, b, round(sim, 6) AS sim FROM r WHERE k = 1 OR sim > 0.9
""")
def best_match_edges(t):
    l = similarity.overlap_links(_sets(t), "page_id", "s", 0.8)
    best = similarity.best_match_edges(l.withColumn("sim", F.round("sim", 9)), 0.8 - 1e-9)
    return best.select("a", "b", F.round("sim", 6).alias("sim"))


_COMP = f"""
WITH RECURSIVE {_LINKS}, y AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, root) AS (SELECT rep, rep FROM c UNION SELECT y.b, r.root FROM r JOIN y ON y.a = r.id),
 comp AS (SELECT id, min(root) cluster FROM r GROUP BY id)
"""


@query(f"{_COMP} SELECT h.page_id, comp.cluster FROM h JOIN c USING (h) JOIN comp ON comp.id = c.rep")
def components(t):
    d = _sets(t)
    return similarity.groups(d, "page_id", "s", similarity.overlap_links(d, "page_id", "s", 0.8)).select(col("id").alias("page_id"), "cluster")


@query(f"""
{_COMP}, z AS (SELECT comp.cluster, count(*) size FROM h JOIN c USING (h) JOIN comp ON comp.id = c.rep GROUP BY 1)
SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) - 1 AS rank FROM z
""")
def cluster_sizes(t):
    return dedup.sizes_renumbered(components(t), "cluster")


@query(f"""
WITH RECURSIVE {_LINKS},
 s1 AS (SELECT page_id id, min(page_id) OVER (PARTITION BY lower(host)) cluster FROM page_content),
 big AS (SELECT cluster FROM s1 GROUP BY 1 HAVING count(*) > 10), m AS (SELECT s1.* FROM s1 JOIN big USING (cluster)),
 cl AS (SELECT h.page_id id, c.rep FROM h JOIN c USING (h)), y0 AS (SELECT x.id a, z.id b FROM cl x JOIN cl z ON x.rep = z.rep AND x.id <> z.id UNION SELECT x.id, z.id FROM l JOIN cl x ON x.rep = l.a JOIN cl z ON z.rep = l.b UNION SELECT z.id, x.id FROM l JOIN cl x ON x.rep = l.a JOIN cl z ON z.rep = l.b),
 y AS (SELECT y0.a, y0.b FROM y0 JOIN m p ON p.id = y0.a JOIN m q ON q.id = y0.b WHERE p.cluster = q.cluster),
 r(id, root) AS (SELECT id, id FROM m UNION SELECT y.b, r.root FROM r JOIN y ON y.a = r.id), k AS (SELECT id, min(root) comp FROM r GROUP BY 1),
 n AS (SELECT m.cluster, k.comp, row_number() OVER (PARTITION BY m.cluster ORDER BY k.comp) - 1 AS i FROM m JOIN k USING (id) GROUP BY 1, 2)
SELECT m.id AS page_id, m.cluster || '_' || n.i AS cluster FROM m JOIN k USING (id) JOIN n ON n.cluster = m.cluster AND n.comp = k.comp
UNION ALL SELECT id, cluster::VARCHAR FROM s1 WHERE cluster NOT IN (SELECT cluster FROM big)
""")
def two_stage_clusters(t):
    """Pages by host; hosts of more than 10 pages are split by near-equal content inside them."""
    p = t.page_content
    first = p.groupBy(F.lower("host").alias("h")).agg(F.min("page_id").alias("cluster"))
    s1 = p.select(col("page_id").alias("id"), F.lower("host").alias("h")).join(first, "h").select("id", "cluster")
    d = _sets(t)
    l = similarity.overlap_links(d, "page_id", "s", 0.8)
    # Members of a class are linked in a chain to its representative, and classes by their representatives' hosts: the
    # links inside a cluster are found over members, one per class and cluster.
    c = similarity.classes(d, "page_id", "s").join(s1, "id")
    one = c.groupBy("rep", "cluster").agg(F.min("id").alias("first"))
    same = c.join(one, ["rep", "cluster"]).filter("id <> first").select(col("first").alias("a"), col("id").alias("b"))
    x, y = one.toDF("a", "cluster", "fa"), one.toDF("b", "cluster", "fb")
    across = l.join(x, "a").join(y, ["b", "cluster"]).select(col("fa").alias("a"), col("fb").alias("b"))
    return similarity.two_stage(s1, same.union(across)).toDF("page_id", "cluster")


def _kinds():
    return F.transform(F.split("content", "\n"), lambda l: F.when(F.contains(l, F.lit("](")), "a").when(F.startswith(l, F.lit("- ")), "li").when(F.length(l) > 120, "p").when(l.rlike("^ ?[0-9]"), "tr").otherwise("div"))


@query()
def structure_clusters(t):
    """Pages clustered by structure (sequences of line kinds, 0.8), clusters of more than 10 then split by near-equal text (0.4) inside them."""
    d = cut(t.page_content.filter("content is not null and content <> ''").select("page_id", _kinds().alias("tags")))
    first = cut(similarity.structure_groups(d, "page_id", "tags", 0.8))
    s = _sets(t)
    inside = similarity.links_inside(s, "page_id", "s", first, 0.4)
    return similarity.two_stage(first, inside).toDF("page_id", "cluster")


# ---- markup (pages rebuilt as HTML from page_content) ----
def _html(t):
    li = F.regexp_replace("content", r"\[([^\]]*)\]\(([^)]*)\)", '<li><a href="$2">$1</a></li>')
    return t.page_content.filter("content is not null").select("page_id", "url", "content", F.concat(F.lit("<html><head><title>"), F.coalesce("host", F.lit("")), F.lit('</title><script>var p = "</p>";</script></head><body><p>'), li, F.lit("</p></body></html>")).alias("html"))


_HTML = """h AS (SELECT page_id, '<html><head><title>' || coalesce(host, '') || '</title><script>var p = "</p>";</script></head><body><p>' || regexp_replace(content, '\\[([^\\]]*)\\]\\(([^)]*)\\)', '<li><a href="\\2">\\1</a></li>', 'g') || '</p></body></html>' AS html FROM page_content WHERE content IS NOT NULL)"""
_BARE = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"


@query(f"WITH {_HTML} SELECT page_id, md5(trim(regexp_replace(regexp_replace({_BARE}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM h")
def html_text(t):
    return _html(t).select("page_id", F.md5(F.encode(T.html_to_text(col("html")), "UTF-8")).alias("digest"))


@query()
def html_document_text(t):
    """Text nodes, meta contents and input values of rebuilt pages in document order, by the HTML parser."""
    return _html(t).select("page_id", H.texts_udf()("html").alias("texts")).select("page_id", F.md5(F.encode(F.array_join("texts", "|"), "UTF-8")).alias("digest"))


@query()
def html_marked_text(t):
    """Rebuilt pages as markdown-like text with links kept."""
    return _html(t).select("page_id", F.md5(F.encode(H.marked_udf()("html"), "UTF-8")).alias("digest"))


@query("""SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: length(l) BETWEEN 1 AND 199), chr(10))) AS digest FROM page_content WHERE content IS NOT NULL""")
def clean_lines(t):
    return t.page_content.filter("content is not null").select("page_id", F.md5(F.encode(T.clean_lines(col("content")), "UTF-8")).alias("digest"))


@query(f"WITH {_HTML} SELECT page_id, array_to_string(list_transform(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x)), ' ') AS tags FROM h")
def tag_sequence(t):
    return _html(t).select("page_id", F.array_join(T.opening_tags(col("html")), " ").alias("tags"))


@query()
def tag_similarity(t):
    """Pages by their sequence of line kinds, as classes of equal sequences with the number of similar classes."""
    d = t.page_content.filter("content is not null and content <> ''").select("page_id", _kinds().alias("tags"))
    l = cut(similarity.tag_links(d, "page_id", "tags", 0.8))
    rep = d.groupBy(F.md5(F.encode(F.array_join("tags", " "), "UTF-8")).alias("h")).agg(F.min("page_id").alias("rep"))
    deg = l.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return d.select("page_id", F.md5(F.encode(F.array_join("tags", " "), "UTF-8")).alias("h")).join(rep, "h").join(deg, "rep", "left").select("page_id", col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


@query("SELECT page_id, x[1] AS label, x[2] AS href FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(content, '\\[[^\\]]*\\]\\([^)]*\\)', 0), lambda m: [regexp_extract(m, '\\[([^\\]]*)\\]', 1), regexp_extract(m, '\\]\\(([^)]*)\\)', 1)])) x FROM page_content)")
def list_links(t):
    m = F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\([^)]*\)"), F.lit(0))).alias("m")
    return t.page_content.select("page_id", m).select("page_id", F.regexp_extract("m", r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)]*)\)", 1).alias("href"))


@query("""SELECT DISTINCT row_id, u AS url FROM (SELECT row_id, unnest(regexp_extract_all(coalesce(name, '') || ' ' || coalesce(url, ''), 'https?://[A-Za-z0-9./?=&:_-]+', 0)) u FROM lg_page_info) WHERE contains(lower(u), 'lg') OR contains(lower(u), 'glass')""")
def url_harvest(t):
    d = t.lg_page_info.select("row_id", F.explode(T.absolute_urls(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("url", F.lit(""))))).alias("url"))
    return d.filter(T.keyword_any(col("url"), ["lg", "glass"])).distinct()


@query("""
WITH l AS (SELECT page_id, unnest(string_split(content, chr(10))) line FROM page_content)
SELECT DISTINCT page_id, unnest(regexp_extract_all(line, '\\[[^\\]]*\\]\\(([^)]*)\\)', 1)) AS href FROM l WHERE regexp_matches(regexp_replace(line, '\\]\\([^)]*\\)', ']', 'g'), 'looking glass|Looking Glass|POP|NOC')
""")
def anchored_links(t):
    """Targets of links in the element (here: the line) whose text holds a keyword, by the HTML parser."""
    safe = F.replace("content", F.lit("<"), F.lit("&lt;"))
    li = F.regexp_replace(safe, r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>')
    page = F.concat(F.lit("<div>"), F.replace(li, F.lit("\n"), F.lit("</div><div>")), F.lit("</div>"))
    d = t.page_content.filter("content is not null").select("page_id", H.links_near_udf(["looking glass", "Looking Glass", "POP", "NOC"], exact=True)(page).alias("l"))
    return d.select("page_id", F.explode("l").alias("href")).distinct()


@query("""SELECT page_id, md5(regexp_replace(content, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')) AS digest FROM page_content WHERE content IS NOT NULL""")
def link_demote(t):
    return t.page_content.filter("content is not null").select("page_id", F.md5(F.encode(T.demote_links(col("content"), ["looking glass of nowhere"]), "UTF-8")).alias("digest"))


# ---- keywords ----
_TF = """
 d AS (SELECT doc_id, source, coalesce(lang, '') lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}{4,}', 0) w FROM documents),
 tf AS (SELECT doc_id, w, count(*) tf FROM (SELECT doc_id, unnest(w) w FROM d) GROUP BY 1, 2), n AS (SELECT count(*) n FROM d),
 df AS (SELECT w, count(*) df FROM tf GROUP BY 1), x AS (SELECT doc_id, w, tf * (ln((1 + n) / (1 + df)) + 1) x FROM tf JOIN df USING (w), n),
 l AS (SELECT doc_id, sqrt(sum(x * x)) l FROM x GROUP BY 1), y AS (SELECT doc_id, w, x / l x FROM x JOIN l USING (doc_id))
"""
_DIFF = f"""WITH {_TF}, u AS (SELECT doc_id FROM d WHERE lang <> 'en'), nu AS (SELECT count(*) nu FROM u), dfu AS (SELECT w, count(*) k FROM tf JOIN u USING (doc_id) GROUP BY 1),
 m AS (SELECT w, sum(x) s FROM y WHERE doc_id NOT IN (SELECT doc_id FROM u) GROUP BY 1), o AS (SELECT w AS word, s * ln((nu + 1) / (coalesce(k, 0) + 1)) weight FROM m LEFT JOIN dfu USING (w), nu)"""


def _worded(t):
    return t.documents.select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), T.letters(col("text")).alias("w"))


def _weights(t):
    d = _worded(t)
    return tfidf.differential(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), "doc_id", "w")


@query(f"{_DIFF} SELECT word, round(weight, 5) AS weight FROM o")
def diff_tfidf(t):
    return _weights(t).select("word", F.round("weight", 5).alias("weight"))


@query(f"{_DIFF} SELECT word, round(weight / sum(weight) OVER (), 6) AS share FROM o QUALIFY weight / sum(weight) OVER () > 0.001")
def keyword_share(t):
    return tfidf.shares(cut(_weights(t))).select("word", F.round("share", 6).alias("share"))


_CK = f"""WITH {_TF.replace("FROM documents", "FROM documents WHERE source IS NOT NULL")}, p AS (SELECT d.source c, y.w, sum(x) s, count(*) k FROM y JOIN d ON d.doc_id = y.doc_id GROUP BY 1, 2),
 z AS (SELECT source c, count(*) nc FROM d GROUP BY 1), v AS (SELECT p.c, p.w, s * ln((n - nc + 1) / (df - k + 1)) v FROM p JOIN df USING (w) JOIN z ON z.c = p.c, n),
 q AS (SELECT c, w, v / sum(v) OVER (PARTITION BY c) share FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY share DESC, w) k FROM q WHERE share > 0.0005)"""


def _top(t):
    return tfidf.cluster_keywords(_worded(t), "doc_id", "source", "w", 0.0005, 15)


@query(f"{_CK} SELECT c AS cluster, w AS word, round(share, 6) AS share FROM r WHERE k <= 15")
def cluster_keywords(t):
    return _top(t).select("cluster", "word", F.round("share", 6).alias("share"))


@query(f"{_CK}, k AS (SELECT c, w FROM r WHERE k <= 15) SELECT DISTINCT a.w AS k1, b.w AS k2 FROM k a JOIN k b ON a.c = b.c AND a.w < b.w")
def keyword_pairs(t):
    return joins.word_pairs(_top(t), "cluster", "word")


@query(f"""{_CK}, k AS (SELECT c, w FROM r WHERE k <= 15), big AS (SELECT c FROM k GROUP BY 1 HAVING count(*) >= 4)
SELECT DISTINCT k.c AS cluster, k.w AS word FROM k JOIN big USING (c) WHERE length(k.w) < 15 AND k.w NOT IN (SELECT lower(city) FROM vp_location WHERE city IS NOT NULL)""")
def purify_keywords(t):
    """Keywords without place names and overlong words, of clusters with at least 4 keywords."""
    k = cut(_top(t))
    big = k.groupBy("cluster").count().filter("count >= 4").select("cluster")
    names = t.vp_location.select(F.lower("city").alias("word")).filter("word is not null").distinct()
    return k.join(big, "cluster").filter(F.length("word") < 15).join(names, "word", "left_anti").select("cluster", "word").distinct()


@query(f"""{_CK}, k AS (SELECT c, w FROM r WHERE k <= 15) SELECT DISTINCT '%22' || replace(url_encode(a.w), '%20', '+') || '%22+%22' || replace(url_encode(b.w), '%20', '+') || '%22' AS term FROM k a JOIN k b ON a.c = b.c AND a.w < b.w""")
def search_terms(t):
    return joins.word_pairs(_top(t), "cluster", "word").select(F.url_encode(F.concat(F.lit('"'), "k1", F.lit('" "'), "k2", F.lit('"'))).alias("term")).distinct()
