"""Queries over scores, rules, slices and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from webobs.functions import text as T
from webobs.functions import urls as U
from webobs.operators import classify, slices
from webobs.plans.registry import query


col = F.col

# ---- scores ----
_S1 = "CASE WHEN contains(lower(coalesce(url, '') || ': ' || coalesce(content, '')), 'looking glass') THEN 2 ELSE 1 END"
_S2 = "CASE WHEN contains(lower(coalesce(content, '')), 'traceroute') THEN 2 ELSE 1 END"


def _labels(t):
    seen = classify.with_url(col("url"), col("content"))
    has = lambda c, w: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)), 2).otherwise(1)
    return classify.two_stage(has(seen, "looking glass"), has(col("content"), "traceroute"))


@query(f"SELECT page_id, CASE WHEN {_S1} = 2 THEN {_S2} + 1 ELSE 1 END AS label FROM page_content")
def two_stage_label(t):
    return t.page_content.select("page_id", _labels(t).alias("label"))


@query(f"""WITH m AS (SELECT coalesce(lang, '') lang, coalesce(status_code = 200, false) truth, (CASE WHEN {_S1} = 2 THEN {_S2} + 1 ELSE 1 END) >= 2 said FROM page_content),
 g AS (SELECT lang, sum((truth AND said)::INT) tp, sum((NOT truth AND said)::INT) fp, sum((truth AND NOT said)::INT) fn FROM m GROUP BY 1)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM g""")
def precision_recall(t):
    d = t.page_content.select(F.coalesce("lang", F.lit("")).alias("lang"), (col("status_code") == 200).alias("truth"), (_labels(t) >= 2).alias("said"))
    return classify.metrics(d, "truth", "said", "lang")


_REPLY = "'1-' || (page_id % 3) || ' 2-' || (length(coalesce(content, '')) % 4) || ' 4-' || (page_id % 2)"


@query(f"SELECT page_id, array_to_string([page_id % 3, length(coalesce(content, '')) % 4, 0, page_id % 2], ',') AS feature, 1 AS first FROM page_content")
def parse_features(t):
    """Replies of the form 'slot-value ...' parsed to four slots, and their first integer."""
    n = F.length(F.coalesce("content", F.lit("")))
    reply = F.concat(F.lit("1-"), col("page_id") % 3, F.lit(" 2-"), n % 4, F.lit(" 4-"), col("page_id") % 2)
    return t.page_content.select("page_id", F.array_join(F.transform(T.feature_slots(reply), lambda x: x.cast("string")), ",").alias("feature"), T.first_int(reply).alias("first"))


@query("""WITH d AS (SELECT page_id, 2 * abs(page_id % 3 - page_id % 2) + abs(page_id % 5 - length(coalesce(content, '')) % 5) + abs(page_id % 7 - length(coalesce(url, '')) % 7) AS diff FROM page_content)
SELECT page_id, diff FROM d ORDER BY diff DESC, page_id LIMIT 10""")
def maxdiff_sample(t):
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    p = col("page_id")
    diff = classify.difference(p % 3, p % 2, F.array(p % 5, p % 7).cast("array<int>"), F.array((n("content") % 5), (n("url") % 7)).cast("array<int>"))
    return classify.most_different(t.page_content.select("page_id", "content", "url"), "page_id", diff, 10).select("page_id", "diff")


# ---- rules over forms ----
@query("""SELECT event_id, CASE WHEN event_type LIKE '%c%' AND k % 2 = 0 THEN 'first' WHEN k % 3 = 0 THEN 'second' WHEN value > 50 THEN 'third' END AS rule FROM (SELECT event_id, event_type, value, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) k FROM events)""")
def first_match_rule(t):
    """Ordered rules over a record; the first that applies names it."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    rules = [F.when(F.contains("event_type", F.lit("c")) & (k % 2 == 0), "first"), F.when(k % 3 == 0, "second"), F.when(col("value") > 50, "third")]
    return t.events.select("event_id", F.coalesce(*rules).alias("rule"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ajax' ELSE 'bgpd' END AS rule, 'get' AS method, CASE WHEN page_id % 2 = 0 THEN 'ajax.php' ELSE '/run.php' END AS action, 2 AS options, CASE WHEN page_id % 2 = 0 THEN 'host' ELSE 'req' END AS field FROM page_content")
def form_records(t):
    """Every page's query forms, through the ordered layout rules (pages rebuilt with a form of one of the layouts)."""
    from webobs.functions.forms import form_records as parse

    form = F.concat(F.lit('<form action="/run.php"><select name="cmd"><option value="ping">Ping</option><option value="mtr">MTR</option></select><input name="'), F.when(col("page_id") % 2 == 0, "host").otherwise("req"), F.lit('" placeholder="target"></form><p>IPv4: '), F.coalesce("url", F.lit("")), F.lit("</p>"))
    d = t.page_content.select("page_id", F.explode(parse(form)).alias("r"))
    return d.select("page_id", "r.rule", "r.method", "r.action", F.size("r.command.options").alias("options"), col("r.input.name").alias("field"))


@query()
def harvest_dispatch(t):
    """Addresses of pages by class: of service pages all, of others those in a line with a keyword."""
    from webobs.functions import html as H

    safe = F.replace("content", F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<div>"), F.replace(F.regexp_replace(safe, r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>'), F.lit("\n"), F.lit("</div><div>")), F.lit("</div>"))
    d = t.page_content.filter("content is not null").select("page_id", _labels(t).alias("label"), "content", H.links_near_udf(["looking glass", "noc"])(page).alias("near"))
    return d.select("page_id", F.explode(T.harvested(col("label"), col("content"), col("near"))).alias("url")).distinct()


@query("SELECT p_partkey, contains(lower(p_type), 'c') AS capable FROM part")
def capability_filter(t):
    values = F.split("p_type", " ")
    return t.part.select("p_partkey", F.coalesce(U.pick_option(values, ["c"]).isNotNull(), F.lit(False)).alias("capable"))


@query("""WITH o AS (SELECT p_partkey, coalesce(list_filter(string_split(p_type, ' '), lambda v: contains(lower(v), 'e'))[1], 'ping') AS opt FROM part)
SELECT p_partkey, 'csrf=&q=' || replace(url_encode(opt), '%20', '+') || '&target=' || replace(url_encode('198.18.0.' || (p_partkey % 250)), '%20', '+') AS body FROM o""")
def probe_params(t):
    opt = U.pick_option(F.split("p_type", " "), ["e"], "ping")
    body = U.probe_form(F.create_map(F.lit("csrf"), F.lit("")), F.lit("q"), opt, F.lit("target"), F.concat(F.lit("198.18.0."), (col("p_partkey") % 250).cast("string")))
    return t.part.select("p_partkey", body.alias("body"))


@query("""WITH o AS (SELECT p_partkey, coalesce(list_filter(string_split(p_type, ' '), lambda v: contains(lower(v), 'e'))[1], 'ping') AS opt FROM part)
SELECT p_partkey, '{"csrf":"","q":"' || opt || '","target":"198.18.0.' || (p_partkey % 250) || '"}' AS body, 'https://lg' || (p_partkey % 7) || '.example' AS origin,
 'https://lg' || (p_partkey % 7) || '.example/' AS referer FROM o""")
def probe_request(t):
    """The request of a posting form: a JSON body, and the headers that say where it comes from."""
    opt = U.pick_option(F.split("p_type", " "), ["e"], "ping")
    body = U.probe_json(F.create_map(F.lit("csrf"), F.lit("")), F.lit("q"), opt, F.lit("target"), F.concat(F.lit("198.18.0."), (col("p_partkey") % 250).cast("string")))
    h = U.probe_headers(F.concat(F.lit("https://lg"), col("p_partkey") % 7, F.lit(".example"), F.when(col("p_partkey") % 2 == 0, "/").otherwise("")), F.lit("application/json"))
    return t.part.select("p_partkey", body.alias("body"), h["Origin"].alias("origin"), h["Referer"].alias("referer"))


# ---- slices and samples ----
@query("SELECT as_id, row_number() OVER (ORDER BY md5('7|' || as_id)) - 1 AS n FROM as_info")
def hash_shuffle(t):
    """A random order that is the same each time."""
    return slices.shuffled(t.as_info.select("as_id"), col("as_id"), 7)


@query("SELECT row_id, url FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY row_id) r FROM lg_page_info) WHERE r <= 5")
def capped_per_origin(t):
    return slices.capped(t.lg_page_info.select("row_id", "url", "origin"), ["origin"], ["row_id"], 5).select("row_id", "url")


@query("SELECT as_id, (row_number() OVER (ORDER BY coalesce(as_rank, -1) DESC, as_id) - 1) // 20 AS slice FROM as_info")
def priority_slices(t):
    """The queue in falling order of rank number, in slices of 20."""
    d = t.as_info.select("as_id", (-F.coalesce("as_rank", F.lit(-1))).alias("neg"))
    return slices.slices(d, ["neg", "as_id"], 20).select("as_id", "slice")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT AS tile FROM orders")
def slice_ntile(t):
    return slices.tiles(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query("SELECT as_id FROM as_info ORDER BY md5(as_id::VARCHAR) LIMIT 4")
def hash_sample(t):
    return slices.hash_sample(t.as_info.select("as_id"), col("as_id"), 4)


@query("""SELECT DISTINCT asn FROM (SELECT try_cast(asn AS BIGINT) asn FROM as_info) WHERE asn IS NOT NULL AND asn NOT IN (SELECT asn FROM lg_page_info WHERE asn IS NOT NULL)""")
def frontier_round(t):
    q = t.as_info.select(F.expr("try_cast(asn AS bigint)").alias("asn")).filter("asn is not null").distinct()
    return classify.frontier_round(q, t.lg_page_info.filter("asn is not null"), "asn")


# ---- sets ----
_A, _B = "SELECT url FROM lg_page_info", "SELECT url FROM page_content"


@query(f"{_A} UNION {_B}")
def set_union(t):
    return t.lg_page_info.select("url").union(t.page_content.select("url")).distinct()


@query(f"{_A} EXCEPT SELECT url FROM vp_location")
def set_except(t):
    return t.lg_page_info.select("url").subtract(t.vp_location.select("url"))


@query(f"{_A} INTERSECT SELECT url FROM vp_location")
def set_intersect(t):
    return t.lg_page_info.select("url").intersect(t.vp_location.select("url"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def bag_union(t):
    s = t.supplier.select(col("s_suppkey").alias("id"), col("s_name").alias("name"))
    c = t.customer.select(col("c_custkey").alias("id"), col("c_name").alias("name"), col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""SELECT 1 AS source, trim(name, ' ') AS name, trim(looking_glass, ' ') AS url FROM peeringdb_net WHERE trim(coalesce(looking_glass, ''), ' ') <> ''
UNION ALL SELECT 2, trim(name, ' '), trim(url, ' ') FROM lg_page_info WHERE trim(coalesce(url, ''), ' ') <> ''""")
def source_union(t):
    """A registry of collectors, joined in order, each trimmed and without empty addresses."""
    from webobs.sources.readers import Registry

    r = Registry()
    r.add(lambda: t.peeringdb_net.select("name", col("looking_glass").alias("url")))
    r.add(lambda: t.lg_page_info.select("name", "url"))
    return r.collect_all()


@query("SELECT target_host, count(*) AS hops, count(rtt) AS answers, round(min(rtt), 3) AS least FROM trace_hop GROUP BY 1")
def stream_host_summary(t):
    """Hops per target, from the table read as a stream until all of it is seen."""
    from webobs.streaming.incremental import summary_until_now

    return summary_until_now(t._spark, f"{t._d}/trace_hop.parquet", t.trace_hop.schema, "target_host")


@query("SELECT url, min(row_id) AS row_id FROM lg_page_info GROUP BY url", name="stream_first_seen")
def stream_first_seen(t):
    """First row of each address, kept up over batches of a stream against what is already stored."""
    from webobs.streaming.incremental import first_seen_until_now

    return first_seen_until_now(t._spark, f"{t._d}/lg_page_info.parquet", t.lg_page_info.schema, "url", "row_id")


