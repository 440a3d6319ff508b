"""Queries over networks, traces and places."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webobs.functions import net as N
from webobs.functions import text as T
from webobs.functions import urls as U
from webobs.operators import anycast, dedup, geo, interval, joins
from webobs.operators.near import haversine
from webobs.plans.registry import query
from webobs.plans.web import _HOST
from webobs.runtime import cut

col = F.col

# ---- lookups ----
_ORG = "list_filter(string_split(trim(regexp_replace(lower(coalesce(orgname, '')), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda w: length(w) >= 3)"


def _org_words(c):
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= 3)


@query(f"SELECT as_id, unnest({_ORG}) AS token FROM as_info")
def org_tokens(t):
    return t.as_info.select("as_id", F.explode(_org_words(col("orgname"))).alias("token"))


@query(f"SELECT key, array_to_string(list_sort(list_distinct(list(asn))), ',') AS asns FROM (SELECT unnest({_ORG}) AS key, try_cast(asn AS BIGINT) asn FROM as_info) WHERE asn IS NOT NULL GROUP BY key")
def multimap(t):
    d = t.as_info.select(F.explode(_org_words(col("orgname"))).alias("w"), F.expr("try_cast(asn AS bigint)").alias("asn"))
    return dedup.multimap(d, col("w"), col("asn")).select("key", F.array_join("values", ",").alias("asns"))


_FLD = """CASE WHEN len(p) >= 2 AND NOT regexp_matches(h, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN CASE WHEN len(p) >= 3 AND p[-2] IN ('co', 'com', 'net', 'org', 'ac', 'gov') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END END"""


@query(f"""
WITH n AS (SELECT {_HOST.replace("url", "website")} h, asn FROM peeringdb_net), m AS (SELECT {_FLD} fld, asn FROM (SELECT h, asn, string_split(h, '.') p FROM n)),
 by_fld AS (SELECT fld key, list_sort(list_distinct(list(asn))) v FROM m WHERE fld IS NOT NULL AND asn IS NOT NULL GROUP BY 1),
 o AS (SELECT unnest({_ORG}) k, try_cast(asn AS BIGINT) asn FROM as_info), by_org AS (SELECT k key, list_sort(list_distinct(list(asn))) v FROM o WHERE asn IS NOT NULL GROUP BY 1),
 u AS (SELECT row_id, h, CASE WHEN try_cast(regexp_extract(lower(url), '[/.]as([0-9]+)[.]', 1) AS BIGINT) > 0 THEN try_cast(regexp_extract(lower(url), '[/.]as([0-9]+)[.]', 1) AS BIGINT) END rx, {_FLD} fld FROM (SELECT row_id, url, h, string_split(h, '.') p FROM (SELECT row_id, url, {_HOST} h FROM lg_page_info)))
SELECT row_id, coalesce(rx, f.v[1], CASE WHEN len(g.v) = 1 THEN g.v[1] END) AS asn,
 CASE WHEN rx IS NOT NULL THEN 'regex' WHEN f.v IS NOT NULL THEN 'fld' WHEN len(g.v) = 1 THEN 'org' ELSE 'none' END AS how
FROM u LEFT JOIN by_fld f ON f.key = u.fld LEFT JOIN by_org g ON g.key = string_split(u.fld, '.')[1]
""")
def cascade_lookup(t):
    """Number of a site's network: from its address, else by registrable domain, else by an organisation word that means one network only."""
    nets = t.peeringdb_net.select(U.registrable(U.host(col("website"))).alias("r"), "asn")
    by_fld = dedup.multimap(nets, col("r.fld"), col("asn"))
    orgs = t.as_info.select(F.explode(_org_words(col("orgname"))).alias("w"), F.expr("try_cast(asn AS bigint)").alias("asn"))
    by_org = dedup.multimap(orgs, col("w"), col("asn"))
    d = t.lg_page_info.select("row_id", "url", U.registrable(U.host(col("url"))).alias("r")).select("row_id", "url", "r.fld", "r.domain")
    found = U.asn_in(col("url"))
    return joins.cascade(d, [(by_fld, "fld", "fld", True), (by_org, "domain", "org", False)], F.when(found > 0, found)).select("row_id", "asn", "how")


@query("SELECT page_id, url FROM page_content WHERE url NOT IN (SELECT url FROM lg_page_info WHERE url IS NOT NULL) OR url IS NULL")
def anti_seen(t):
    return joins.unseen(t.page_content.select("page_id", "url"), t.lg_page_info, ["url"])


@query("SELECT loc_id, ip_addr FROM vp_location WHERE ip_addr IN (SELECT ip FROM trace_hop WHERE ip IS NOT NULL)")
def semi_active(t):
    return joins.active(t.vp_location.select("loc_id", "ip_addr"), t.trace_hop.select(col("ip").alias("ip_addr")), ["ip_addr"])


@query("""WITH l AS (SELECT url, row_id, name FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id DESC) r FROM lg_page_info) WHERE r = 1)
SELECT v.loc_id, l.row_id, l.name FROM vp_location v JOIN l ON v.url = l.url""")
def inner_lookup(t):
    last = dedup.last_by(t.lg_page_info.select("url", "row_id", "name"), ["url"], "row_id")
    return t.vp_location.select("loc_id", "url").join(last, "url").select("loc_id", "row_id", "name")


@query("SELECT m.site_id AS machine, v.loc_id FROM replica_site m, vp_location v WHERE m.site_index = 0")
def cross_tasks(t):
    """Every probing machine with every vantage point: the task list. Machines are a stated list, counted before they go along."""
    ids = [r[0] for r in t.replica_site.filter("site_index = 0").select("site_id").limit(10_001).collect()]
    if len(ids) > 10_000:
        raise ValueError("more than 10,000 probing machines")
    return t.vp_location.select(F.explode(F.array(*map(F.lit, ids)).cast("array<bigint>")).alias("machine"), "loc_id")


_PAD = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' '"


@query(f"""
WITH n AS (SELECT lower(city) name, min(site_id) ord FROM replica_site GROUP BY 1), v AS (SELECT loc_id, {_PAD.format('hint')} line FROM vp_location WHERE hint IS NOT NULL)
SELECT loc_id, arg_min(name, ord) AS city FROM v JOIN n ON contains(line, {_PAD.format('name')}) GROUP BY loc_id
""")
def contains_join(t):
    names = t.replica_site.groupBy(F.lower("city").alias("name")).agg(F.min("site_id").alias("ord"))
    return joins.contains_first(t.vp_location.filter("hint is not null"), "loc_id", "hint", names, "name", "ord").toDF("loc_id", "city")


# ---- packets in windows (events) ----
# Machines record packets (events, by turns); a service (the user of an event of the first type) is probed in windows around such events.
_EV = "e AS (SELECT event_id, user_id, event_id % 3 AS m, epoch_us(ts) / 1000000.0 AS ts, event_type FROM events), w AS (SELECT m, user_id AS vp, ts - 300 AS s, ts + 600 AS f FROM e WHERE event_type = (SELECT min(event_type) FROM e)), h AS (SELECT e.m, w.vp, e.user_id AS ip FROM e JOIN w ON e.m = w.m AND e.ts > w.s AND e.ts < w.f)"


def _hits(t):
    e = t.events.select("event_id", "user_id", (col("event_id") % 3).alias("m"), (F.unix_micros(col("ts").cast("timestamp")) / 1_000_000).alias("ts"), "event_type")
    kind = e.agg(F.min("event_type")).first()[0]
    w = e.filter(col("event_type") == kind).select("m", col("user_id").alias("vp"), (col("ts") - 300).alias("s"), (col("ts") + 600).alias("f"))
    return interval.interval_join(e.select("m", "ts", col("user_id").alias("ip")), w, "m", "ts", "s", "f", 900.0).select("m", "vp", "ip")


@query(f"WITH {_EV} SELECT m, vp, ip, count(*) AS n FROM h GROUP BY 1, 2, 3")
def interval_join(t):
    return _hits(t).groupBy("m", "vp", "ip").agg(F.count("*").alias("n"))


@query(f"WITH {_EV}, v AS (SELECT vp, ip, count(DISTINCT m) votes FROM h GROUP BY 1, 2) SELECT vp, ip, votes, votes = 3 AS everywhere, votes >= 2 AS often FROM v WHERE votes >= 2")
def vote_threshold(t):
    """Addresses seen in a service's windows by all machines, or by two thirds of them."""
    return _candidates(t)


def _candidates(t):
    return interval.candidates(interval.votes(_hits(t), "vp", "ip", "m"), 3)


@query(f"WITH {_EV} SELECT ip, count(*) AS n FROM (SELECT DISTINCT vp, m, ip FROM h) GROUP BY 1 HAVING count(*) >= 2 AND count(*) >= 0.02 * (SELECT count(DISTINCT vp) FROM h)")
def noise_filter(t):
    return interval.noise(cut(_hits(t)), "vp", "ip", "m", 0.02)


@query(f"""WITH {_EV}, v AS (SELECT vp, ip, count(DISTINCT m) votes FROM h GROUP BY 1, 2), c AS (SELECT vp, ip, votes = 3 e FROM v WHERE votes >= 2)
SELECT vp, ip FROM (SELECT vp, CASE WHEN sum(e::INT) = 1 THEN min(CASE WHEN e THEN ip END) WHEN count(*) = 1 THEN min(ip) END AS ip FROM c GROUP BY vp) WHERE ip IS NOT NULL""")
def assign_first_round(t):
    return interval.first_round(_candidates(t), "vp", "ip")


@query()
def assign_fixpoint(t):
    """The whole ordered assignment, each address given once."""
    return interval.assign(_candidates(t), "vp", "ip")


# ---- addresses ----
_OCT = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_VALID = f"regexp_full_match({{0}}, '{_OCT}\\.{_OCT}\\.{_OCT}\\.{_OCT}')"
_NUM = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"


@query(f"SELECT loc_id, ip_addr, coalesce({_VALID.format('ip_addr')}, false) AS valid FROM vp_location")
def ip_valid(t):
    return t.vp_location.select("loc_id", "ip_addr", N.is_ipv4(col("ip_addr")).alias("valid"))


@query(f"WITH v AS (SELECT loc_id, {_NUM.format('ip_addr')} n FROM vp_location WHERE {_VALID.format('ip_addr')}) SELECT loc_id, p AS prefix, n - n % (1::BIGINT << (32 - p)) AS net FROM v, (SELECT unnest([20, 24, 26, 28, 30]) p)")
def ip_subnets(t):
    v = t.vp_location.filter(N.is_ipv4(col("ip_addr"))).select("loc_id", "ip_addr", F.explode(F.array(*map(F.lit, (20, 24, 26, 28, 30)))).alias("prefix"))
    return v.select("loc_id", "prefix", N.subnet(col("ip_addr"), col("prefix")).alias("net"))


_BOGON = " OR ".join("n BETWEEN {} AND {}".format(*N.cidr_range(c)) for c in N.BOGONS)


@query(f"WITH v AS (SELECT loc_id, ip_addr, CASE WHEN {_VALID.format('ip_addr')} THEN {_NUM.format('ip_addr')} END n FROM vp_location) SELECT loc_id, coalesce({_BOGON}, false) AS bogon, coalesce(ip_addr <> '' AND NOT coalesce({_BOGON}, false), false) AS known FROM v")
def bogon_filter(t):
    b = N.is_bogon(col("ip_addr"))
    return t.vp_location.select("loc_id", b.alias("bogon"), F.coalesce((col("ip_addr") != "") & ~b, F.lit(False)).alias("known"))


@query(f"""
WITH h AS (SELECT DISTINCT {_NUM.format('ip')} n FROM trace_hop WHERE {_VALID.format('ip')}),
 x AS (SELECT loc_id, {_NUM.format('ip_addr')} n, CASE WHEN loc_id % 2 = 0 THEN 24 ELSE 26 END p FROM vp_location WHERE {_VALID.format('ip_addr')}), nets AS (SELECT n - n % (1::BIGINT << (32 - p)) lo, p, min(loc_id) v FROM x GROUP BY 1, 2)
SELECT h.n AS ip_n, arg_max(v, p) AS loc_id FROM h LEFT JOIN nets ON h.n BETWEEN lo AND lo + (1::BIGINT << (32 - p)) - 1 GROUP BY h.n
""")
def cidr_lpm(t):
    """The longest network of a vantage point (/24 or /26) that holds each answering address."""
    ips = t.trace_hop.filter(N.is_ipv4(col("ip"))).select(N.ip_number(col("ip")).alias("ip_n")).distinct()
    p = F.when(col("loc_id") % 2 == 0, 24).otherwise(26)
    nets = t.vp_location.filter(N.is_ipv4(col("ip_addr"))).select("loc_id", p.alias("p"), N.subnet(col("ip_addr"), p).alias("lo"))
    return joins.longest_prefix(ips, "ip_n", nets, "lo", "p", "loc_id").select("ip_n", "loc_id")


@query(f"""
WITH h AS (SELECT DISTINCT {_NUM.format('ip')} n FROM trace_hop WHERE {_VALID.format('ip')}), x AS (SELECT loc_id, {_NUM.format('ip_addr')} n FROM vp_location WHERE {_VALID.format('ip_addr')}),
 a AS (SELECT n - n % 64 lo, min(loc_id) v FROM x GROUP BY 1), b AS (SELECT n - n % 1024 lo, min(loc_id) v FROM x GROUP BY 1)
SELECT h.n AS ip_n, coalesce(a.v, b.v) AS loc_id FROM h LEFT JOIN a ON a.lo = h.n - h.n % 64 LEFT JOIN b ON b.lo = h.n - h.n % 1024
""")
def prefix_fallback(t):
    """The vantage point of each answering address by a table of /26 networks, else by one of /22 networks."""
    ips = t.trace_hop.filter(N.is_ipv4(col("ip"))).select(N.ip_number(col("ip")).alias("ip_n")).distinct()
    table = lambda p: t.vp_location.filter(N.is_ipv4(col("ip_addr"))).select("loc_id", F.lit(p).alias("p"), N.subnet(col("ip_addr"), p).alias("lo"))
    return joins.prefix_or_fallback(ips, "ip_n", [table(26), table(22)], "lo", "p", "loc_id").select("ip_n", "loc_id")


@query("WITH d AS (SELECT lower(target_host) AS host, array_to_string(list_sort(list(DISTINCT dest_ip)), ',') AS ips FROM trace_hop WHERE target_host IS NOT NULL AND dest_ip IS NOT NULL GROUP BY 1) SELECT DISTINCT t.trace_id, d.ips FROM trace_hop t JOIN d ON d.host = lower(t.target_host)")
def dns_table(t):
    """The known addresses of each trace's target, by a table of names."""
    d = dedup.multimap(t.trace_hop, F.lower("target_host"), col("dest_ip"))
    return t.trace_hop.select("trace_id", F.lower("target_host").alias("key")).distinct().join(d, "key").select("trace_id", F.array_join("values", ",").alias("ips")).distinct()


# ---- traces ----
@query("SELECT trace_id, ip, min(rtt) AS rtt, min(hop_index) AS hop_index FROM trace_hop WHERE ip IS NOT NULL AND rtt IS NOT NULL GROUP BY 1, 2")
def hop_min_rtt(t):
    return anycast.least_rtt(t.trace_hop)


@query("SELECT trace_id, coalesce(bool_or(ip = dest_ip), false) AS reached FROM trace_hop GROUP BY 1")
def trace_success(t):
    return t.trace_hop.groupBy("trace_id").agg(F.coalesce(F.bool_or(col("ip") == col("dest_ip")), F.lit(False)).alias("reached"))


@query("SELECT trace_id, count(DISTINCT ip) AS hops, round(min(rtt), 3) AS least FROM trace_hop WHERE ip IS NOT NULL AND rtt IS NOT NULL GROUP BY 1")
def trace_fold(t):
    """Traces written as text, one line a hop, and parsed back."""
    from webobs.functions.traces import parse_trace

    h = t.trace_hop.filter("ip is not null and rtt is not null").select("trace_id", "hop_index", "ip", "rtt").distinct()
    line = F.concat_ws(" ", col("hop_index").cast("string"), "ip", F.format_string("%.3f ms", "rtt"))
    d = h.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop_index", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    p = d.select("trace_id", parse_trace(F.concat(F.lit("traceroute to x (0.0.0.0), 30 hops max\n"), col("text"))).alias("p"))
    return p.select("trace_id", F.size("p.hops").cast("long").alias("hops"), F.round(F.array_min(F.transform("p.hops", lambda x: x["rtt"])), 3).alias("least"))


@query(f"SELECT trace_id FROM trace_hop GROUP BY 1 HAVING max(hop_index) <= 64 AND bool_and(is_successful) AND NOT coalesce(bool_or(NOT {_VALID.format('ip')}), false)")
def purify_traces(t):
    return anycast.usable_traces(t.trace_hop)


_SECOND = "d AS (SELECT DISTINCT trace_id, hop_index, ip, loc_id, dest_ip, rtt FROM trace_hop WHERE ip IS NOT NULL AND dest_ip IS NOT NULL), s AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY trace_id ORDER BY hop_index DESC) r FROM d) WHERE r = 2)"


@query(f"WITH {_SECOND} SELECT DISTINCT trace_id, hop_index, ip FROM s")
def second_max_hop(t):
    h = t.trace_hop.filter("ip is not null and dest_ip is not null").select("trace_id", "hop_index", "ip").distinct()
    return anycast.second_last(h, ["trace_id"])


@query(f"WITH h AS (SELECT *, CASE WHEN {_VALID.format('ip')} THEN {_NUM.format('ip')} END n FROM trace_hop WHERE ip IS NOT NULL AND hostname IS NOT NULL) SELECT ip, hostname, count(DISTINCT loc_id) AS vantages FROM h WHERE NOT coalesce({_BOGON.replace('OR n BETWEEN 3323068416 AND 3323199487 ', '')}, false) GROUP BY 1, 2")
def inverted_index(t):
    """Names by address; the benchmark range these tables live in isn't taken as bogon here."""
    h = t.trace_hop.filter(F.col("ip").isNotNull() & F.col("hostname").isNotNull() & ~N.is_bogon(F.col("ip"), [b for b in N.BOGONS if b != "198.18.0.0/15"]))
    return h.groupBy("ip", "hostname").agg(F.count_distinct("loc_id").alias("vantages"))


_ENDS = """f AS (SELECT trace_id, ip, min(hop_index) hop_index FROM trace_hop WHERE dest_ip IS NOT NULL AND ip IS NOT NULL AND rtt IS NOT NULL GROUP BY 1, 2),
 q AS (SELECT trace_id, min(loc_id) loc_id, min(dest_ip) dest_ip FROM trace_hop GROUP BY 1), h AS (SELECT * FROM f JOIN q USING (trace_id)), o AS (SELECT trace_id FROM h WHERE ip = dest_ip),
 s AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY trace_id ORDER BY hop_index DESC) r FROM h WHERE trace_id IN (SELECT trace_id FROM o)) WHERE r = 2 AND ip <> dest_ip)"""


@query(f"WITH {_ENDS} SELECT dest_ip, {_NUM.format('ip')} - {_NUM.format('ip')} % 256 AS net, array_to_string(list_sort(list_distinct(list(loc_id))), ',') AS vantages FROM s WHERE {_VALID.format('ip')} GROUP BY 1, 2")
def site_groups(t):
    e = anycast.end_networks(t.trace_hop, 24).filter("net is not null")
    return e.groupBy("dest_ip", "net").agg(F.array_join(F.array_sort(F.collect_set("loc_id")), ",").alias("vantages"))


def _candidates_of(t, hops, rtts, own=None):
    """(target = dest_ip, vantage, site_id, way): replica sites each vantage's traces to a destination allow, by verified middle hops."""
    v = _points(t).select(col("loc_id").alias("vantage"), col("latitude").alias("v_lat"), col("longitude").alias("v_lon"))
    ends = rtts.select(col("dest_ip").alias("target"), col("loc_id").alias("vantage"), "rtt").join(v, "vantage")
    h = hops.filter("ip is not null and rtt is not null and ip <> dest_ip").select(col("dest_ip").alias("target"), col("loc_id").alias("vantage"), "hop_index", "ip", "hostname", "rtt")
    d = cut(_dictionary(t))
    part = F.split("hostname", r"\.")[1]
    short = d.groupBy(F.substring("city", 1, 3).alias("code")).agg(F.max_by(F.struct("lat", "lon"), F.struct("population", "city")).alias("m"))
    by_name = h.filter("hostname is not null").select("hostname").distinct().join(short, part == col("code")).select("hostname", "m.lat", "m.lon")
    at = _points(t).filter(N.is_ipv4(col("ip_addr"))).groupBy(N.subnet(col("ip_addr"), 24).alias("net")).agg(F.min_by(F.struct(col("latitude").alias("lat"), col("longitude").alias("lon")), "loc_id").alias("m")).select("net", "m.lat", "m.lon")
    if own is not None:
        h = h.withColumn("__n", N.subnet(col("ip"), 30)).join(own, ["target", "vantage", "__n"], "left").drop("__n")
    middle = cut(geo.verified_hops(h, v, by_name, at))
    return geo.site_candidates(ends, middle, _sites(t))


def _anycast(t):
    """(groups, rtts, located): the greedy groups at /30 of destinations with several, round trips, and where the groups lie."""
    hops = t.trace_hop.join(anycast.usable_traces(t.trace_hop), "trace_id", "left_semi")
    e = cut(anycast.end_networks(hops, 30))
    g = cut(anycast.site_groups(e, "dest_ip", "loc_id", "net"))
    many = g.groupBy("dest_ip").agg(F.count_distinct("site").alias("sites")).filter("sites > 1").select("dest_ip")
    g = cut(g.join(many, "dest_ip"))
    rtts = anycast.reached(hops)
    # The networks that founded a vantage's site: hops inside them aren't placed by address.
    own = g.join(e.select("dest_ip", col("loc_id").alias("site"), col("net").alias("__n")), ["dest_ip", "site"]).select(col("dest_ip").alias("target"), col("loc_id").alias("vantage"), "__n", F.lit(True).alias("own")).filter("__n is not null").distinct()
    only = hops.join(g.select("dest_ip", "loc_id").distinct(), ["dest_ip", "loc_id"], "left_semi")
    c = _candidates_of(t, only, rtts.join(many, "dest_ip"), own).select(col("target").alias("dest_ip"), col("vantage").alias("loc_id"), "site_id")
    v = _points(t).select(col("loc_id").alias("vantage"), col("latitude").alias("lat"), col("longitude").alias("lon"))
    return g, rtts, anycast.geolocated(g, rtts, v, _sites(t), c)


@query()
def anycast_sites(t):
    """Destinations with several sites at /30: greedy groups of vantages, and the replica site where each lies, if one is found."""
    g, _, at = _anycast(t)
    n = g.groupBy("dest_ip", "site").agg(F.count("*").alias("vantages"))
    return n.join(at, ["dest_ip", "site"], "left").select("dest_ip", "site", "vantages", "site_id", "how", "votes")


@query()
def vantage_report(t):
    """Each vantage of a usable trace: the replica site it reached last (by destination and group), and its least round trip to any destination."""
    g, rtts, at = _anycast(t)
    last = g.join(at, ["dest_ip", "site"]).groupBy("loc_id").agg(F.max_by("site_id", F.struct("dest_ip", "site")).alias("reached_site"))
    return rtts.groupBy("loc_id").agg(F.min("rtt").alias("rtt")).join(last, "loc_id", "left").select("loc_id", "rtt", "reached_site")


@query("SELECT dest_ip, array_to_string(list_sort(list(DISTINCT target_host)), ',') AS hosts FROM trace_hop WHERE dest_ip IS NOT NULL AND target_host IS NOT NULL GROUP BY 1")
def destination_names(t):
    return anycast.destination_names(t.trace_hop).select("dest_ip", F.array_join("hosts", ",").alias("hosts"))


# ---- places ----
_DIST = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_VR = _DIST.format("v.latitude", "v.longitude", "s.latitude", "s.longitude")
_P = "v AS (SELECT * FROM vp_location WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)"


def _points(t):
    return t.vp_location.filter("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")


def _sites(t):
    return t.replica_site.select("site_id", "provider", col("latitude").alias("s_lat"), col("longitude").alias("s_lon"), col("country_code").alias("s_cc"), col("city").alias("s_city"))


@query(f"WITH {_P} SELECT v.loc_id, round({_VR}, 6) AS km FROM v, replica_site s WHERE s.site_id = (SELECT min(site_id) FROM replica_site)", name="haversine")
def haversine_km(t):
    at = _sites(t).agg(F.min_by(F.struct("s_lat", "s_lon"), "site_id").alias("m")).first()["m"]
    if at is None:
        return _points(t).select("loc_id", F.lit(0.0).alias("km")).limit(0)
    return _points(t).select("loc_id", F.round(haversine(col("latitude"), col("longitude"), F.lit(at["s_lat"]), F.lit(at["s_lon"])), 6).alias("km"))


@query(f"WITH {_P}, d AS (SELECT v.loc_id, s.site_id, round({_VR}, 6) km FROM v, replica_site s) SELECT loc_id, site_id, km AS dist FROM (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY km, site_id) r FROM d) WHERE r = 1")
def nearest_site(t):
    return geo.nearest(_points(t), ["loc_id"], _sites(t), "site_id")


@query(f"""WITH {_P}, g AS (SELECT {_NUM.format('ip_addr')} - {_NUM.format('ip_addr')} % 256 net, arg_min(latitude, loc_id) latitude, arg_min(longitude, loc_id) longitude FROM v WHERE {_VALID.format('ip_addr')} GROUP BY 1),
 h AS (SELECT DISTINCT ip FROM trace_hop WHERE {_VALID.format('ip')}), v2 AS (SELECT h.ip, g.latitude, g.longitude FROM h JOIN g ON g.net = {_NUM.format('ip')} - {_NUM.format('ip')} % 256),
 d AS (SELECT v.ip, s.site_id, round({_VR}, 6) km FROM v2 v, replica_site s) SELECT ip, site_id FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY km, site_id) r FROM d) WHERE r = 1""")
def ip_nearest_site(t):
    """Place of each answering address by its network, then the site nearest to that place."""
    g = _points(t).filter(N.is_ipv4(col("ip_addr"))).groupBy(N.subnet(col("ip_addr"), 24).alias("net")).agg(F.min_by(F.struct("latitude", "longitude"), "loc_id").alias("m")).select("net", "m.*")
    h = t.trace_hop.filter(N.is_ipv4(col("ip"))).select("ip").distinct().withColumn("net", N.subnet(col("ip"), 24))
    return geo.nearest(h.join(g, "net"), ["ip"], _sites(t), "site_id").select("ip", "site_id")


_RTT = "r AS (SELECT loc_id, min(rtt) rtt FROM trace_hop WHERE ip = dest_ip AND rtt IS NOT NULL GROUP BY 1)"


def _reached(t):
    return t.trace_hop.filter("ip = dest_ip and rtt is not null").groupBy("loc_id").agg(F.min("rtt").alias("rtt"))


@query(f"WITH {_P}, {_RTT} SELECT v.loc_id, count(*) AS sites FROM v JOIN r USING (loc_id), replica_site s WHERE {_VR} <= rtt * 100 GROUP BY 1")
def distance_join(t):
    d = geo.sites_within(_points(t).join(_reached(t), "loc_id"), ["loc_id"], _sites(t), "site_id", col("rtt") * geo.KM_PER_MS)
    return d.groupBy("loc_id").agg(F.count("*").alias("sites"))


@query(f"""WITH {_P}, q AS (SELECT DISTINCT h.target_host, v.latitude, v.longitude, min(h.rtt) OVER (PARTITION BY h.target_host, v.loc_id) rtt FROM trace_hop h JOIN v USING (loc_id) WHERE h.ip = h.dest_ip AND h.rtt IS NOT NULL),
 c AS (SELECT DISTINCT target_host, site_id FROM q, replica_site)
SELECT target_host, site_id FROM c WHERE NOT EXISTS (SELECT 1 FROM q v JOIN replica_site s ON s.site_id = c.site_id WHERE v.target_host = c.target_host AND NOT ({_VR} <= v.rtt * 100))""")
def forall_join(t):
    """Sites every vantage's round trip to a host allows."""
    h = t.trace_hop.filter("ip = dest_ip and rtt is not null").groupBy("target_host", "loc_id").agg(F.min("rtt").alias("rtt"))
    q = h.join(_points(t).select("loc_id", "latitude", "longitude"), "loc_id").select("target_host", "latitude", "longitude", "rtt")
    return geo.allowed_by_all(q, "target_host", _sites(t), "site_id")


@query(f"""WITH {_P}, {_RTT}, d AS (SELECT v.loc_id, s.site_id, round(abs({_VR} - rtt * 66.7), 6) x FROM v JOIN r USING (loc_id), replica_site s)
SELECT loc_id, site_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY x, site_id) AS rank FROM d) WHERE rank <= 3""")
def residual_top3(t):
    return geo.top_sites(_points(t).join(_reached(t), "loc_id"), ["loc_id"], _sites(t), "site_id", 3, target=col("rtt") * 66.7).select("loc_id", "site_id", "rank")


@query(f"""WITH {_P}, d AS (SELECT v.loc_id, s.site_id, round({_VR}, 6) km, v.country_code = s.country_code same, substring(v.country_code, 1, 1) = substring(s.country_code, 1, 1) cont FROM v, replica_site s),
 u AS (SELECT loc_id, site_id, km, 'all' scope FROM d UNION ALL SELECT loc_id, site_id, km, 'country' FROM d WHERE same UNION ALL SELECT loc_id, site_id, km, 'continent' FROM d WHERE cont)
SELECT loc_id, scope, rank, site_id FROM (SELECT *, row_number() OVER (PARTITION BY loc_id, scope ORDER BY km, site_id) AS rank FROM u) WHERE rank <= 3""")
def top3_scopes(t):
    p, s = _points(t), _sites(t).withColumn("s_cont", F.substring("s_cc", 1, 1))
    scopes = {"all": None, "country": (col("country_code"), "s_cc"), "continent": (F.substring("country_code", 1, 1), "s_cont")}
    parts = [geo.top_sites(p, ["loc_id"], s, "site_id", 3, scope=x).select("loc_id", F.lit(n).alias("scope"), "rank", "site_id") for n, x in scopes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH h AS (SELECT DISTINCT trace_id, hop_index, min(rtt) OVER (PARTITION BY trace_id, hop_index) rtt FROM trace_hop WHERE rtt IS NOT NULL)
SELECT trace_id, hop_index, round(greatest(abs(rtt - lag(rtt) OVER (PARTITION BY trace_id ORDER BY hop_index DESC)), 0.3), 6) AS gap FROM h""")
def rtt_gap(t):
    h = t.trace_hop.filter("rtt is not null").groupBy("trace_id", "hop_index").agg(F.min("rtt").alias("rtt"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("hop_index"))  # the hops of one trace
    gap = F.greatest(F.abs(col("rtt") - F.lag("rtt").over(w)), F.lit(0.3))
    return h.select("trace_id", "hop_index", F.round(gap, 6).alias("gap"))


@query(f"""WITH {_P}, d AS (SELECT v.loc_id, s.site_id, round({_VR}, 6) km FROM v, replica_site s), n AS (SELECT loc_id, site_id FROM (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY km, site_id) r FROM d) WHERE r = 1),
 c AS (SELECT h.target_host, n.site_id, count(DISTINCT h.loc_id) k FROM trace_hop h JOIN n USING (loc_id) WHERE h.is_successful GROUP BY 1, 2)
SELECT target_host, site_id, k AS votes FROM (SELECT *, row_number() OVER (PARTITION BY target_host ORDER BY k DESC, site_id) r FROM c) WHERE r = 1""")
def location_vote(t):
    n = geo.nearest(_points(t), ["loc_id"], _sites(t), "site_id").select("loc_id", "site_id")
    c = t.trace_hop.filter("is_successful").select("target_host", "loc_id").distinct().join(n, "loc_id").groupBy("target_host", "site_id").agg(F.count("*").alias("votes"))
    return c.groupBy("target_host").agg(F.max_by(F.struct("site_id", "votes"), F.struct("votes", -col("site_id"))).alias("m")).select("target_host", "m.site_id", "m.votes")


@query("SELECT lower(city) AS city, count(*) AS n, max(latitude) - min(latitude) <= 0.5 AND max(longitude) - min(longitude) <= 0.5 AS one_place FROM vp_location WHERE city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1")
def coord_spread(t):
    near = lambda c: F.max(c) - F.min(c) <= 0.5
    return t.vp_location.filter("city is not null and latitude is not null and longitude is not null").groupBy(F.lower("city").alias("city")).agg(F.count("*").alias("n"), (near("latitude") & near("longitude")).alias("one_place"))


@query("WITH c AS (SELECT lower(city) city, country_code, count(*) n FROM vp_location WHERE city IS NOT NULL AND country_code IS NOT NULL GROUP BY 1, 2) SELECT city, country_code FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, country_code DESC) r FROM c) WHERE r = 1")
def max_population(t):
    """Of places of one name, the one with the most vantage points."""
    c = t.vp_location.filter("city is not null and country_code is not null").groupBy(F.lower("city").alias("city"), "country_code").agg(F.count("*").alias("n"))
    return c.groupBy("city").agg(F.max_by("country_code", F.struct("n", "country_code")).alias("country_code"))


@query("WITH m AS (SELECT DISTINCT country_code, 'C' || substring(country_code, 2, 1) AS continent FROM replica_site) SELECT v.loc_id, coalesce(m.continent, 'Unknown') AS continent FROM vp_location v LEFT JOIN m USING (country_code)")
def continent_lookup(t):
    m = t.replica_site.select("country_code", F.concat(F.lit("C"), F.substring("country_code", 2, 1)).alias("continent")).distinct()
    return t.vp_location.join(m, "country_code", "left").select("loc_id", F.coalesce("continent", F.lit("Unknown")).alias("continent"))


@query("SELECT url, count(DISTINCT (latitude, longitude)) AS places FROM vp_location WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1")
def distinct_locations(t):
    return t.vp_location.filter("latitude is not null and longitude is not null").groupBy("url").agg(F.count_distinct("latitude", "longitude").alias("places"))


@query("SELECT city || '_' || country_code AS place, array_to_string(list_sort(list(ip_addr)), ',') AS ips FROM vp_location WHERE city IS NOT NULL AND country_code IS NOT NULL AND ip_addr IS NOT NULL GROUP BY 1")
def group_concat(t):
    d = t.vp_location.filter("city is not null and country_code is not null and ip_addr is not null")
    return d.groupBy(F.concat_ws("_", "city", "country_code").alias("place")).agg(F.array_join(F.array_sort(F.collect_list("ip_addr")), ",").alias("ips"))


@query("SELECT ip_addr, max(loc_id) AS loc_id, count(*) AS n FROM vp_location WHERE ip_addr IS NOT NULL GROUP BY 1")
def last_per_key(t):
    return t.vp_location.filter("ip_addr is not null").groupBy("ip_addr").agg(F.max("loc_id").alias("loc_id"), F.count("*").alias("n"))


@query("WITH c AS (SELECT url, country_code, count(*) n, min(loc_id) f FROM vp_location WHERE country_code IS NOT NULL GROUP BY 1, 2) SELECT url, country_code, n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, f) r FROM c) WHERE r = 1")
def mode_first(t):
    return dedup.mode_first(t.vp_location, "url", "country_code", "loc_id")


@query(f"""WITH s AS (SELECT loc_id, {_NUM.format('ip_addr')} n FROM vp_location WHERE {_VALID.format('ip_addr')} AND latitude IS NOT NULL), g AS (SELECT n - n % 4096 net, min(loc_id) first_id FROM s GROUP BY 1),
 c AS (SELECT lower(city) city, min(site_id) site FROM replica_site GROUP BY 1)
SELECT v.loc_id, CASE WHEN coalesce(v.ip_addr, '') <> '' THEN 'ip:' || g.first_id ELSE 'city:' || c.site END AS place FROM vp_location v
 LEFT JOIN g ON g.net = CASE WHEN {_VALID.format('v.ip_addr')} THEN {_NUM.format('v.ip_addr')} - {_NUM.format('v.ip_addr')} % 4096 END LEFT JOIN c ON c.city = lower(v.hint)""")
def ip_else_hint(t):
    """A place by address where there is one (even if that finds none), else by hint."""
    g = t.vp_location.filter(N.is_ipv4(col("ip_addr")) & col("latitude").isNotNull()).groupBy(N.subnet(col("ip_addr"), 20).alias("net")).agg(F.min("loc_id").alias("at"))
    c = t.replica_site.groupBy(F.lower("city").alias("place")).agg(F.min("site_id").alias("site"))
    v = t.vp_location.select("loc_id", "ip_addr", N.subnet(col("ip_addr"), 20).alias("net"), F.lower("hint").alias("place"))
    by = F.when(F.coalesce("ip_addr", F.lit("")) != "", F.concat(F.lit("ip:"), "at")).otherwise(F.concat(F.lit("city:"), "site"))
    return v.join(g, "net", "left").join(c, "place", "left").select("loc_id", by.alias("place"))


@query("""
WITH h AS (SELECT loc_id, regexp_replace(lower(coalesce(hint, '')), '[0-9]', '', 'g') h FROM vp_location),
 p AS (SELECT loc_id, CASE WHEN contains(h, '(as') THEN []::VARCHAR[] WHEN contains(h, ',') THEN list_concat(list_transform(string_split(h, ','), lambda x: replace(trim(x, ' '), '-', '')), flatten(list_transform(string_split(h, ','), lambda x: string_split(trim(x, ' '), '-'))))
  ELSE regexp_split_to_array(h, '[\\s!-/:-@\\[-`{-~]+') END t FROM h)
SELECT loc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(t, lambda x: trim(x, ' ')), lambda x: x <> ''))), '|') AS tokens FROM p
""")
def hint_tokens(t):
    return t.vp_location.select("loc_id", F.array_join(T.split_hint(col("hint")), "|").alias("tokens"))


def _dictionary(t):
    c = t.vp_location.filter("city is not null and latitude is not null and longitude is not null")
    return c.groupBy(F.lower("city").alias("city"), F.lower("country_code").alias("admin")).agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count("*").alias("population"))


@query()
def hint_place(t):
    """The place each hint names, by a dictionary of the vantage points' own cities (the most populous of a name)."""
    d = cut(_dictionary(t))
    codes = d.select(F.substring("city", 1, 3).alias("code"), "city").groupBy("code").agg(F.min("city").alias("city"))
    return geo.hint_places(t.vp_location.filter("hint is not null").select(col("loc_id").alias("id"), "hint"), d, codes, spread=None).select(col("id").alias("loc_id"), "city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query()
def site_candidates(t):
    """Replica sites each vantage's traces to a destination allow, by verified middle hops."""
    return _candidates_of(t, t.trace_hop, anycast.reached(t.trace_hop)).select(col("target").alias("dest_ip"), col("vantage").alias("loc_id"), "site_id", "way")
