"""Scalars, parsers and sources on invented fixtures."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from webobs.functions import forms, html, net, text, traces, urls
from webobs.sources import readers


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], ", ".join(f"{k} string" for k in cols) or "z int").select(c).first()[0]


@pytest.mark.parametrize(("url", "want"), [("http://as64500.lg.example/x", 64500), ("https://lg.AS64501.test", 64501), ("http://has5.example", 0), (None, 0), ("http://as99999999999999999999.x/", 0)])
def test_asn(spark, url, want):
    assert one(spark, urls.asn_in(F.col("u")), u=url) == want


def test_url_scalars(spark):
    assert one(spark, urls.filename(F.col("u")), u="https://a.b/c/d/") == "a.b_c_d"
    assert len(one(spark, urls.filename(F.col("u")), u="http://h/" + "x" * 300)) == 200
    assert one(spark, urls.registrable(F.col("u")), u="lg.site.co.example").asDict() == {"fld": "site.co.example", "domain": "site"}
    assert one(spark, urls.registrable(F.col("u")), u="198.18.0.1")["fld"] is None
    assert one(spark, urls.slug(F.col("u")), u="  São  Paulo -- 1! ") == "so_paulo_--_1"
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://a.x/p/q/", l="r") == "http://a.x/p/q/r"
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://a.x", l="/r") == "http://a.x/r"
    assert one(spark, urls.from_breadcrumb(F.col("u")), u="a.x › b › c...") == "https://a.x/b"
    assert one(spark, urls.pick_option(F.array(F.lit("bgp"), F.lit("Trace v4")), ["trace"])) == "Trace v4"
    assert one(spark, urls.pick_option(F.array(F.lit("bgp")), ["trace"], "ping")) == "ping"


def test_net_scalars(spark):
    assert one(spark, net.ip_number(F.col("i")), i="1.2.3.4") == 16909060
    assert one(spark, net.ip_number(F.col("i")), i="1.2.3.400") is None
    assert one(spark, net.is_bogon(F.col("i")), i="10.1.2.3") is True and one(spark, net.is_bogon(F.col("i")), i="nope") is False
    assert one(spark, net.dotted(net.subnet(F.col("i"), 20)), i="8.8.250.9") == "8.8.240.0"


def test_text_scalars(spark):
    assert one(spark, text.keyword_count(F.col("t")), t="Traceroute and PING") == 3
    assert one(spark, text.keyword_count(F.col("t")), t=None) == 0
    assert one(spark, text.shingle_set(text.word_list(F.col("t")), 3), t="a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, text.shingle_set(text.word_list(F.col("t")), 3), t="a b") == []
    assert one(spark, text.feature_slots(F.col("t")), t="1-3 2-0 4-2 4-1") == [3, 0, 0, 1]
    assert one(spark, text.demote_links(F.col("t"), ["glass"]), t="[Looking Glass](/a) [b](/c)") == "[Looking Glass](/a) b"
    assert one(spark, text.split_hint(F.col("t")), t="Sao-Paulo, BR 2") == ["br", "paulo", "sao", "saopaulo"]
    assert one(spark, text.split_hint(F.col("t")), t="Place (AS64500)") == []


PAGE = '<html><head><title>T page</title><meta name="description" content="About this"><meta content="no name"><script>var x = "</p>";</script><style>p{}</style></head><body><p>Some text 12</p><p>12</p><input value="Target host" name="q"><a name="de"></a><ul><li><a href="/x">One</a></li><li>Two</li></ul></body></html>'


def test_html():
    assert html.ordered_texts(PAGE) == ["T page", "About this", "Some text 12", "Target host"]
    assert html.list_after_anchor(PAGE, "de") == [("One", "/x"), ("Two", None)]
    assert "[One](/x)" in html.marked_text(PAGE) and "[Meta]:description:About this" in html.marked_text(PAGE)
    assert html.marked_text("x" * 600_000) is None
    assert html.links_near('<div>our looking glass <b><a href="/lg">here</a></b></div><a href="/no">no</a>', ["looking glass"]) == ["/lg"]
    rows = html.table_rows("<table><tr><td>a</td><td>b</td><td><a href='u'>c</a></td></tr><tr><td>z</td></tr></table>", 3)
    assert rows == [[("a", None), ("b", None), ("c", "u")]]
    for bad in ("", "<", "<a <b>>", "</div></div>", "<p" * 5, "\x00<!--", "<![CDATA["):
        html.ordered_texts(bad), html.marked_text(bad), html.tag_names(bad)


def test_context():
    t = "x " * 2000 + "ping here " + "y " * 2000
    got = html.context(t, ["ping"])
    assert "ping here" in got and len(got) < 500 and html.context("nothing", ["ping"]) is None and html.context("a ping", ["ping"]) == "a ping"


def sel(name, *opts):
    return f'<select name="{name}">' + "".join(f'<option value="{o}">{o.upper()}</option>' for o in opts) + "<option>none</option></select>"


FORMS = {
    "ajax": sel("cmd", "ping", "mtr") + '<input name="host" placeholder="ip"><p>IPv4 test: 198.18.0.9</p><p>Location: Town</p>',
    "buttons": "<div><div class=\"h4\">Country</div><span>XX</span></div><div><div class=\"h4\">City</div><span>Town</span></div><button onclick=\"SingleNetwork('u', 'i', 'n')\">Ping</button>",
    "token": '<form action="/go.php"><input name="csrfToken"><input name="targetHost">' + sel("backendMethod", "ping") + '<button name="submitForm"></button><label>IPv4</label><input type="text" value="198.18.0.7"></form>',
    "routers": sel("routers", "r1", "r2") + sel("query", "bgp") + '<input name="dontlook">',
    "radios": '<input type="radio" name="command" value="bgp"><label>BGP</label>' + sel("router", "r1", "r2"),
    "bgpd": sel("cmd", "show") + '<input name="req">',
    "minimum": sel("test", "ping") + '<input name="destination" value="v">',
}


@pytest.mark.parametrize("rule", FORMS)
def test_forms(rule):
    got = forms.records(FORMS[rule])
    assert [g["rule"] for g in got] == [rule] * (2 if rule in ("routers", "radios") else 1)
    assert got[0]["command"]["options"]


def test_form_details():
    a = forms.records(FORMS["ajax"])[0]
    assert (a["ip_addr"], a["hint"], a["input"]["placeholder"]) == ("198.18.0.9", "Town", "ip")
    assert forms.records(FORMS["buttons"])[0]["hint"] == "Town, XX"
    assert forms.records(FORMS["token"])[0]["ip_addr"] == "198.18.0.7"
    assert [r["params"]["router"] for r in forms.records(FORMS["radios"])] == ["r1", "r2"]
    assert forms.records(FORMS["bgpd"] + '<input name="host">')[0]["rule"] == "ajax"  # order decides
    state = {"props": {"appProps": {"config": {"queries": {"list": [{"name": "ping", "display_name": "Ping", "enable": True}, {"name": "x", "enable": False}]}, "networks": [{"locations": [{"_id": "l1", "name": "Town", "vrfs": [{"_id": "v0"}, {"_id": "v1", "default": True}]}]}]}}}}
    got = forms.records(f'<p>hyperglass</p><script id="__NEXT_DATA__">{json.dumps(state)}</script>')
    assert got[0]["params"] == {"query_location": "l1", "query_vrf": "v1"} and len(got[0]["command"]["options"]) == 1
    assert forms.records(None) == [] and forms.records("<p>hyperglass</p>") == []


def test_traces():
    t = traces.trace("traceroute to h.example (198.18.0.9), 30 hops max\n 1  a.example (198.18.0.1)  1.5 ms  0.9 ms\n 2  * * *\n 3  198.18.0.5 [AS64500] 0.01 s\n    198.18.0.6  7 ms\n 4 198.18.0.9 9 ms")
    assert t["dest_ip"] == "198.18.0.9" and t["is_successful"]
    assert [(h["ip"], h["hop_index"], h["rtt"]) for h in t["hops"]] == [("198.18.0.1", 1, 1.5), ("198.18.0.5", 3, 10.0), ("198.18.0.6", 3, 7.0), ("198.18.0.9", 4, 9.0)]
    assert traces.trace(json.dumps({"result": "<pre>1 198.18.0.1 2 ms<br>2 198.18.0.2 3 ms</pre>"}))["dest_ip"] == "198.18.0.2"
    assert traces.trace("1 198.18.0.1 2 ms !N")["dest_ip"] is None and not traces.trace("1 198.18.0.1 2 ms !N")["is_successful"]
    assert traces.trace("1 300.1.1.1 2 ms") is None and traces.trace("") is None and traces.trace("no hops") is None


def frame(src, dst, proto=1, kind=b"\x08\x00"):
    return b"\0" * 12 + kind + bytes([0x45]) + b"\0" * 8 + bytes([proto]) + b"\0\0" + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))


def test_captures(spark, tmp_path):
    fs = [frame("198.18.0.1", "198.18.0.2"), frame("198.18.0.2", "198.18.0.1"), frame("198.18.0.3", "198.18.0.1", proto=6), frame("198.18.0.4", "198.18.0.1", kind=b"\x08\x06"), b"\0" * 10]
    data = b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + b"".join(struct.pack("<IIII", 10 + i, 500_000, len(f), len(f)) + f for i, f in enumerate(fs)) + b"\x01\x02"
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "b.pcap").write_bytes(b"short")
    got = sorted((r["ts"], r["ip"]) for r in readers.captures(spark, str(tmp_path), "198.18.0.1").collect())
    assert got == [(10.5, "198.18.0.2"), (11.5, "198.18.0.2")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"name": " A ", "looking_glass": " http://a "}, {"name": "B"}, {"name": "C", "looking_glass": " "}]}))
    assert [tuple(r) for r in readers.nested_dump(spark, str(tmp_path / "d.json")).collect()] == [("A", "http://a")]
    (tmp_path / "l.json").write_text(json.dumps([{"url": "u", "filename": "f"}]))
    assert readers.json_list(spark, str(tmp_path / "l.json"), "url string, filename string").count() == 1
    (tmp_path / "h.csv").write_text("host,ip,proto\na.x,1,http\nhttps://b.x,2,http\n,3,http\n")
    assert [r["url"] for r in readers.csv_by_position(spark, str(tmp_path / "h.csv")).collect()] == ["http://a.x", "https://b.x"]
    (tmp_path / "t.txt").write_text("1.5\n2.5\n3\n4\n9\n")
    assert [(r["start"], r["end"]) for r in readers.time_pairs(spark, str(tmp_path / "t.txt")).collect()] == [(1.5, 2.5), (3.0, 4.0)]
    (tmp_path / "r.tsv").write_text("u\tf\t2\nv\tg\tbad\n")
    assert [r["result"] for r in readers.result_log(spark, str(tmp_path / "r.tsv")).orderBy("url").collect()] == [2, None]
    pages = spark.createDataFrame([("<table><tr><td>n</td><td>x</td><td><a href='u'>c</a></td></tr></table>",), (None,)], "h string")
    assert [tuple(r) for r in readers.html_tables(pages, "h", 3).collect()] == [("n", "u")]


def test_fetch_and_route(spark, tmp_path):
    def get(u):
        if "bad" in u:
            raise OSError("down")
        return u + "/", b"body" if "big" not in u else b"x" * 20

    d = spark.createDataFrame([("http://a",), ("http://bad",), ("http://big",), (None,)], "url string")
    got = {r["url"]: (r["final_url"], r["success"], r["error"]) for r in readers.fetch(d, "url", get, most=10).collect()}
    assert got == {"http://a": ("http://a", True, None), "http://bad": (None, False, "down"), "http://big": (None, False, "too large"), None: (None, False, "no address")}
    readers.route(d.filter("url is not null").withColumn("bucket", F.length("url")), str(tmp_path / "o"), "bucket")
    assert len(list((tmp_path / "o").glob("bucket=*"))) == 2
