"""Query forms of known layouts -> records of a service's query points. One table of rules, tried in order."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webobs.functions.html import Node, parse

RECORD = (
    "struct<rule:string,method:string,action:string,content_type:string,params:map<string,string>,"
    "command:struct<name:string,options:array<struct<value:string,placeholder:string>>>,input:struct<name:string,placeholder:string>,ip_addr:string,hint:string>"
)
_IP = re.compile(r"ipv4[^0-9]*((?:[0-9]{1,3}\.){3}[0-9]{1,3})", re.I)
_FORM = "application/x-www-form-urlencoded"


def select_options(s: Node | None) -> dict | None:
    """{name, options} of a select; options without a value are left out; None without a name or options."""
    if s is None or not s.attrs.get("name"):
        return None
    opts = [{"value": o.attrs["value"], "placeholder": o.text()} for o in s.all("option") if o.attrs.get("value")]
    return {"name": s.attrs["name"], "options": opts} if opts else None


def input_field(i: Node | None) -> dict | None:
    """{name, placeholder}: the value, else the placeholder, else ''; None without a name."""
    if i is None or not i.attrs.get("name"):
        return None
    return {"name": i.attrs["name"], "placeholder": i.attrs.get("value") or i.attrs.get("placeholder") or ""}


def form_action(root: Node) -> str:
    """The first form's action if it looks like a path, else ''."""
    f = root.one("form")
    a = f.attrs.get("action", "") if f else ""
    return a if "/" in a or "." in a else ""


def _labelled_ip(root: Node) -> str:
    return next((m.group(1) for x in root.walk() if isinstance(x, str) and (m := _IP.search(x))), "")


def _location(root: Node) -> str:
    nodes = list(root.walk())
    for k, x in enumerate(nodes):
        if isinstance(x, str) and "location:" in x.lower():
            own = x.strip().rsplit(":", 1)[-1].strip()
            return own or next((n.text() for n in nodes[k + 1 :] if isinstance(n, Node)), "")
    return ""


def _next(root: Node, after: Node, tag: str) -> Node | None:
    seen = False
    for x in root.walk():
        if x is after:
            seen = True
        elif seen and isinstance(x, Node) and x.tag == tag:
            return x
    return None


def _record(rule: str, command: dict | None, field: dict | None, action: str, method: str = "get", params: dict | None = None, ip: str = "", hint: str = "", kind: str = "") -> dict:
    return {"rule": rule, "method": method, "action": action, "content_type": kind, "params": params or {}, "command": command, "input": field, "ip_addr": ip, "hint": hint}


def ajax(root: Node, html: str) -> list[dict]:
    cmd, host = root.one("select", name="cmd"), root.one("input", name="host")
    return [_record("ajax", select_options(cmd), input_field(host), "ajax.php", ip=_labelled_ip(root), hint=_location(root))] if cmd and host else []


def buttons(root: Node, html: str) -> list[dict]:
    opts, params = [], {}
    for b in root.all("button"):
        args = re.findall(r"'([^']*)'", b.attrs.get("onclick", ""))
        if "SingleNetwork" in b.attrs.get("onclick", "") and len(args) >= 3:
            params = {"url": args[0], "item": args[1]}
            opts.append({"value": args[2], "placeholder": b.text()})
    if not opts:
        return []
    marks = [d for d in root.all("div", class_="h4") if d.up and any(isinstance(x, Node) and x.tag == "span" for x in d.up.kids[d.up.kids.index(d) + 1 :])]
    spans = [next(x for x in d.up.kids[d.up.kids.index(d) + 1 :] if isinstance(x, Node) and x.tag == "span").text() for d in marks[:2]]
    hint = ", ".join(x for x in reversed(spans) if x) if len(spans) == 2 else ""
    return [_record("buttons", {"name": "network", "options": opts}, {"name": "input", "placeholder": ""}, "action/looking-glass/network", "post", params, _labelled_ip(root), hint, _FORM)]


def token(root: Node, html: str) -> list[dict]:
    need = root.one("input", name="csrfToken"), root.one("input", name="targetHost"), root.one("button", name="submitForm")
    cmd = select_options(root.one("select", name="backendMethod"))
    if not all(need) or not cmd:
        return []
    params = {"csrfToken": "", "submitForm": ""} | ({"checkTerms": "on"} if root.one("input", name="checkTerms") else {})
    label = next((x for x in root.all("label") if "IPv4" in x.text()), None)
    box = _next(root, label, "input") if label else None
    places = root.one("select", class_="form-select")
    chosen = next((o.text() for o in places.all("option") if "selected" in o.attrs), "") if places else ""
    return [_record("token", cmd, {"name": "targetHost", "placeholder": ""}, form_action(root), "post", params, box.attrs.get("value", "") if box else "", chosen, _FORM)]


def _per_router(rule: str, root: Node, routers: dict | None, command: dict | None, field: str, fixed: dict) -> list[dict]:
    if not routers or not command:
        return []
    return [_record(rule, command, {"name": field, "placeholder": ""}, form_action(root), params={routers["name"]: o["value"], **fixed}, hint=o["placeholder"]) for o in routers["options"]]


def routers(root: Node, html: str) -> list[dict]:
    fixed = {"dontlook": ""} if root.one("input", name="dontlook") else {}
    return _per_router("routers", root, select_options(root.one("select", name="routers")), select_options(root.one("select", name="query")), "parameter", fixed)


def radios(root: Node, html: str) -> list[dict]:
    opts, name = [], ""
    for r in root.all("input", type="radio"):
        label = _next(root, r, "label")
        name = r.attrs.get("name", "")
        opts.append({"value": r.attrs.get("value", ""), "placeholder": label.text() if label else r.attrs.get("value", "")})
    return _per_router("radios", root, select_options(root.one("select", name="router")), {"name": name, "options": opts} if opts else None, "query", {"protocol": "ipv4"})


def _plain_form(rule: str, select: str, field: str):
    def run(root: Node, html: str) -> list[dict]:
        s, i = root.one("select", name=select), root.one("input", name=field)
        return [_record(rule, select_options(s), input_field(i), form_action(root))] if s and i else []

    return run


def embedded(root: Node, html: str) -> list[dict]:
    """Query points in the page's embedded JSON state: enabled queries for each location, with its default (else first) table."""
    if "hyperglass" not in html.lower():
        return []
    script = next((s for s in root.all("script") if s.attrs.get("id") == "__NEXT_DATA__"), None)
    try:
        conf = json.loads("".join(x for x in script.kids if isinstance(x, str)))["props"]["appProps"]["config"] if script else {}
        opts = [{"value": q.get("name"), "placeholder": q.get("display_name")} for q in conf.get("queries", {}).get("list", []) if q.get("enable")]
        if not conf.get("queries", {}).get("list"):
            return []
        out = []
        for loc in (x for n in conf.get("networks", []) for x in n.get("locations", [])):
            tables = loc.get("vrfs", [])
            table = next((v["_id"] for v in tables if v.get("default")), None) or (tables[0]["_id"] if tables else None)
            params = {"query_location": loc.get("_id")} | ({"query_vrf": table} if table else {})
            out.append(_record("embedded", {"name": "query_type", "options": opts}, {"name": "query_target", "placeholder": ""}, "api/query/", "post", params, hint=loc.get("name") or "", kind="application/json"))
        return out
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


#: Tried in this order; the first that finds a record decides.
RULES = [ajax, buttons, token, routers, radios, _plain_form("bgpd", "cmd", "req"), _plain_form("minimum", "test", "destination"), embedded]


def records(html: str | None) -> list[dict]:
    """Records of the first rule that applies; [] for null, bad or other pages."""
    if not html:
        return []
    root = parse(html)
    for rule in RULES:
        if got := rule(root, html):
            return got
    return []


def form_records(html: Column) -> Column:
    """records as a column: an array of RECORD."""

    @F.pandas_udf(f"array<{RECORD}>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(records)

    return run(html)
