"""Traceroute texts -> hops."""

from __future__ import annotations

import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE = "struct<dest_ip:string,is_successful:boolean,hops:array<struct<ip:string,hop_index:int,rtt:double,hostname:string>>>"
_PARTS = re.compile(r"(?P<host>[\w.-]+)\s+\((?P<at>[\d.]+\.\d+)\)|(?P<rtt>\d+\.?\d*)\s*(?P<unit>msec|ms|s)(?![\w])|(?P<ip>[\d.]+\.\d+)|(?P<gone>!N)")


def body(response: str) -> str:
    """The trace in a reply: out of its JSON wrapper and <pre>, without markup, from its header on."""
    try:
        data = json.loads(response)
        if isinstance(data, dict):
            response = data.get("Template") or data.get("result") or ""
    except ValueError:
        pass
    if m := re.search(r"<pre>(.*?)</pre>", response, re.S | re.I):
        response = m.group(1)
    response = re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", "\n", response).replace("&nbsp;", " "))
    m = re.search(r"traceroute to [^,\n]*,", response, re.I)
    return response[m.start() :] if m else response


def _valid(ip: str) -> bool:
    try:
        ipaddress.ip_address(ip)
        return True
    except ValueError:
        return False


def trace(response: str | None) -> dict | None:
    """{dest_ip, is_successful, hops}: each address once, at its first hop, with its least round-trip time (ms).

    A round-trip time belongs to the address before it and uses it up; a line without a hop number goes on with the last
    hop; '*' and bracketed text are dropped. An address that isn't valid makes the whole trace null, as does an empty one.
    The header names the destination; without one it is the last address of the last line, unless marked unreachable.
    """
    if not response:
        return None
    text = body(response)
    head = re.search(r"trace.* to [\w.-]+ \(([\d.]+)\)", text, re.I)
    dest, last, hop = head.group(1) if head else None, None, 0
    hops: dict[str, dict] = {}
    for line in filter(None, map(str.strip, text.split("\n"))):
        if m := re.match(r"(\d+)\s+(.*)", line):
            hop, line = int(m.group(1)), m.group(2)
        elif not hop:
            continue
        ip = host = last = None
        for m in _PARTS.finditer(re.sub(r"\s*\[[^\]]*\]", "", line.replace("*", ""))):
            if m["host"]:
                host, ip = m["host"], m["at"]
            elif m["ip"]:
                host, ip = None, m["ip"]
            elif m["gone"]:
                last = None
            elif ip:
                if not _valid(ip):
                    return None
                ms = float(m["rtt"]) * (1000 if m["unit"] == "s" else 1)
                h = hops.setdefault(ip, {"ip": ip, "hop_index": hop, "rtt": ms, "hostname": None if host == ip else host})
                h["rtt"] = min(h["rtt"], ms)
                last, ip, host = ip, None, None
    if not hops:
        return None
    dest = dest or last
    return {"dest_ip": dest, "is_successful": dest in hops, "hops": list(hops.values())}


def parse_trace(response: Column) -> Column:
    """trace as a column: a TRACE; its fields are null where trace gives None."""

    @F.pandas_udf(TRACE)
    def run(s: pd.Series) -> pd.DataFrame:
        got = [trace(r) or {"dest_ip": None, "is_successful": None, "hops": None} for r in s]
        return pd.DataFrame(got, columns=["dest_ip", "is_successful", "hops"])

    return run(response)
