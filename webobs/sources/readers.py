"""Sources: files in the formats the pipeline starts from, and a registry that joins them."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webobs.runtime import cut, stage


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def nested_dump(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a dump {data: [{name, looking_glass, ...}]}: records with a non-blank looking_glass, trimmed."""
    d = spark.read.schema("data array<struct<name:string,asn:bigint,website:string,looking_glass:string>>").json(path, multiLine=True)
    r = d.select(F.explode("data").alias("r")).select(F.trim("r.name").alias("name"), F.trim("r.looking_glass").alias("url"))
    return r.filter("url is not null and url <> ''")


def csv_by_position(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(host, ip, url) of a CSV whose columns are host, ip, protocol by position; rows without a host are left out."""
    from webobs.functions.urls import with_scheme

    d = spark.read.csv(path, header=header)
    h, ip, proto, *_ = d.columns
    d = d.select(F.trim(h).alias("host"), F.col(ip).alias("ip"), F.col(proto).alias("proto")).filter("host is not null and host <> ''")
    return d.select("host", "ip", with_scheme(F.col("host"), F.col("proto")).alias("url"))


def html_tables(pages: DataFrame, html: str, cells: int, name_at: int = 0, link_at: int = 2) -> DataFrame:
    """(name, url) of table rows with `cells` cells: a cell's text, and another's link or else its text."""
    from webobs.functions.html import table_udf

    r = pages.select(F.explode(table_udf(cells)(F.col(html))).alias("r"))
    return r.select(F.col("r")[name_at]["text"].alias("name"), F.coalesce(F.col("r")[link_at]["href"], F.col("r")[link_at]["text"]).alias("url"))


def html_list(pages: DataFrame, html: str, anchor: str) -> DataFrame:
    """(name, url) of the list that follows a named anchor; items without a link are left out."""
    from webobs.functions.html import list_udf

    return pages.select(F.explode(list_udf(anchor)(F.col(html))).alias("r")).select(F.col("r.text").alias("name"), F.col("r.href").alias("url")).filter("url is not null")


def two_level(index: DataFrame, details: DataFrame) -> DataFrame:
    """(name, url): index cards (company, detail) joined with the entries (detail, part, url) of their detail pages."""
    return index.join(details, "detail").select(F.concat_ws(" ", "company", "part").alias("name"), "url")


def time_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, k, start, end): files of one epoch time a line, lines 2k and 2k+1 being start and end; a lone last line is left out."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s*\n\s*").alias("v"))
    d = d.select("file", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("v") / 2) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.try_element_at("v", i * 2 + 1).try_cast("double").alias("s"), F.try_element_at("v", i * 2 + 2).try_cast("double").alias("e")))).alias("k", "p"))
    return d.select("file", "k", F.col("p.s").alias("start"), F.col("p.e").alias("end")).filter("start is not null and end is not null")


def packets(data: bytes) -> Iterator[tuple[float, str, str]]:
    """(time, source, destination) of ICMP over IPv4 packets of a capture file; other and cut-off frames are passed over."""
    if len(data) < 24:
        return
    magic = data[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1e9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
    at = 24
    while at + 16 <= len(data):
        sec, frac, kept, _ = struct.unpack_from(order + "IIII", data, at)
        frame = data[at + 16 : at + 16 + kept]
        at += 16 + kept
        if len(frame) >= 34 and frame[12:14] == b"\x08\x00" and frame[14] >> 4 == 4 and frame[23] == 1:
            yield sec + frac / unit, ".".join(map(str, frame[26:30])), ".".join(map(str, frame[30:34]))


def captures(spark: SparkSession, path: str, own: str) -> DataFrame:
    """(file, ts, ip): ICMP packets of capture files, by their end that isn't `own`; files are parsed where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = [(p, t, d if s == own else s) for t, s, d in packets(bytes(c))]
                yield pd.DataFrame(rows, columns=["file", "ts", "ip"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, ts double, ip string")


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """(url, filename, result) of a tab-separated log; results that aren't integers are null."""
    return spark.read.csv(path, sep="\t", schema="url string, filename string, result string").withColumn("result", F.expr("try_cast(result AS int)"))


def decoded(raw: bytes, declared: str | None = None) -> str:
    """A response body as text: by its byte-order mark, the declared charset, one named at its beginning, UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    said = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", raw[:2048])
    for name in (declared, said and said[1].decode(), "utf-8"):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("latin-1")


def fetch(urls: DataFrame, url: str, get: Callable[[str], tuple], tries: int = 3, most: int = 10 << 20, head: Callable[[str], int | None] | None = None) -> DataFrame:
    """(url, final_url, content, success, error): fetches by an injected get(url) -> (final url, body[, charset]), tried `tries` times.

    head(url), if given, tells a length beforehand. Bodies of over `most` bytes fail, without being fetched where head tells;
    bodies are decoded by decoded(); a trailing '/' of the final address is dropped. Failures are rows, so a resumed run is
    an anti join on the successes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b[url]:
                got, err = None, "no address"
                for _ in range(tries if u else 0):
                    try:
                        if head and (head(u) or 0) > most:
                            err = "too large"
                            break
                        final, raw, *said = get(u)
                        got, err = ((final[:-1] if final.endswith("/") else final), decoded(raw, *said)) if len(raw) <= most else None, "too large"
                        break
                    except Exception as e:
                        err = str(e)
                rows.append((u, got[0], got[1], True, None) if got else (u, None, None, False, err))
            yield pd.DataFrame(rows, columns=["url", "final_url", "content", "success", "error"])

    return urls.select(url).mapInPandas(run, "url string, final_url string, content string, success boolean, error string")


class RateLimited(Exception):
    """Raised by an injected search or scorer that asks to be called later."""


def search(terms: DataFrame, term: str, ask: Callable[[str, int], list[str]], num: int = 100, tries: int = 2, wait: Callable[[int], None] = lambda n: None) -> DataFrame:
    """(term, url, success, error): results of an injected paged search ask(term, page), at most num different ones a term.

    Pages are asked for from 1 until num results are there or a page brings nothing new. A rate limit is waited for (wait gets
    the number of the attempt) and tried again up to `tries` times; other errors end a term. A term that failed has one row with
    the error, besides what it found.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b[term]:
                found, page, failed, err = {}, 1, 0, None
                while x and len(found) < num:
                    try:
                        fresh = [u for u in ask(x, page) if u not in found]
                    except RateLimited as e:
                        failed += 1
                        if failed > tries:
                            err = str(e) or "rate limit"
                            break
                        wait(failed)
                        continue
                    except Exception as e:
                        err = str(e)
                        break
                    found |= dict.fromkeys(fresh)
                    if not fresh:
                        break
                    page += 1
                rows += [(x, u, True, None) for u in list(found)[:num]] + ([(x, None, False, err)] if err else [])
            yield pd.DataFrame(rows, columns=["term", "url", "success", "error"])

    return terms.select(term).mapInPandas(run, "term string, url string, success boolean, error string")


def scored(texts: DataFrame, key: str, text: str, ask: Callable[[str], str], tries: int = 5, wait: Callable[[int], None] = lambda n: None) -> DataFrame:
    """(key, label, reply, error): the first integer of the reply of an injected scorer ask(text), tried up to `tries` times.

    Each failure is followed by wait(number of the attempt), which a caller makes as long as it likes. A reply without a
    number has a null label; a null text isn't asked about.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[text]):
                reply = err = None
                for n in range(1, tries + 1 if x is not None else 1):
                    try:
                        reply, err = ask(x), None
                        break
                    except Exception as e:
                        err = str(e) or type(e).__name__
                        wait(n)
                m = re.search("[0-9]+", reply or "")
                rows.append((k, int(m[0]) if m else None, reply, err))
            yield pd.DataFrame(rows, columns=[key, "label", "reply", "error"]).astype({"label": "Int64"})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, label long, reply string, error string")


def addresses(hosts: DataFrame, host: str, known: DataFrame, lookup: Callable[[str], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(host, ips) of every distinct host, and the table of known answers grown by it.

    known: (host, ips), the answers so far. Only hosts without one are looked up, each once, by an injected lookup(host); hosts
    that have no address, or whose lookup fails, get an empty answer that isn't asked for again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h in b["host"]:
                try:
                    rows.append((h, sorted({x.split("%")[0] for x in lookup(h)})))
                except Exception:
                    rows.append((h, []))
            yield pd.DataFrame(rows, columns=["host", "ips"])

    want = hosts.select(F.lower(host).alias("host")).filter("host is not null and host <> ''").distinct()
    new = cut(want.join(known.select("host"), "host", "left_anti").mapInPandas(run, "host string, ips array<string>"))
    grown = known.select("host", "ips").unionByName(new)
    return want.join(grown, "host"), grown


def background(texts: DataFrame, key: str, text: str, most: int = 15_000, least: int = 4) -> DataFrame:
    """(key, w): the first `most` texts of a background corpus by key (a stated sample), as words, staged for reuse."""
    from webobs.functions.text import letters

    return stage(texts.filter(F.col(text).isNotNull()).orderBy(key).limit(most).select(key, letters(F.col(text), least).alias("w")))


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """df as JSON lines; one_file for small results that other tools read."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_map(df: DataFrame, path: str, key: str, value: str) -> None:
    """(key, value) rows as objects {key: value}, a line each; values may be arrays, maps or structs. Null keys are left out."""
    d = df.filter(F.col(key).isNotNull()).select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value"))
    d.write.mode("overwrite").text(path)


def reset(spark: SparkSession, path: str) -> bool:
    """Empties an output folder; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Registry:
    """Collectors of (name, url), joined in the order they were added."""

    def __init__(self) -> None:
        self._all: list[Callable[[], DataFrame]] = []

    def add(self, f: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        self._all.append(f)
        return f

    def collect_all(self) -> DataFrame:
        """(source, name, url): trimmed, without blank addresses."""
        parts = [f().select(F.lit(i + 1).alias("source"), F.trim("name").alias("name"), F.trim("url").alias("url")) for i, f in enumerate(self._all)]
        return reduce(DataFrame.unionByName, parts).filter("url is not null and url <> ''")


def route(df: DataFrame, path: str, by: str) -> None:
    """Writes df apart by the values of a column."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def merge_verified(pages: DataFrame, verified: DataFrame) -> DataFrame:
    """Pages whose file was verified by hand."""
    return pages.join(verified.select("filename").distinct(), "filename")
