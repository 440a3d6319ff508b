"""Joins that plans are made of. Sides are broadcast by Spark's own size checks only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(new: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows of new without an equal row in known; null keys count as unseen."""
    return new.join(known.select(*on).distinct(), on, "left_anti")


def active(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(seen.select(*on).distinct(), on, "left_semi")


def cascade(df: DataFrame, steps: list[tuple[DataFrame, str, str, bool]], regex_value: Column) -> DataFrame:
    """df with asn and how: the first of regex_value and lookups that answers.

    A step is (table of (key, values), key column of df, its name, whether several values are an answer); an answer of
    several values is its smallest. Each lookup is a left equi-join.
    """
    out, found = df, [F.when(regex_value.isNotNull(), F.struct(regex_value.alias("asn"), F.lit("regex").alias("how")))]
    for i, (table, key, how, many) in enumerate(steps):
        out = out.join(table.select(F.col("key").alias(f"__k{i}"), F.col("values").alias(f"__v{i}")), F.col(key) == F.col(f"__k{i}"), "left")
        ok = F.size(f"__v{i}") >= 1 if many else F.size(f"__v{i}") == 1
        found.append(F.when(F.col(f"__v{i}").isNotNull() & ok, F.struct(F.array_min(f"__v{i}").alias("asn"), F.lit(how).alias("how"))))
    got = F.coalesce(*found, F.struct(F.lit(None).cast("bigint").alias("asn"), F.lit("none").alias("how")))
    return out.withColumn("__a", got).withColumn("asn", F.col("__a.asn")).withColumn("how", F.col("__a.how")).drop("__a", *[f"__{x}{i}" for i in range(len(steps)) for x in "kv"])


def contains_first(texts: DataFrame, id_col: str, text: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """(id, name): the first name by `order` that occurs in each text as whole words, by an equi-join on the name's first word.

    A name is found where its words follow each other in the text (words: runs of letters and digits, lower-cased).
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    t = texts.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    t = t.select("id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"), F.explode(F.array_distinct("w")).alias("first"))
    n = names.select(F.col(name).alias("name"), F.col(order).alias("ord"), words(F.col(name)).alias("nw")).filter(F.size("nw") > 0)
    n = n.select("name", "ord", F.col("nw")[0].alias("first"), F.concat(F.lit(" "), F.array_join("nw", " "), F.lit(" ")).alias("find"))
    return t.join(n, "first").filter(F.contains("line", F.col("find"))).groupBy("id").agg(F.min_by("name", "ord").alias("name"))


def longest_prefix(ips: DataFrame, ip_number: str, nets: DataFrame, lo: str, prefix: str, value: str) -> DataFrame:
    """ips with the value of the longest network that holds ip_number, by one equi-join over the prefix lengths in use.

    An address is looked up as its network under every length that occurs (at most 33), so no range join is needed.
    """
    lengths = [r[0] for r in nets.select(prefix).distinct().collect()]  # at most 33 values
    if not lengths:
        return ips.withColumn(value, F.lit(None).cast(dict(nets.dtypes)[value]))
    look = F.array(*[F.struct(F.lit(p).alias("p"), (F.col(ip_number) - F.pmod(F.col(ip_number), F.lit(1 << (32 - p)))).alias("n")) for p in sorted(lengths)])
    keys = ips.select(ip_number).distinct().select(ip_number, F.explode(look).alias("k"))
    n = nets.groupBy(lo, prefix).agg(F.min(value).alias("__v"))
    best = keys.join(n, (F.col("k.n") == F.col(lo)) & (F.col("k.p") == F.col(prefix))).groupBy(ip_number).agg(F.max_by("__v", prefix).alias(value))
    return ips.join(best, ip_number, "left")


def prefix_or_fallback(ips: DataFrame, ip_number: str, tables: list[DataFrame], lo: str, prefix: str, value: str) -> DataFrame:
    """ips with the value of the longest network of the first table that knows the address, else of the second, and so on; null if none does."""
    out = ips
    for i, t in enumerate(tables):
        out = longest_prefix(out, ip_number, t.withColumnRenamed(value, f"__f{i}"), lo, prefix, f"__f{i}")
    found = [f"__f{i}" for i in range(len(tables))]
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def registrable_by(hosts: DataFrame, host: str, rules: DataFrame, rule: str) -> DataFrame:
    """hosts with fld: the public suffix of a host and one label more, by a table of rules; null for addresses and bare suffixes.

    A rule is a suffix, '*.suffix' (any one label before it is part of the suffix) or '!name' (an exception: the suffix is one
    label shorter). The longest rule holds, an exception before all; without a rule the last label is the suffix. Every
    suffix of a distinct host is looked up by an equi-join; null and empty hosts give null.
    """
    p = F.split(F.lower(host), r"\.")
    d = hosts.select(host).distinct().select(host, p.alias("p")).filter(F.length(host) > 0)
    i = d.select(host, "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    rest = F.array_join(F.slice("p", F.col("i"), F.size("p")), ".")
    under = F.concat_ws(".", F.lit("*"), F.when(F.col("i") < F.size("p"), F.array_join(F.slice("p", F.col("i") + 1, F.size("p")), ".")))
    k = F.size("p") - F.col("i") + 1
    keys = F.array(F.struct(rest.alias("key"), k.alias("k")), F.struct(F.concat(F.lit("!"), rest).alias("key"), (k + 999).alias("k")), F.struct(F.when(k > 1, under).alias("key"), k.alias("k")))
    hit = i.select(host, F.explode(keys).alias("x")).join(rules.select(F.col(rule).alias("__r")).distinct(), F.col("x.key") == F.col("__r")).groupBy(host).agg(F.max("x.k").alias("m"))
    n = F.coalesce(F.pmod("m", F.lit(1000)), F.lit(1))
    fld = F.when((F.size("p") > n) & ~F.col(host).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.array_join(F.slice("p", F.size("p") - n, F.size("p")), "."))
    return hosts.join(d.join(hit, host, "left").select(host, fld.alias("fld")), host, "left")


def for_all(candidates: DataFrame, checks: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """Candidates for which `holds` is true of every row of checks with the same keys: an anti join on its negation. No row: kept."""
    return candidates.join(checks, [candidates[c] == checks[c] for c in on] + [~F.coalesce(holds, F.lit(False))], "left_anti")


def word_pairs(df: DataFrame, group: str, word: str) -> DataFrame:
    """(k1, k2): pairs k1 < k2 of words that share a group, each once; groups hold few words by construction (top words)."""
    a = df.select(F.col(group).alias("g"), F.col(word).alias("k1")).distinct()
    b = df.select(F.col(group).alias("g"), F.col(word).alias("k2")).distinct()
    return a.join(b, "g").filter("k1 < k2").select("k1", "k2").distinct()
