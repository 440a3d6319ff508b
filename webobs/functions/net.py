"""IPv4 scalars on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address blocks that never belong to a public host.
BOGONS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
]
_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def is_ipv4(ip: Column) -> Column:
    """A dotted quad with octets up to 255; false for null."""
    return F.coalesce(ip.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), F.lit(False))


def ip_number(ip: Column) -> Column:
    """A valid dotted quad as a number, else null."""
    p = F.split(ip, r"\.")
    return F.when(is_ipv4(ip), sum((p[i].cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), p[0].cast("bigint") * 256**3))


def cidr_range(cidr: str) -> tuple[int, int]:
    a, n = cidr.split("/")
    lo = sum(int(x) << s for x, s in zip(a.split("."), (24, 16, 8, 0)))
    size = 1 << (32 - int(n))
    return lo // size * size, lo // size * size + size - 1


def is_bogon(ip: Column, blocks: list[str] = BOGONS) -> Column:
    """Whether a valid address lies in one of blocks; false for anything else."""
    n = ip_number(ip)
    hit = F.lit(False)
    for c in blocks:
        lo, hi = cidr_range(c)
        hit = hit | n.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def subnet(ip: Column, prefix: Column | int) -> Column:
    """Number of the network of that prefix length."""
    n, size = ip_number(ip), F.pow(F.lit(2), 32 - (F.lit(prefix) if isinstance(prefix, int) else prefix)).cast("bigint")
    return n - F.pmod(n, size)


def dotted(number: Column) -> Column:
    n = number.cast("bigint")
    return F.concat_ws(".", *[F.pmod(F.floor(n / (256**s)), F.lit(256)).cast("string") for s in (3, 2, 1, 0)])
