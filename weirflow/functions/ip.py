"""Internet addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from .registry import function, python

V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def number(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return F.when(value.rlike(V4), sum((F.get(parts, i).cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, 0).cast("bigint") * 256**3))


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, 8 * i).bitwiseAND(255)).cast("string") for i in (3, 2, 1, 0)])


@function("ip_aton", "value", fallible=True)
def ip_aton(value: Column) -> Column:
    return number(value)


@function("ip_ntoa", "value", fallible=True)
def ip_ntoa(value: Column) -> Column:
    n = value.cast("bigint")
    return F.when((n >= 0) & (n < 2**32), dotted(n))


@function("ip_pton", "value", fallible=True)
def ip_pton(value: Column) -> Column:
    return python(lambda s: ipaddress.ip_address(s).packed, "binary", value)


@function("ip_ntop", "value", fallible=True)
def ip_ntop(value: Column) -> Column:
    return python(lambda b: str(ipaddress.ip_address(bytes(b))), "string", value)


@function("ip_cidr_contains", "cidr", "value", fallible=True)
def ip_cidr_contains(cidr: Column, value: Column) -> Column:
    """Plain arithmetic for IPv4; a Python function reads IPv6."""
    base, bits = number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits)
    four = F.floor(number(value) / size) == F.floor(base / size)
    return F.coalesce(four, python(lambda c, v: ipaddress.ip_address(v) in ipaddress.ip_network(c, strict=False), "boolean", F.when(~value.rlike(V4), cidr), value))


@function("ip_cidr_contains_v4", "cidr", "value", fallible=True)
def ip_cidr_contains_v4(cidr: Column, value: Column) -> Column:
    """As ``ip_cidr_contains`` for IPv4 alone, without Python."""
    base, bits = number(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits)
    return F.floor(number(value) / size) == F.floor(base / size)


@function("ip_subnet", "value", "subnet", fallible=True)
def ip_subnet(value: Column, subnet: Column) -> Column:
    def mask(s: str, m: str) -> str:
        a = ipaddress.ip_address(s)
        width = a.max_prefixlen
        bits = (2**width - 1) << (width - int(m[1:])) & (2**width - 1) if m.startswith("/") else int(ipaddress.ip_address(m))
        return str(type(a)(int(a) & bits))

    return python(mask, "string", value, subnet)


@function("ip_to_ipv6", "value", fallible=True)
def ip_to_ipv6(value: Column) -> Column:
    return F.when(value.rlike(V4), F.concat(F.lit("::ffff:"), value)).when(value.contains(":"), value)


@function("ipv6_to_ipv4", "value", fallible=True)
def ipv6_to_ipv4(value: Column) -> Column:
    def down(s: str) -> str:
        a = ipaddress.ip_address(s)
        if a.version == 4:
            return s
        low = a.ipv4_mapped or (ipaddress.IPv4Address(int(a)) if int(a) < 2**32 else None)
        if low is None:
            raise ValueError(s)
        return str(low)

    return python(down, "string", value)


def _version(s: str) -> str:
    return f"IPv{ipaddress.ip_address(s).version}"


@function("ip_version", "value", fallible=True)
def ip_version(value: Column) -> Column:
    return F.when(value.rlike(V4), F.lit("IPv4")).otherwise(python(_version, "string", F.when(~value.rlike(V4), value)))


@function("is_ipv4", "value")
def is_ipv4(value: Column) -> Column:
    return value.rlike(V4)


@function("is_ipv6", "value")
def is_ipv6(value: Column) -> Column:
    return F.coalesce(python(_version, "string", value) == "IPv6", F.lit(False))


def community(protocol: int, a: str, b: str, source: int | None, target: int | None, seed: int = 0) -> str:
    """The flow's identifier, alike for both directions."""
    import base64
    import hashlib

    x, y = (ipaddress.ip_address(v).packed for v in (a, b))
    p, q = source or 0, target or 0
    if (x, p) > (y, q):
        x, y, p, q = y, x, q, p
    data = seed.to_bytes(2, "big") + x + y + bytes([protocol, 0])
    if protocol in (1, 6, 17, 58, 132):
        data += p.to_bytes(2, "big") + q.to_bytes(2, "big")
    return "1:" + base64.b64encode(hashlib.sha1(data).digest()).decode()


@function("community_id", "source_ip", "destination_ip", "protocol", "source_port=None", "destination_port=None", "seed=0", literal="protocol source_port destination_port seed", fallible=True)
def community_id(source_ip: Column, destination_ip: Column, protocol: int, source_port: int | None = None, destination_port: int | None = None, seed: int = 0) -> Column:
    return python(lambda a, b: community(protocol, a, b, source_port, destination_port, seed), "string", source_ip, destination_ip)
