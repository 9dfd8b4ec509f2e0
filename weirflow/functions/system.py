"""Random values, identifiers, the environment, assertions."""

from __future__ import annotations

import os
import secrets
import socket

from pyspark.sql import Column, functions as F

from .registry import function, python


@function("uuid_v4")
def uuid_v4() -> Column:
    return F.uuid()


@function("uuid_v7", "timestamp=None")
def uuid_v7(timestamp: Column | None = None) -> Column:
    """Milliseconds in the first 48 bits, then version, variant and random bits."""
    ms = F.unix_millis(F.current_timestamp() if timestamp is None else timestamp)
    head = F.lpad(F.lower(F.hex(ms)), 12, "0")
    rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-"), F.substring(F.uuid(), 20, 4), F.lit("-"), F.substring(rest, 21, 12))


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@function("uuid_from_friendly_id", "value", fallible=True)
def uuid_from_friendly_id(value: Column) -> Column:
    def read(s: str) -> str:
        import uuid

        n = 0
        for c in s:
            n = n * 62 + _BASE62.index(c)
        return str(uuid.UUID(int=n))

    return python(read, "string", value)


@function("random_bool")
def random_bool() -> Column:
    return F.rand() < 0.5


@function("random_float", "min", "max")
def random_float(min: Column, max: Column) -> Column:
    return F.rand() * (max - min) + min


@function("random_int", "min", "max")
def random_int(min: Column, max: Column) -> Column:
    return F.floor(F.rand() * (max - min) + min).cast("bigint")


@function("random_bytes", "length")
def random_bytes(length: Column) -> Column:
    return python(lambda n: secrets.token_bytes(int(n)), "binary", length)


@function("get_env_var", "name", literal="name", fallible=True)
def get_env_var(name: str) -> Column:
    return F.lit(os.environ.get(name)).cast("string")


@function("get_hostname")
def get_hostname() -> Column:
    return F.lit(socket.gethostname())


@function("log", "value", "level='info'", "rate_limit_secs=1", literal="level rate_limit_secs")
def log(value: Column, level: str = "info", rate_limit_secs: int = 1) -> Column:
    return F.lit(None)


@function("assert", "condition", "message='assertion failed'", literal="message", fallible=True)
def assert_(condition: Column, message: str = "assertion failed") -> Column:
    return F.when(condition, F.lit(True))


@function("assert_eq", "left", "right", "message='assertion failed'", literal="message", fallible=True)
def assert_eq(left: Column, right: Column, message: str = "assertion failed") -> Column:
    return F.when(left.eqNullSafe(right), F.lit(True))


@function("dns_lookup", "value", fallible=True)
def dns_lookup(value: Column) -> Column:
    """Addresses of a name, asked by the executors."""

    def ask(name: str) -> list[str]:
        try:
            return sorted({x[4][0] for x in socket.getaddrinfo(name, None)})
        except OSError as e:
            raise ValueError(str(e)) from e

    return python(ask, "array<string>", value)


@function("reverse_dns", "value", fallible=True)
def reverse_dns(value: Column) -> Column:
    def ask(address: str) -> str:
        try:
            return socket.gethostbyaddr(address)[0]
        except OSError as e:
            raise ValueError(str(e)) from e

    return python(ask, "string", value)


@function("http_request", "url", "method='get'", "body=''", literal="method body", fallible=True)
def http_request(url: Column, method: str = "get", body: str = "") -> Column:
    def ask(address: str) -> str:
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(address, body.encode() or None, method=method.upper()), timeout=10) as r:
                return r.read().decode()
        except OSError as e:
            raise ValueError(str(e)) from e

    return python(ask, "string", url)
