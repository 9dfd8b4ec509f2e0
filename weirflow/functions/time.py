"""Timestamps and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .registry import Value, function

#: strftime letters and the Java patterns that mean the same.
JAVA = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "h": "MMM",
    "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "VV", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "n": "\n", "t": "\t",
}
_PART = re.compile(r"%(?:(\.)?([369])?f|([:.#_0^-]*)([A-Za-z%+]))")


def java_format(text: str) -> str:
    """The Java pattern of a strftime format; ``%+`` is an ISO 8601 time with offset."""
    out, last = [], 0

    def literal(s: str) -> None:
        if s:
            out.append("'" + s.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", s) else s)

    for m in _PART.finditer(text):
        literal(text[last : m.start()])
        last = m.end()
        letter = m[4]
        if letter is None:
            n = int(m[2] or 9 if m[1] else m[2] or 6)
            out.append(("." if m[1] else "") + "S" * n)
        elif letter == "%":
            out.append("%")
        elif letter == "+":
            out.append("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
        elif letter == "z" and ":" in (m[3] or ""):
            out.append("xxx")
        elif letter in JAVA:
            out.append(JAVA[letter])
        else:
            raise ValueError(f"the time format %{letter} has no equivalent")
    literal(text[last:])
    return "".join(out)


@function("now")
def now() -> Column:
    return F.current_timestamp()


def _plain(value: Column) -> Column:
    """ISO 8601 with as many digits of a second as are needed."""
    us = F.unix_micros(value) % 1_000_000
    base = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(us == 0, F.lit("")).when(us % 1000 == 0, F.date_format(value, ".SSS")).otherwise(F.date_format(value, ".SSSSSS"))
    return F.concat(base, part)


def iso(value: Column) -> Column:
    """As text ends in Z."""
    return F.concat(_plain(value), F.lit("Z"))


@function("format_timestamp", "value", "format", "timezone=None", literal="format timezone")
def format_timestamp(value: Column, format: str, timezone: str | None = None) -> Column:
    at = value if timezone is None else F.convert_timezone(F.lit("UTC"), F.lit(timezone), value.cast("timestamp_ntz"))
    if format == "%+":
        return F.concat(_plain(value), F.lit("+00:00"))
    if format == "%s":
        return F.unix_seconds(value).cast("string")
    return F.date_format(at, java_format(format))


@function("parse_timestamp", "value", "format", "timezone=None", literal="format timezone", fallible=True, typed=True)
def parse_timestamp(value: Value, format: str, timezone: str | None = None) -> Column:
    if value.kind == "timestamp":
        return value.col
    if format == "%s":
        return F.timestamp_seconds(value.col.try_cast("bigint"))
    if format == "%+":
        return value.col.try_cast("timestamp")
    out = F.try_to_timestamp(value.col, F.lit(java_format(format)))
    if timezone and "%z" not in format and "%Z" not in format:
        out = F.to_utc_timestamp(out, timezone)
    return out


_UNIX = {"seconds": 1_000_000, "milliseconds": 1000, "microseconds": 1, "nanoseconds": None}


@function("from_unix_timestamp", "value", "unit='seconds'", literal="unit", fallible=True)
def from_unix_timestamp(value: Column, unit: str = "seconds") -> Column:
    value = value.try_cast("bigint")
    return F.timestamp_micros(F.floor(value / 1000) if unit == "nanoseconds" else F.try_multiply(value, F.lit(_UNIX[unit])))


@function("to_unix_timestamp", "value", "unit='seconds'", literal="unit")
def to_unix_timestamp(value: Column, unit: str = "seconds") -> Column:
    us = F.unix_micros(value.cast("timestamp"))
    return us * 1000 if unit == "nanoseconds" else F.floor(us / _UNIX[unit]).cast("bigint")


#: Seconds of each unit of time.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "cs": 1e-2, "ds": 1e-1, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
#: Bytes of each unit of size, by thousands and by 1024.
SIZES = {"B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "PB": 10**15, "EB": 10**18, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50, "EiB": 2**60}


def _amounts(value: Column, units: dict, unit: str) -> Column:
    """The sum of all amounts with their units, in ``unit``; null if the text holds anything else."""
    names = "|".join(sorted(map(re.escape, units), key=len, reverse=True))
    rx = rf"([0-9]*\.?[0-9]+)\s*({names})"
    table = F.create_map(*[F.lit(x) for k, v in units.items() for x in (k, float(v))])
    numbers, kinds = (F.regexp_extract_all(value, F.lit(rx), F.lit(i)) for i in (1, 2))
    each = F.zip_with(numbers, kinds, lambda n, k: n.cast("double") * F.element_at(table, k))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.when(value.rlike(rf"^\s*(?:{rx}\s*)+$"), F.round(total / float(units[unit]), 12))


@function("parse_duration", "value", "unit", literal="unit", fallible=True)
def parse_duration(value: Column, unit: str) -> Column:
    return _amounts(value, UNITS, unit)


@function("parse_bytes", "value", "unit", "base='2'", literal="unit base", fallible=True)
def parse_bytes(value: Column, unit: str, base: str = "2") -> Column:
    sizes = dict(SIZES)
    if str(base) == "2":
        sizes |= {k: 2 ** (10 * i) for i, k in enumerate(("kB", "MB", "GB", "TB", "PB", "EB"), 1)} | {"KB": 2**10}
    return _amounts(value, sizes, unit)


@function("get_timezone_name")
def get_timezone_name() -> Column:
    return F.current_timezone()
