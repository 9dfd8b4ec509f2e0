"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Value, function, python


@function("abs", "value")
def abs_(value: Column) -> Column:
    return F.abs(value)


def _scaled(f, value: Value, precision: int) -> Column:
    if value.kind == "integer":
        return value.col
    p = F.lit(10.0**precision)
    return f(value.col.cast("double") * p) / p


@function("ceil", "value", "precision=0", literal="precision", typed=True)
def ceil(value: Value, precision: int = 0) -> Column:
    return _scaled(lambda c: F.ceil(c).cast("double"), value, precision)


@function("floor", "value", "precision=0", literal="precision", typed=True)
def floor(value: Value, precision: int = 0) -> Column:
    return _scaled(lambda c: F.floor(c).cast("double"), value, precision)


@function("round", "value", "precision=0", literal="precision", typed=True)
def round_(value: Value, precision: int = 0) -> Column:
    return _scaled(lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5), value, precision)


@function("mod", "value", "modulus", fallible=True)
def mod(value: Column, modulus: Column) -> Column:
    return F.when(modulus != 0, F.try_mod(value, modulus))


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def in_base(n: int, base: int) -> str:
    if not 2 <= base <= 36:
        raise ValueError(base)
    digits, left = "", abs(int(n))
    while left or not digits:
        left, d = divmod(left, base)
        digits = _DIGITS[d] + digits
    return "-" + digits if n < 0 else digits


@function("format_int", "value", "base=10", literal="base", fallible=True)
def format_int(value: Column, base: int = 10) -> Column:
    return python(lambda n: in_base(n, base), "string", value)


@function("format_number", "value", "scale=None", "decimal_separator='.'", "grouping_separator=''", literal="scale decimal_separator grouping_separator")
def format_number(value: Column, scale: int | None = None, decimal_separator: str = ".", grouping_separator: str = "") -> Column:
    """Digits after the separator are cut off at ``scale``, not rounded, and filled with zeros."""
    text = value.cast("decimal(38,12)").cast("string")
    whole, part = F.substring_index(text, ".", 1), F.regexp_replace(F.substring_index(text, ".", -1), "0+$", "")
    if grouping_separator:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", grouping_separator)
    if scale == 0:
        return whole
    if scale is not None:
        part = F.rpad(F.left(part, F.lit(scale)), scale, "0")
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit(decimal_separator), part))


@function("haversine", "latitude1", "longitude1", "latitude2", "longitude2", "measurement_unit='kilometers'", literal="measurement_unit")
def haversine(latitude1: Column, longitude1: Column, latitude2: Column, longitude2: Column, measurement_unit: str = "kilometers") -> Column:
    """Distance over a ball of the earth's mean radius."""
    radius = {"kilometers": 6371.0088, "miles": 6371.0088 / 1.609344}[measurement_unit]
    up, across = F.radians(latitude2 - latitude1) / 2, F.radians(longitude2 - longitude1) / 2
    a = F.sin(up) * F.sin(up) + F.cos(F.radians(latitude1)) * F.cos(F.radians(latitude2)) * F.sin(across) * F.sin(across)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
