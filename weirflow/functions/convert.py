"""Type tests, assertions and conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Value, function, python
from .time import iso

#: Type names in a variant's schema for each kind.
VARIANT = {"string": ("STRING",), "integer": ("BIGINT", "TINYINT", "SMALLINT", "INT"), "float": ("DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "timestamp": ("TIMESTAMP", "TIMESTAMP_NTZ"), "null": ("VOID",)}
SPARK = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "timestamp": "timestamp"}


def is_kind(v: Value, kind: str) -> Column:
    if v.kind == "variant":
        name = F.schema_of_variant(v.col)
        if kind == "array":
            return F.coalesce(name.startswith("ARRAY"), F.lit(False))
        if kind == "object":
            return F.coalesce(name.startswith("OBJECT"), F.lit(False))
        test = name.isin(*VARIANT[kind])
        if kind == "float":
            test = test | name.startswith("DECIMAL")
        if kind == "null":
            test = test | v.col.isNull()
        return F.coalesce(test, F.lit(False))
    if kind == "null":
        return v.col.isNull()
    return v.col.isNotNull() if v.kind == kind else F.lit(False)


def as_kind(v: Value, kind: str) -> Column:
    """The value if it has the kind, else null."""
    if v.kind == "variant":
        if kind in SPARK:
            return F.when(is_kind(v, kind), F.try_variant_get(v.col, "$", SPARK[kind]))
        return F.when(is_kind(v, kind), v.col)
    return v.col if v.kind == kind else F.lit(None)


for _name, _kind in (("string", "string"), ("int", "integer"), ("float", "float"), ("bool", "boolean"), ("timestamp", "timestamp"), ("array", "array"), ("object", "object")):
    function(_name, "value", fallible=True, typed=True)(lambda value, k=_kind: as_kind(value, k))
for _name, _kind in (("is_array", "array"), ("is_boolean", "boolean"), ("is_float", "float"), ("is_integer", "integer"), ("is_null", "null"), ("is_object", "object"), ("is_string", "string"), ("is_timestamp", "timestamp")):
    function(_name, "value", typed=True)(lambda value, k=_kind: is_kind(value, k))


@function("is_regex", "value", typed=True)
def is_regex(value: Value) -> Column:
    return F.lit(False)


@function("is_empty", "value", typed=True)
def is_empty(value: Value) -> Column:
    return (F.length(value.col) if value.kind == "string" else F.size(value.col)) == 0


@function("is_json", "value")
def is_json(value: Column) -> Column:
    return F.try_parse_json(value).isNotNull()


@function("is_nullish", "value", typed=True)
def is_nullish(value: Value) -> Column:
    """Null, blank or a dash."""
    if value.kind == "string":
        return F.coalesce(F.regexp_replace(value.col, r"(?U)\s", "").isin("", "-"), F.lit(True))
    return is_kind(value, "null")


@function("type_def", "value", typed=True)
def type_def(value: Value) -> Column:
    return F.schema_of_variant(value.col) if value.kind == "variant" else F.lit(value.kind)


@function("tag_types_externally", "value", typed=True)
def tag_types_externally(value: Value) -> Column:
    if value.kind == "null":
        return F.lit(None).cast("map<string,string>")
    if value.kind == "object":
        return value.col if value.type.typeName() == "map" else F.struct(*[tag_types_externally(Value(value.col.getField(f.name), f.dataType)).alias(f.name) for f in value.type.fields])
    if value.kind == "array":
        return F.transform(value.col, lambda x: F.create_map(F.lit(Value(x, value.type.elementType).kind), x))
    return F.create_map(F.lit(value.kind), value.col)


def text_of(v: Value) -> Column:
    if v.kind == "timestamp":
        return iso(v.col.cast("timestamp"))
    if v.kind == "variant":
        return F.try_variant_get(v.col, "$", "string")
    return v.col.cast("string")


@function("to_string", "value", fallible=True, typed=True)
def to_string(value: Value) -> Column:
    if value.kind in ("array", "object"):
        return F.lit(None).cast("string")
    return F.coalesce(text_of(value), F.lit(""))


@function("to_int", "value", fallible=True, typed=True)
def to_int(value: Value) -> Column:
    if value.kind == "timestamp":
        return F.unix_seconds(value.col.cast("timestamp"))
    if value.kind == "variant":
        return F.coalesce(F.try_variant_get(value.col, "$", "bigint"), F.try_variant_get(value.col, "$", "string").try_cast("bigint"))
    if value.kind == "null":
        return F.lit(0).cast("bigint")
    if value.kind == "float":
        return F.floor(F.abs(value.col)).cast("bigint") * F.signum(value.col).cast("bigint")
    return value.col.try_cast("bigint") if value.kind != "string" else F.when(value.col.rlike(r"^[+-]?[0-9]+$"), value.col.try_cast("bigint"))


@function("to_float", "value", fallible=True, typed=True)
def to_float(value: Value) -> Column:
    if value.kind == "timestamp":
        return F.unix_micros(value.col.cast("timestamp")) / 1e6
    if value.kind == "boolean":
        return value.col.cast("int").cast("double")
    if value.kind == "variant":
        return F.try_variant_get(value.col, "$", "double")
    if value.kind == "null":
        return F.lit(0.0)
    out = value.col.try_cast("double")
    return F.when(~F.isnan(out), out)


@function("to_bool", "value", fallible=True, typed=True)
def to_bool(value: Value) -> Column:
    if value.kind == "boolean":
        return value.col
    if value.kind in ("integer", "float"):
        return value.col != 0
    if value.kind == "null":
        return F.lit(False)
    text = F.lower(text_of(value))
    return F.when(text.isin("true", "t", "yes", "y", "1"), True).when(text.isin("false", "f", "no", "n", "0"), False)


@function("to_timestamp", "value", fallible=True, typed=True)
def to_timestamp(value: Value) -> Column:
    return value.col.cast("timestamp") if value.kind == "timestamp" else F.timestamp_micros((value.col * 1_000_000).cast("bigint")) if value.kind in ("integer", "float") else text_of(value).try_cast("timestamp")


@function("to_regex", "value", literal="value")
def to_regex(value: str) -> Column:
    return F.lit(value)


@function("parse_int", "value", "base=None", literal="base", fallible=True)
def parse_int(value: Column, base: int | None = None) -> Column:
    """Without a base, 0x, 0o, 0b and a leading 0 tell it."""
    if base == 10:
        return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))

    def read(s: str) -> int:
        if base is None and len(s.lstrip("+-")) > 1 and s.lstrip("+-")[0] == "0" and s.lstrip("+-").isdigit():
            return int(s, 8)
        return int(s, 0 if base is None else base)

    return python(read, "bigint", value)


@function("parse_float", "value", fallible=True)
def parse_float(value: Column) -> Column:
    out = value.try_cast("double")
    return F.when(~F.isnan(out), out)


#: Names of syslog's facilities and levels, in the order of their codes.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
LEVELS = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


def named(names: tuple, code: Column) -> Column:
    return F.when((code >= 0) & (code < len(names)), F.get(F.array(*map(F.lit, names)), code.cast("int")))


def coded(names: tuple, name: Column, other: dict | None = None) -> Column:
    out = F.array_position(F.array(*map(F.lit, names)), name) - 1
    for k, v in (other or {}).items():
        out = F.when(name == k, v).otherwise(out)
    return F.when(out >= 0, out.cast("bigint"))


@function("to_syslog_facility", "value", fallible=True)
def to_syslog_facility(value: Column) -> Column:
    return named(FACILITIES, value)


@function("to_syslog_facility_code", "value", fallible=True)
def to_syslog_facility_code(value: Column) -> Column:
    return coded(FACILITIES, value)


@function("to_syslog_level", "value", fallible=True)
def to_syslog_level(value: Column) -> Column:
    return named(LEVELS, value)


@function("to_syslog_severity", "value", fallible=True)
def to_syslog_severity(value: Column) -> Column:
    return coded(LEVELS, value, {"panic": 0, "error": 3, "warn": 4})
