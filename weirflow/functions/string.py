"""String functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .registry import Value, function, python


def java(pattern: str) -> str:
    return re.sub(r"\(\?P<", "(?<", pattern)


@function("upcase", "value")
def upcase(value: Column) -> Column:
    return F.upper(value)


@function("downcase", "value")
def downcase(value: Column) -> Column:
    return F.lower(value)


def _parts(value: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[\s_\-./]+"), lambda p: p != "")


@function("camelcase", "value")
def camelcase(value: Column) -> Column:
    return F.array_join(F.transform(_parts(value), lambda p, i: F.when(i == 0, p).otherwise(F.initcap(p))), "")


@function("pascalcase", "value")
def pascalcase(value: Column) -> Column:
    return F.array_join(F.transform(_parts(value), lambda p: F.initcap(p)), "")


@function("snakecase", "value")
def snakecase(value: Column) -> Column:
    return F.array_join(_parts(value), "_")


@function("kebabcase", "value")
def kebabcase(value: Column) -> Column:
    return F.array_join(_parts(value), "-")


@function("screamingsnakecase", "value")
def screamingsnakecase(value: Column) -> Column:
    return F.upper(F.array_join(_parts(value), "_"))


def _pair(value: Column, other: Column, case_sensitive: bool) -> tuple[Column, Column]:
    return (value, other) if case_sensitive else (F.lower(value), F.lower(other))


@function("contains", "value", "substring", "case_sensitive=True", literal="case_sensitive")
def contains(value: Column, substring: Column, case_sensitive: bool = True) -> Column:
    return F.contains(*_pair(value, substring, case_sensitive))


@function("contains_all", "value", "substrings", "case_sensitive=True", literal="case_sensitive")
def contains_all(value: Column, substrings: Column, case_sensitive: bool = True) -> Column:
    return F.forall(substrings, lambda s: F.contains(*_pair(value, s, case_sensitive)))


@function("starts_with", "value", "substring", "case_sensitive=True", literal="case_sensitive")
def starts_with(value: Column, substring: Column, case_sensitive: bool = True) -> Column:
    return F.startswith(*_pair(value, substring, case_sensitive))


@function("ends_with", "value", "substring", "case_sensitive=True", literal="case_sensitive")
def ends_with(value: Column, substring: Column, case_sensitive: bool = True) -> Column:
    return F.endswith(*_pair(value, substring, case_sensitive))


@function("match", "value", "pattern", literal="pattern")
def match(value: Column, pattern: re.Pattern | str) -> Column:
    return value.rlike(java(_text(pattern)))


def _text(pattern: re.Pattern | str) -> str:
    return pattern.pattern if isinstance(pattern, re.Pattern) else re.escape(pattern)


@function("match_any", "value", "patterns", literal="patterns")
def match_any(value: Column, patterns: list) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(java(_text(p)))
    return out


@function("replace", "value", "pattern", "with", "count=-1", literal="pattern count")
def replace(value: Column, pattern: re.Pattern | str, count: int = -1, **rest: Column) -> Column:
    new = rest["with"]
    regex = isinstance(pattern, re.Pattern)
    if count < 0:
        return F.regexp_replace(value, F.lit(java(pattern.pattern)), new) if regex else F.replace(value, F.lit(pattern), new)
    # the first ``count`` matches: what stands between them, split at so many places
    parts = F.split(value, java(_text(pattern)), count + 1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(new, p))), "")


#: Patterns of the filters that ``redact`` knows by name.
REDACTIONS = {"us_social_security_number": r"(?:\d{3}-\d{2}-\d{4})"}


@function("redact", "value", "filters", "redactor='[REDACTED]'", literal="filters redactor")
def redact(value: Column, filters: list, redactor: str | dict = "[REDACTED]") -> Column:
    for f in filters:
        if isinstance(f, dict):
            patterns = [REDACTIONS[f["type"]]] if f.get("type") in REDACTIONS else [_text(p) for p in f.get("patterns", [])]
        else:
            patterns = [REDACTIONS[f]] if isinstance(f, str) and f in REDACTIONS else [_text(f)]
        for p in patterns:
            if isinstance(redactor, dict) and redactor.get("type") == "sha2":
                hits = F.regexp_extract_all(value, F.lit(java(p)), F.lit(0))
                value = F.aggregate(F.array_distinct(hits), value, lambda acc, h: F.replace(acc, h, F.sha2(h, 256)))
            else:
                text = redactor.get("replacement", "[REDACTED]") if isinstance(redactor, dict) else "[REDACTED]" if redactor == "full" else redactor
                value = F.regexp_replace(value, java(p), re.sub(r"([\\$])", r"\\\1", text))
    return value


@function("slice", "value", "start", "end=None", literal="start end", typed=True)
def slice_(value: Value, start: int, end: int | None = None) -> Column:
    """From ``start`` up to ``end``, both from 0, negative from the back."""
    size = F.length(value.col) if value.kind == "string" else F.size(value.col)
    place = lambda n: F.lit(n) if n >= 0 else size + n
    upto = size if end is None else F.least(size, place(end))
    length = F.greatest(F.lit(0), upto - place(start)).cast("int")
    if value.kind == "string":
        return F.substring(value.col, (place(start) + 1).cast("int"), length)
    return F.slice(value.col, (place(start) + 1).cast("int"), length)


@function("split", "value", "pattern", "limit=-1", literal="pattern limit")
def split(value: Column, pattern: re.Pattern | str, limit: int = -1) -> Column:
    return F.split(value, java(_text(pattern)), limit)


@function("split_path", "value")
def split_path(value: Column) -> Column:
    parts = F.filter(F.split(value, "/"), lambda p: p != "")
    return F.when(value.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


@function("basename", "value")
def basename(value: Column) -> Column:
    return F.substring_index(F.regexp_replace(value, "/+$", ""), "/", -1)


@function("dirname", "value")
def dirname(value: Column) -> Column:
    bare = F.regexp_replace(value, "/+$", "")
    up = F.regexp_replace(bare, "/+[^/]*$", "")
    return F.when(~F.contains(bare, F.lit("/")), F.lit(".")).when(up == "", F.lit("/")).otherwise(up)


@function("strip_whitespace", "value")
def strip_whitespace(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


@function("strip_ansi_escape_codes", "value")
def strip_ansi(value: Column) -> Column:
    return F.regexp_replace(value, r"\u001B\[[0-9;?]*[ -/]*[@-~]|\u001B[@-_]", "")


@function("strlen", "value")
def strlen(value: Column) -> Column:
    return F.char_length(value)


@function("truncate", "value", "limit", "suffix=''", literal="limit suffix")
def truncate(value: Column, limit: int, suffix: str = "") -> Column:
    """The first ``limit`` characters, and the suffix if something was cut."""
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit(suffix))).otherwise(value)


@function("sieve", "value", "permitted_characters", "replace_single=''", "replace_repeated=''", literal="permitted_characters replace_single replace_repeated")
def sieve(value: Column, permitted_characters: re.Pattern, replace_single: str = "", replace_repeated: str = "") -> Column:
    allowed = java(_text(permitted_characters))
    keep = F.regexp_extract_all(value, F.lit(f"(?s)(?:{allowed})|."), F.lit(0))
    fits = lambda c: c.rlike(f"^(?:{allowed})$")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("bad"))
    end = lambda n: F.when(n == 0, "").when(n == 1, replace_single).otherwise(replace_repeated or replace_single)
    step = lambda a, c: F.when(fits(c), F.struct(F.concat(a["out"], end(a["bad"]), c).alias("out"), F.lit(0).alias("bad"))).otherwise(F.struct(a["out"].alias("out"), (a["bad"] + 1).alias("bad")))
    return F.aggregate(keep, start, step, lambda a: F.concat(a["out"], end(a["bad"])))


@function("shannon_entropy", "value", "segmentation='codepoint'", literal="segmentation")
def shannon_entropy(value: Column, segmentation: str = "codepoint") -> Column:
    """Bits a character; by bytes with segmentation 'byte'."""
    chars = F.filter(F.regexp_extract_all(F.hex(F.encode(value, "utf-8")), F.lit(".."), F.lit(0)), lambda c: c != "") if segmentation == "byte" else F.filter(F.split(value, ""), lambda c: c != "")
    # sorted, so that equal characters stand together and one pass counts them
    step = lambda a, c: F.when(c == a["last"], F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"), (a["n"] + 1).alias("n"))).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)).alias("sum"), (a["n"] + 1).alias("n")))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))
    done = lambda a: F.when(a["n"] == 0, 0.0).otherwise(F.log2(a["n"]) - (a["sum"] + a["run"] * F.log2(a["run"])) / a["n"])
    return F.aggregate(F.array_sort(chars), start, step, done)


_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|\[((?:[^\]\\]|\\.)*)\]|(\S+)')


def tokens(text: str) -> list[str | None]:
    out = []
    for m in _TOKEN.finditer(text):
        found = next(g for g in m.groups() if g is not None)
        out.append(None if found in ("-", "") else found)
    return out


@function("parse_tokens", "value", fallible=True)
def parse_tokens(value: Column) -> Column:
    """Words; quoted and bracketed parts are one token, ``-`` is null."""
    return python(tokens, "array<string>", value)


@function("find", "value", "pattern", "from=0", literal="pattern from")
def find(value: Column, pattern: re.Pattern | str, **rest: int) -> Column:
    """Where the pattern is first found, from 0; -1 without a match."""
    skip = rest.get("from", 0)
    part = F.substring(value, skip + 1, 2**31 - 1)
    at = F.regexp_instr(part, F.lit(java(_text(pattern)))) - 1
    return F.when(at >= 0, at + skip).otherwise(F.lit(-1))


@function("match_search_query", "value", "query", literal="query", typed=True)
def match_search_query(value: Value, query: str) -> Column:
    from ..search import search_struct

    return search_struct(value.col, value.type, query)
