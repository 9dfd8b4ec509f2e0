"""Search strings: words, fields, wildcards, comparisons and boolean operators, as a boolean column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from .functions.registry import Value

#: Fields of a log that are no tags.
RESERVED = ("host", "source", "status", "service", "trace_id", "message", "timestamp", "tags")
#: Fields that a bare word is looked for in.
DEFAULT_FIELDS = ("message", "title", "stack")
_TOKEN = re.compile(r'\s+|(?P<paren>[()])|(?P<op>AND|OR|NOT)(?=[\s(]|$)|(?P<neg>-(?=[^\s]))|(?P<term>(?:[^\s()":\\]|\\.)+(?=:)|)(?P<colon>:)?(?P<value>"(?:[^"\\]|\\.)*"|[\[{][^\]}]*[\]}]|(?:[^\s()"\\]|\\.)+)')


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    quoted: bool


class _Tree:
    def __init__(self, query: str):
        self.items, at = [], 0
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m or m.end() == at:
                raise ValueError(f"the search can't be read at {query[at:]!r}")
            at = m.end()
            if m["paren"]:
                self.items.append(m["paren"])
            elif m["op"]:
                self.items.append(m["op"])
            elif m["neg"]:
                self.items.append("NOT")
            elif m["value"] is not None:
                field = re.sub(r"\\(.)", r"\1", m["term"]) if m["colon"] else ""
                quoted = m["value"].startswith('"')
                if not quoted and not m["colon"] and m["value"].endswith(":"):
                    raise ValueError(f"{m['value']} has no value")
                self.items.append(Term(field, m["value"][1:-1] if quoted else m["value"], quoted))
        self.at = 0

    def has(self, x: str) -> bool:
        return self.at < len(self.items) and self.items[self.at] == x

    def any_of(self):
        parts = [self.all_of()]
        while self.has("OR"):
            self.at += 1
            parts.append(self.all_of())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def all_of(self):
        parts = []
        while self.at < len(self.items) and not self.has(")") and not self.has("OR"):
            if self.has("AND"):
                self.at += 1
                continue
            parts.append(self.one())
        if not parts:
            raise ValueError("the search has an operator without terms")
        return ("and", parts) if len(parts) > 1 else parts[0]

    def one(self):
        if self.has("NOT"):
            self.at += 1
            return ("not", self.one())
        if self.has("("):
            self.at += 1
            out = self.any_of()
            if not self.has(")"):
                raise ValueError("a bracket is not closed")
            self.at += 1
            return out
        item = self.items[self.at]
        if not isinstance(item, Term):
            raise ValueError(f"{item} is not expected")
        self.at += 1
        return item


def parse_search(query: str):
    """A tree of and, or, not and terms; None matches all."""
    if query.strip() in ("", "*", "*:*"):
        return None
    tree = _Tree(query)
    out = tree.any_of()
    if tree.at < len(tree.items):
        raise ValueError("the search has a bracket too many")
    return out


class _Fields:
    """Columns of a row by name: reserved fields, attributes (``@path``) and tags."""

    def __init__(self, get):
        self.get = get

    def attribute(self, path: str) -> Value | None:
        return self.get(path)

    def tags(self) -> Column:
        for name in ("tags", "ddtags"):
            v = self.get(name)
            if v is not None and v.type.typeName() == "array":
                return F.coalesce(v.col.cast("array<string>"), F.array().cast("array<string>"))
            if v is not None and v.type.typeName() == "map":
                each = F.map_entries(v.col)
                inner = v.type.valueType.typeName() == "array"
                text = lambda e: F.element_at(e["value"], -1) if inner else e["value"]
                return F.transform(each, lambda e: F.concat_ws(":", e["key"], text(e).cast("string")))
        return F.array().cast("array<string>")


def _rx(value: str) -> str:
    """A pattern from text with wildcards."""
    out, i = "", 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            out += re.escape(value[i + 1])
            i += 2
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return out


def _bare(value: str) -> str:
    return re.sub(r"\\(.)", r"\1", value)


def _text(v: Value) -> Column:
    if v.kind == "variant":
        return F.try_variant_get(v.col, "$", "string")
    if v.kind in ("array", "object"):
        return F.lit(None).cast("string")
    return v.col.cast("string")


def _compare(op: str, a: Column, b: Column) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _term(t: Term, fields: _Fields) -> Column:
    name = t.field
    if name in ("_exists_", "_missing_"):
        there = _exists(t.value, fields)
        return there if name == "_exists_" else ~there
    if not t.quoted and name and t.value == "*":
        return _exists(name, fields)
    m = None if t.quoted else re.match(r"^([<>]=?)(.+)$", t.value)
    span = None if t.quoted else re.match(r"^([\[{])(\S+) TO (\S+)([\]}])$", t.value)
    if not name:
        pattern = r"(?s)\b" + (re.escape(_bare(t.value)) if t.quoted else _rx(t.value)) + r"\b"
        if not t.quoted and t.value.endswith("*"):
            pattern = pattern[:-4] if pattern.endswith(r".*\b") else pattern
        tests = [F.coalesce(_text(v).rlike(pattern), F.lit(False)) for f in DEFAULT_FIELDS if (v := fields.attribute(f)) is not None]
        out = F.lit(False)
        for x in tests:
            out = out | x
        return out
    if span:
        low, high = (None if x == "*" else x for x in (span[2], span[3]))
        out = F.lit(True)
        if low is not None:
            out = out & _ordered(name, ">=" if span[1] == "[" else ">", low, fields)
        if high is not None:
            out = out & _ordered(name, "<=" if span[4] == "]" else "<", high, fields)
        return out
    if m:
        return _ordered(name, m[1], m[2], fields)
    wild = not t.quoted and re.search(r"(?<!\\)[*?]", t.value) is not None
    test = (lambda c: c.rlike(f"(?s)^{_rx(t.value)}$")) if wild else (lambda c: c == _bare(t.value))
    if name.startswith("@") or name in RESERVED and name != "tags":
        return _any_value(name.lstrip("@"), test, fields)
    if name == "tags":
        return F.exists(fields.tags(), test)
    value = f"{name}:{t.value}"
    tag = (lambda c: c.rlike(f"(?s)^{_rx(value)}$")) if wild else (lambda c: c == _bare(value))
    return F.exists(fields.tags(), tag)


def _any_value(path: str, test, fields: _Fields) -> Column:
    names = ("source", "ddsource") if path == "source" else (path,)
    out = F.lit(False)
    for n in names:
        v = fields.attribute(n)
        if v is not None:
            out = out | F.coalesce(test(_text(v)), F.lit(False))
    return out


def _exists(name: str, fields: _Fields) -> Column:
    if name.startswith("@") or name in RESERVED and name != "tags":
        out = F.lit(False)
        for n in ("source", "ddsource") if name == "source" else (name.lstrip("@"),):
            v = fields.attribute(n)
            if v is not None:
                out = out | v.col.isNotNull()
        return out
    if name == "tags":
        return F.size(fields.tags()) > 0
    return F.exists(fields.tags(), lambda c: (c == name) | c.startswith(name + ":"))


def _ordered(name: str, op: str, limit: str, fields: _Fields) -> Column:
    limit = _bare(limit).strip('"')
    try:
        number = float(limit)
    except ValueError:
        number = None
    if name.startswith("@"):
        v = fields.attribute(name[1:])
        if v is None:
            return F.lit(False)
        if v.kind == "variant":
            kind = F.schema_of_variant(v.col)
            as_text = F.when(kind == "STRING", F.try_variant_get(v.col, "$", "string"))
            as_number = F.when(kind != "STRING", F.try_variant_get(v.col, "$", "double"))
            return F.coalesce(_compare(op, as_number, F.lit(number)) if number is not None else _compare(op, as_text, F.lit(limit)), F.lit(False))
        if v.kind in ("integer", "float"):
            return F.coalesce(_compare(op, v.col.cast("double"), F.lit(number)), F.lit(False)) if number is not None else F.lit(False)
        # text is compared with text, never with a number
        return F.coalesce(_compare(op, _text(v), F.lit(limit)), F.lit(False)) if v.kind == "string" and number is None else F.lit(False)
    if name in RESERVED and name != "tags":
        return _any_value(name, lambda c: _compare(op, c, F.lit(limit)), fields)
    return F.exists(fields.tags(), lambda c: c.startswith(name + ":") & _compare(op, F.substring(c, len(name) + 2, 2**31 - 1), F.lit(limit)))


def _compiled(tree, fields: _Fields) -> Column:
    if isinstance(tree, Term):
        return _term(tree, fields)
    op, parts = tree
    if op == "not":
        return ~_compiled(parts, fields)
    out = _compiled(parts[0], fields)
    for p in parts[1:]:
        out = out & _compiled(p, fields) if op == "and" else out | _compiled(p, fields)
    return out


def _finder(schema: StructType, column):
    def get(path: str) -> Value | None:
        parts = path.split(".")
        if parts[0] not in schema.names:
            return None
        col, kind = column(parts[0]), schema[parts[0]].dataType
        for i, p in enumerate(parts[1:], 1):
            name = kind.typeName()
            if name == "struct" and p in kind.names:
                col, kind = col.getField(p), kind[p].dataType
            elif name == "map":
                return Value(F.try_element_at(col, F.lit(".".join(parts[i:]))), kind.valueType)
            elif name == "variant":
                return Value(F.try_variant_get(col, "$." + ".".join(parts[i:]), "variant"), kind)
            else:
                return None
        return Value(col, kind)

    return get


def search(df: DataFrame, query: str) -> Column:
    """Whether a row meets the search. A bare word is looked for in the message, ``@path`` in fields, ``key`` in tags."""
    tree = parse_search(query)
    return F.lit(True) if tree is None else _compiled(tree, _Fields(_finder(df.schema, lambda n: F.col(f"`{n}`"))))


def search_struct(col: Column, kind: DataType, query: str) -> Column:
    """As ``search`` over a struct column."""
    if not isinstance(kind, StructType):
        raise ValueError("a search needs an object with known fields")
    tree = parse_search(query)
    return F.lit(True) if tree is None else _compiled(tree, _Fields(_finder(kind, col.getField)))
