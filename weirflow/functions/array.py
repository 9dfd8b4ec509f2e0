"""Array and object functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from .registry import Value, function, python


@function("append", "value", "items")
def append(value: Column, items: Column) -> Column:
    return F.concat(value, items)


@function("push", "value", "item")
def push(value: Column, item: Column) -> Column:
    return F.array_append(value, item)


@function("pop", "value")
def pop(value: Column) -> Column:
    return F.slice(value, F.lit(1), F.greatest(F.lit(0), F.size(value) - 1))


@function("chunks", "value", "chunk_size", literal="chunk_size", typed=True)
def chunks(value: Value, chunk_size: int) -> Column:
    size = F.length(value.col) if value.kind == "string" else F.size(value.col)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.ceil(size / chunk_size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.substring if value.kind == "string" else F.slice
    return F.transform(starts, lambda i: cut(value.col, i * chunk_size + 1, F.lit(chunk_size)))


def _compact(x, empties):
    if isinstance(x, dict):
        x = {k: c for k, v in x.items() if (c := _compact(v, empties)) not in empties}
    elif isinstance(x, list):
        x = [c for v in x if (c := _compact(v, empties)) not in empties]
    return x


@function("compact", "value", "recursive=True", "null=True", "string=True", "object=True", "array=True", "nullish=False", literal="recursive null string object array nullish", typed=True)
def compact(value: Value, recursive: bool = True, null: bool = True, string: bool = True, object: bool = True, array: bool = True, nullish: bool = False) -> Column:
    """Without nulls and empty texts, arrays and objects, at every depth."""
    if value.kind == "array":
        inner = value.type.elementType
        text = inner.typeName() == "string"
        return F.filter(value.col, lambda x: x.isNotNull() & ((x != "") if text and string else F.lit(True)))
    if value.type.typeName() == "map":
        text = value.type.valueType.typeName() == "string"
        return F.map_filter(value.col, lambda _, x: x.isNotNull() & ((x != "") if text and string else F.lit(True)))
    empties = [x for x, drop in ((None, null), ("", string), ({}, object), ([], array)) if drop]
    return F.try_parse_json(python(lambda s: json.dumps(_compact(json.loads(s), empties)), "string", F.to_json(value.col)))


def _flat(x, separator: str, prefix: str = "") -> dict:
    out = {}
    for k, v in x.items():
        if isinstance(v, dict) and v:
            out |= _flat(v, separator, f"{prefix}{k}{separator}")
        else:
            out[prefix + k] = v
    return out


def _flat_list(x) -> list:
    return [z for y in x for z in (_flat_list(y) if isinstance(y, list) else [y])]


@function("flatten", "value", "separator='.'", literal="separator", typed=True)
def flatten(value: Value, separator: str = ".") -> Column:
    """Arrays of arrays become one array; objects in objects become keys with dots."""
    if value.kind == "array":
        out, kind = value.col, value.type.elementType
        while kind.typeName() == "array":
            out, kind = F.flatten(out), kind.elementType
        return out
    if value.kind == "object" and value.type.typeName() == "struct":
        cols: list[Column] = []

        def walk(c: Column, kind, prefix: str) -> None:
            for f in kind.fields:
                if f.dataType.typeName() == "struct":
                    walk(c.getField(f.name), f.dataType, f"{prefix}{f.name}{separator}")
                else:
                    cols.append(c.getField(f.name).alias(prefix + f.name))

        walk(value.col, value.type, "")
        return F.struct(*cols)
    return F.try_parse_json(python(lambda s: json.dumps(_flat_list(x) if isinstance(x := json.loads(s), list) else _flat(x, separator)), "string", F.to_json(value.col)))


@function("unflatten", "value", "separator='.'", literal="separator")
def unflatten(value: Column, separator: str = ".") -> Column:
    def build(s: str) -> str:
        out: dict = {}
        for key, v in json.loads(s).items():
            at, parts = out, key.split(separator)
            for p in parts[:-1]:
                at = at.setdefault(p, {})
                if not isinstance(at, dict):
                    raise ValueError(key)
            at[parts[-1]] = v
        return json.dumps(out)

    return F.try_parse_json(python(build, "string", F.to_json(value)))


@function("includes", "value", "item")
def includes(value: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(value, item), F.lit(False))


@function("join", "value", "separator=''", literal="separator")
def join(value: Column, separator: str = "") -> Column:
    return F.array_join(value, separator)


@function("length", "value", typed=True)
def length(value: Value) -> Column:
    """Bytes of a text, items of an array, keys of an object."""
    if value.kind == "string":
        return F.octet_length(value.col).cast("bigint")
    if value.type.typeName() == "struct":
        return F.lit(len(value.type.fields)).cast("bigint")
    if value.kind == "variant":
        text = F.to_json(value.col)
        return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text))).cast("bigint")
    return F.size(value.col).cast("bigint")


@function("keys", "value", typed=True)
def keys(value: Value) -> Column:
    if value.type.typeName() == "struct":
        return F.array(*[F.lit(f.name) for f in value.type.fields])
    if value.kind == "variant":
        return F.json_object_keys(F.to_json(value.col))
    return F.map_keys(value.col)


@function("values", "value", typed=True)
def values(value: Value) -> Column:
    if value.type.typeName() == "struct":
        return F.array(*[value.col.getField(f.name) for f in value.type.fields])
    return F.map_values(value.col)


@function("zip", "array_0", "array_1")
def zip_(array_0: Column, array_1: Column) -> Column:
    n = F.least(F.size(array_0), F.size(array_1))
    return F.slice(F.zip_with(array_0, array_1, lambda a, b: F.array(a, b)), F.lit(1), n)


@function("unique", "value")
def unique(value: Column) -> Column:
    return F.array_distinct(value)


@function("tally", "value")
def tally(value: Column) -> Column:
    """How often each text is in the array, by the text's order."""
    each = F.array_sort(F.array_distinct(value))
    return F.map_from_entries(F.transform(each, lambda v: F.struct(v.alias("key"), F.size(F.filter(value, lambda x: x == v)).cast("bigint").alias("value"))))


@function("tally_value", "array", "value")
def tally_value(array: Column, value: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == value)).cast("bigint")


@function("match_array", "value", "pattern", "all=False", literal="pattern all")
def match_array(value: Column, pattern, all: bool = False) -> Column:
    from .string import _text, java

    test = lambda x: x.rlike(java(_text(pattern)))
    return F.forall(value, test) if all else F.exists(value, test)


@function("object_from_array", "values", "keys=None", typed=True)
def object_from_array(values: Value, keys: Value | None = None) -> Column:
    if keys is not None:
        return F.map_from_arrays(keys.col, values.col)
    return F.map_from_entries(F.transform(values.col, lambda p: F.struct(p[0].cast("string").alias("key"), p[1].alias("value"))))


@function("merge", "to", "from", "deep=False", literal="deep", typed=True)
def merge(to: Value, deep: bool = False, **rest: Value) -> Column:
    """Fields of the second over those of the first; with ``deep``, objects in both are merged as well."""
    other = rest["from"]
    names = (to.type.typeName(), other.type.typeName())
    if names == ("struct", "struct"):
        def both(a: Column, ta, b: Column, tb) -> Column:
            cols, there = [], {f.name: f.dataType for f in tb.fields}
            for f in ta.fields:
                if f.name not in there:
                    cols.append(a.getField(f.name).alias(f.name))
                elif deep and f.dataType.typeName() == there[f.name].typeName() == "struct":
                    cols.append(both(a.getField(f.name), f.dataType, b.getField(f.name), there[f.name]).alias(f.name))
                else:
                    cols.append(b.getField(f.name).alias(f.name))
            own = {f.name for f in ta.fields}
            return F.struct(*cols, *[b.getField(f.name).alias(f.name) for f in tb.fields if f.name not in own])

        return both(to.col, to.type, other.col, other.type)
    if names == ("map", "map"):
        left = F.map_filter(to.col, lambda k, _: ~F.map_contains_key(other.col, k))
        return F.map_concat(left, other.col)

    def join_up(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = join_up(out[k], v) if deep and isinstance(out.get(k), dict) and isinstance(v, dict) else v
        return out

    text = lambda v: F.to_json(v.col)
    return F.try_parse_json(python(lambda a, b: json.dumps(join_up(json.loads(a), json.loads(b))), "string", text(to), text(other)))


@function("get", "value", "path", literal="path", typed=True)
def get(value: Value, path: list) -> Column:
    at, kind = value.col, value.type
    for p in path:
        name = kind.typeName()
        if name == "struct":
            if p not in kind.names:
                return F.lit(None)
            at, kind = at.getField(p), kind[p].dataType
        elif name == "map":
            at, kind = F.try_element_at(at, F.lit(p)), kind.valueType
        elif name == "array":
            at, kind = F.try_element_at(at, F.lit(p + 1 if p >= 0 else p)), kind.elementType
        else:
            step = f"[{p}]" if isinstance(p, int) else f"['{p}']"
            at = F.try_variant_get(at, "$" + step, "variant")
    return at


@function("remove", "value", "path", literal="path", typed=True)
def remove(value: Value, path: list) -> Column:
    if value.type.typeName() == "struct":
        return value.col.dropFields(".".join(path))
    return F.map_filter(value.col, lambda k, _: k != path[0])


@function("set", "value", "path", "data", literal="path", typed=True)
def set_(value: Value, path: list, data: Value) -> Column:
    if value.type.typeName() == "struct":
        return value.col.withField(".".join(path), data.col)
    return F.map_concat(F.map_filter(value.col, lambda k, _: k != path[0]), F.create_map(F.lit(path[0]), data.col))
