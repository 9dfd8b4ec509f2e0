"""Templates: text with ``{{ field }}`` and strftime parts, as a column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

PART = re.compile(r"\{\{\s*(.*?)\s*\}\}")
STRFTIME = re.compile(r"%[-_0^#:]*[A-Za-z%+]")


def field(df: DataFrame, path: str) -> Column | None:
    """The column under a dotted path, or None if there is none. Maps are looked up by the rest of the path."""
    parts = path.lstrip(".").replace('"', "").split(".")
    if parts[0] not in df.columns:
        return None
    at, kind = F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType
    for i, p in enumerate(parts[1:], 1):
        if kind.typeName() == "struct":
            if p not in kind.names:
                return None
            at, kind = at.getField(p), kind[p].dataType
        elif kind.typeName() == "map":
            return F.try_element_at(at, F.lit(".".join(parts[i:])))
        elif kind.typeName() == "variant":
            return F.try_variant_get(at, "$." + ".".join(parts[i:]), "string")
        else:
            return None
    return at


def template(df: DataFrame, text: str, time_col: str = "ts") -> Column:
    """The rendered text; null if a field is missing or null, never a text with a hole in it."""
    from .functions.time import format_timestamp

    out: list[Column] = []

    def literal(part: str) -> None:
        if not part:
            return
        if STRFTIME.search(part) and time_col in df.columns:
            out.append(format_timestamp(F.col(time_col).cast("timestamp"), part))
        else:
            out.append(F.lit(part))

    last = 0
    for m in PART.finditer(text):
        literal(text[last : m.start()])
        value = field(df, m[1])
        if value is None and m[1].startswith("tags.") and "tags" in df.columns:
            value = F.element_at(F.try_element_at("tags", F.lit(m[1][5:])), -1)
        out.append(F.lit(None).cast("string") if value is None else value.cast("string"))
        last = m.end()
    literal(text[last:])
    return out[0].cast("string") if len(out) == 1 else F.concat(*out) if out else F.lit("")


def confined(path: Column) -> Column:
    """A rendered path, or null if it would leave its folder."""
    return F.when(~path.rlike(r"(^|/)\.\.(/|$)") & ~path.startswith("/") & ~path.contains("\u0000"), path)
