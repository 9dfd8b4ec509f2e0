"""Filter, route, exclusive route, union and sampling-free reshaping of event streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..conditions import condition

UNMATCHED = "_unmatched"


def filter_events(df: DataFrame, where: Column | str | Mapping) -> DataFrame:
    """Rows for which the condition is true; an error or null is false."""
    return df.filter(condition(df, where))


def _checked(names: Sequence[str]) -> None:
    if len(set(names)) != len(names):
        raise ValueError("route names must differ")
    if UNMATCHED in names:
        raise ValueError(f"{UNMATCHED} is the name of the route for the rest")


def route(df: DataFrame, routes: Mapping[str, Column | str | Mapping], reroute_unmatched: bool = True) -> dict[str, DataFrame]:
    """A DataFrame for each route; a row goes to every route that it fits, else to ``_unmatched``."""
    _checked(list(routes))
    tests = {name: condition(df, c) for name, c in routes.items()}
    out = {name: df.filter(c) for name, c in tests.items()}
    if reroute_unmatched:
        out[UNMATCHED] = df.filter(~reduce(lambda a, b: a | b, tests.values(), F.lit(False)))
    return out


def route_column(df: DataFrame, routes: Mapping[str, Column | str | Mapping], reroute_unmatched: bool = True, name: str = "route") -> DataFrame:
    """All routes in one pass over the input: a row for each route that a row fits, with the route's name."""
    _checked(list(routes))
    hits = F.array_compact(F.array(*[F.when(condition(df, c), F.lit(n)) for n, c in routes.items()]))
    if reroute_unmatched:
        hits = F.when(F.size(hits) == 0, F.array(F.lit(UNMATCHED))).otherwise(hits)
    return df.withColumn(name, F.explode(hits))


def exclusive_route(df: DataFrame, routes: Sequence[tuple[str, Column | str | Mapping]], name: str = "route") -> DataFrame:
    """The name of the first route that a row fits, else ``_unmatched``."""
    _checked([n for n, _ in routes])
    out = F.lit(UNMATCHED)
    for n, c in reversed(routes):
        out = F.when(condition(df, c), F.lit(n)).otherwise(out)
    return df.withColumn(name, out)


def split_routes(df: DataFrame, names: Sequence[str], name: str = "route") -> dict[str, DataFrame]:
    """Ports of a DataFrame with a route column."""
    return {n: df.filter(F.col(name) == n).drop(name) for n in (*names, UNMATCHED)}


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Several inputs of one component; columns that one lacks are null there."""
    if not inputs:
        raise ValueError("a component needs an input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def project(df: DataFrame, only_fields: Sequence[str] | None = None, except_fields: Sequence[str] | None = None, timestamp_format: str | None = None) -> DataFrame:
    """What an encoder lets through: some fields only, all but some, timestamps as numbers or text."""
    if only_fields is not None:
        names = [c for c in only_fields if c in df.columns]
        df = df.select(*names)
    if except_fields:
        for path in except_fields:
            top, _, rest = path.partition(".")
            if not rest:
                df = df.drop(path)
            elif top in df.columns:
                df = df.withColumn(top, F.col(top).dropFields(rest))
    if timestamp_format is None:
        return df
    forms = {
        "unix": lambda c: F.unix_seconds(c), "unix_ms": lambda c: F.unix_millis(c), "unix_us": lambda c: F.unix_micros(c),
        "unix_ns": lambda c: F.unix_micros(c) * 1000, "unix_float": lambda c: F.unix_micros(c) / 1e6,
        "rfc3339": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    }
    form = forms[timestamp_format]
    return df.withColumns({c: form(F.col(c).cast("timestamp")) for c, kind in df.dtypes if kind in ("timestamp", "timestamp_ntz")})
