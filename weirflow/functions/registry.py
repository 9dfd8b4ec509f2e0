"""The function registry: names, parameters and how to build a column."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


@dataclass(frozen=True)
class Value:
    """A column with its type, and its value if it is a literal."""

    col: Column
    type: DataType
    literal: object = None
    constant: bool = False

    @property
    def kind(self) -> str:
        """One of: string, binary, integer, float, boolean, timestamp, array, object, null, variant."""
        name = self.type.typeName()
        return {
            "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "float", "double": "float", "decimal": "float",
            "timestamp_ntz": "timestamp", "date": "timestamp", "struct": "object", "map": "object", "void": "null",
        }.get(name, name)


@dataclass(frozen=True)
class Function:
    """``build`` gets columns (or values, if ``typed``), and plain Python values for the parameters in ``literal``.

    A fallible function gives null for an error and for nothing else.
    """

    name: str
    params: dict[str, object]
    build: Callable[..., Column]
    fallible: bool = False
    literal: frozenset[str] = frozenset()
    typed: bool = False
    variadic: bool = False
    required: frozenset[str] = field(default=frozenset())


FUNCTIONS: dict[str, Function] = {}
_REQUIRED = object()


def function(name: str, *params: str, fallible: bool = False, literal: str = "", typed: bool = False, variadic: bool = False):
    """Registers the decorated builder. A parameter is ``name`` or ``name=default``."""
    parsed = {}
    for p in params:
        key, has, default = p.partition("=")
        parsed[key] = ast.literal_eval(default) if has else _REQUIRED
    required = frozenset(k for k, v in parsed.items() if v is _REQUIRED)

    def wrap(build):
        FUNCTIONS[name] = Function(name, {k: None if v is _REQUIRED else v for k, v in parsed.items()}, build, fallible, frozenset(literal.split()), typed, variadic, required)
        return build

    return wrap


def bind(f: Function, args: list, named: dict) -> dict:
    """Arguments by parameter; an error names what is missing or unknown."""
    names = list(f.params)
    if len(args) > len(names) and not f.variadic:
        raise ValueError(f"{f.name} takes {len(names)} arguments, not {len(args)}")
    out = dict(zip(names, args))
    for k, v in named.items():
        if k not in f.params:
            raise ValueError(f"{f.name} has no parameter {k}; it has {names}")
        out[k] = v
    if lacks := [k for k in f.required if k not in out]:
        raise ValueError(f"{f.name} needs {sorted(lacks)}")
    return out


def call(name: str, *args, **named) -> Column:
    """The column of a function whose arguments are columns and, for literal parameters, Python values. Typed functions need values."""
    f = FUNCTIONS[name]
    given = bind(f, list(args), named)
    every = {k: given.get(k, default) for k, default in f.params.items()}
    return f.build(**every)


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """What ``build`` makes of a value that it uses more than once: the value is worked out once a row."""
    return F.get(F.transform(F.array(value), build), 0)


def named_groups(pattern: str) -> tuple[str, dict[str, int], int]:
    """A pattern with plain groups in place of named ones, the names with their numbers, and how many groups there are."""
    places, number, i, inside = {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "(" and not inside:
            m = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.]*)>", pattern[i:])
            if m:
                number += 1
                places[m[1]] = number
            elif pattern[i + 1 : i + 2] != "?":
                number += 1
        i += 1
    return re.sub(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.]*)>", "(", pattern), places, number


def python_few(fn: Callable, returns: str, *columns: Column) -> Column:
    """As ``python``, for values of any length: a worker holds a hundred rows at a time, not an Arrow batch of ten thousand."""

    def run(*row):
        try:
            return None if any(x is None for x in row) else fn(*row)
        except (ValueError, KeyError, IndexError, TypeError, OverflowError):
            return None

    return F.udf(run, returns, useArrow=False)(*columns)


#: How many short texts a worker remembers what a pure function made of, and how short they are.
KEPT, SHORT = 8192, 256


def remembered(fn: Callable) -> Callable:
    """A pure function of a text that is not run again for a short text that it has met of late."""
    kept: dict = {}

    def run(x):
        if type(x) is not str or len(x) > SHORT:
            return fn(x)
        if x not in kept:
            y = fn(x)
            if type(y) is str and len(y) > 8 * SHORT:
                return y
            if len(kept) >= KEPT:
                kept.clear()
            kept[x] = y
        return kept[x]

    return run


def python(fn: Callable, returns: str, *columns: Column, pure: bool = False) -> Column:
    """A Python function over Arrow batches; null where it raises ValueError or an argument is null.

    ``pure`` tells that a function of one text gives the same for the same text, and is costly enough to remember it.
    """
    fn = remembered(fn) if pure else fn

    def run(*series: pd.Series) -> pd.Series:
        out = []
        for row in zip(*series):
            try:
                out.append(None if any(x is None for x in row) else fn(*row))
            except (ValueError, KeyError, IndexError, TypeError, OverflowError):
                out.append(None)
        return pd.Series(out, dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three}[len(columns)], returns)(*columns)
