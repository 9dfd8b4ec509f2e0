"""Conditions: boolean columns from columns, programs, search strings or the kind of event."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def condition(df: DataFrame, what: Column | str | Mapping) -> Column:
    """A column that is true or false, never null: null and errors are false.

    ``what``: a column; the text of a program that gives a boolean; or a mapping with ``type`` (remap, search, is_log, is_metric,
    is_trace, always_pass, always_fail) and, for the first two, ``source``.
    """
    if isinstance(what, Column):
        return F.coalesce(what, F.lit(False))
    if isinstance(what, str):
        what = {"type": "remap", "source": what}
    kind = what["type"]
    if kind == "remap":
        return program_condition(df, what["source"])
    if kind == "search":
        from .search import search

        return F.coalesce(search(df, what["source"]), F.lit(False))
    if kind in ("is_log", "is_metric", "is_trace"):
        if "event_type" in df.columns and not {"kind", "spans"} & set(df.columns) and kind[3:] in ("log", "metric", "trace") and what.get("mixed"):
            return F.coalesce(F.col("event_type") == kind[3:], F.lit(False))
        own = "metric" if {"name", "kind", "value"} <= set(df.columns) else "trace" if "spans" in df.columns else "log"
        return F.lit(own == kind[3:])
    if kind in ("always_pass", "always_fail"):
        return F.lit(kind == "always_pass")
    raise ValueError(f"{kind} is no kind of condition")


def program_condition(df: DataFrame, source: str) -> Column:
    from .expr import CompileError, Program

    p = Program(df, source, lenient=True, pins=False)
    if p.df is not df:
        raise CompileError("a condition can't look up tables")
    v = p.result.value
    if v.kind not in ("boolean", "null", "variant"):
        raise CompileError(f"a condition must be boolean, not {v.kind}")
    out = p.plain(v, "boolean").col
    for bad in (p.result.error, None if p.error is None else p.error.isNotNull(), None if p.aborted is None else p.aborted.isNotNull()):
        if bad is not None:
            out = F.when(~F.coalesce(bad, F.lit(False)), out)
    return F.coalesce(out, F.lit(False))
