"""Lines joined to messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.order import fold

MODES = ("continue_through", "continue_past", "halt_before", "halt_with")


class _Lines:
    """The number of the message that each line belongs to."""

    def __init__(self, mode: str, timeout_us: int | None):
        self.mode, self.timeout, self.number, self.open, self.last = mode, timeout_us, 0, False, 0

    def __call__(self, starts: bool, fits: bool, us: int | None) -> tuple:
        if self.open and self.timeout is not None and us is not None and us - self.last >= self.timeout:
            self.open = False
        if us is not None:
            self.last = us
        if not self.open:
            self.number += 1
            self.open = starts
            return (self.number,)
        if self.mode == "continue_through":
            if not fits:
                self.number, self.open = self.number + 1, starts
        elif self.mode == "continue_past":
            self.open = fits
        elif self.mode == "halt_before":
            if fits:
                # the line that ends a message is one of its own, and begins one if it can
                self.number, self.open = self.number + 1, starts
        elif fits:
            self.open = False
        return (self.number,)


def join_lines(df: DataFrame, start_pattern: str, condition_pattern: str, mode: str, order: Sequence[str], group_by: Sequence[str] = (), message: str = "message", timeout_ms: int | None = None, time_col: str | None = None, separator: str = "\n") -> DataFrame:
    """group_by, the first line's order columns, message and lines: lines from one that fits ``start_pattern`` on, by ``mode``.

    continue_through: all that fit the condition; continue_past: up to and with the first that doesn't; halt_before: up to the first
    that fits, which stands alone; halt_with: up to and with it. Lines that start nothing pass by themselves.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    us = F.unix_micros(F.col(time_col).cast("timestamp")) if time_col else F.lit(None).cast("bigint")
    c = F.coalesce(F.col(message), F.lit(""))
    marked = df.withColumn("_start", c.rlike(start_pattern)).withColumn("_fits", c.rlike(condition_pattern)).withColumn("_us", us)
    out = fold(marked, group_by, order, ["_start", "_fits", "_us"], lambda: _Lines(mode, None if timeout_ms is None else timeout_ms * 1000), "_message bigint")
    at = F.struct(*order).alias("at")
    lines = out.groupBy(*group_by, "_message").agg(F.array_sort(F.collect_list(F.struct(at, F.col(message).alias("line")))).alias("_l"))
    first = F.get("_l", 0)["at"]
    return lines.select(*group_by, *[first.getField(o).alias(o) for o in order if o not in group_by], F.array_join(F.transform("_l", lambda x: x["line"]), separator).alias(message), F.size("_l").alias("lines"))


def join_from_starts(df: DataFrame, starts: Column, order: Sequence[str], group_by: Sequence[str], message: str = "message", separator: str = "\n") -> DataFrame:
    """The common case without a fold: every line up to the next start joins the start before it."""
    w = Window.partitionBy(*group_by).orderBy(*order)
    rows = df.withColumn("_message", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))
    lines = rows.groupBy(*group_by, "_message").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.col(message).alias("line")))).alias("_l"))
    first = F.get("_l", 0)["at"]
    return lines.select(*group_by, *[first.getField(o).alias(o) for o in order if o not in group_by], F.array_join(F.transform("_l", lambda x: x["line"]), separator).alias(message), F.size("_l").alias("lines"))
