"""Operators over streams: built-in windows and state where they fit, state of our own with timers where they don't.

Event time with a watermark takes the place of a clock: a session ends when the watermark passes its expiry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..operators.state import _Bucket


#: State of our own is kept in this store: on disk, with only changes written at a checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stored(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df


def aggregated(metrics: DataFrame, interval_ms: int, keys: Sequence[str] = ("name",), mode: str = "sum", lateness: str = "10 seconds", time_col: str = "ts") -> DataFrame:
    """window_start, keys and value of each tumbling window: sum, count, max, min, mean or stdev of counters and gauges."""
    f = {"sum": F.sum, "auto": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "stdev": F.stddev_pop, "count": F.count}[mode]
    rows = metrics.withWatermark(time_col, lateness).withColumn("_v", F.col("value.value") if "struct" in dict(metrics.dtypes)["value"] else F.col("value"))
    return rows.groupBy(F.window(time_col, f"{interval_ms} milliseconds"), *keys).agg(f("_v").cast("double").alias("value")).select(F.col("window.start").alias("window_start"), *keys, "value")


def sessions(df: DataFrame, keys: Sequence[str], expire_after: str, aggs: dict, lateness: str = "10 seconds", time_col: str = "ts") -> DataFrame:
    """Sessions that end after a pause, by the built-in session window."""
    grouped = df.withWatermark(time_col, lateness).groupBy(F.session_window(time_col, expire_after), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggs)


def deduplicated(df: DataFrame, keys: Sequence[str], within: str, time_col: str = "ts") -> DataFrame:
    """The first row of each key within the watermark's delay; state older than that goes."""
    return df.withWatermark(time_col, within).dropDuplicatesWithinWatermark(list(keys))


class _Throttle(StatefulProcessor):
    """The rate limit of each key; when its next row is due is all that is kept."""

    def __init__(self, threshold: int, window_s: float, columns: list[str], time_col: str):
        self.threshold, self.window_s, self.columns, self.time_col = threshold, window_s, columns, time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due bigint", max(1000, int(self.window_s * 2000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = _Bucket(self.threshold, self.window_s)
        if self.due.exists():
            bucket.due = self.due.get()[0]
        batch = pd.concat(list(rows)).sort_values(self.time_col)
        at = batch[self.time_col].astype("datetime64[us]").astype("int64")
        keep = [bucket(False, int(us))[0] for us in at]
        if bucket.due is not None:
            self.due.update((bucket.due,))
        yield batch.loc[keep, self.columns]

    def close(self) -> None:
        pass


def throttled(df: DataFrame, keys: Sequence[str], threshold: int, window_s: float, time_col: str = "ts") -> DataFrame:
    return _stored(df).groupBy(*keys).transformWithStateInPandas(_Throttle(threshold, window_s, df.columns, time_col), df.schema, "append", "ProcessingTime")


class _Reduce(StatefulProcessor):
    """One open session a key: sums of numbers, first values of all else; it ends at a row that ends it, or when it expires."""

    def __init__(self, numbers: list[str], others: list[str], ends: str, expire_ms: int, state: str, time_col: str, keys: list[str]):
        self.numbers, self.others, self.ends, self.expire, self.schema, self.time_col, self.keys = numbers, others, ends, expire_ms, state, time_col, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schema)

    def _row(self, key, held: tuple) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(self.keys, key)) | dict(zip([*self.numbers, *self.others, "events"], held[:-1]))])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(self.time_col).to_dict("records"):
            ms = int(pd.Timestamp(row[self.time_col]).value // 1_000_000)
            if held is not None and ms - held[-1] >= self.expire:
                out.append(self._row(key, held))
                held = None
            if held is None:
                held = (*[float(row[n]) for n in self.numbers], *[row[o] for o in self.others], 1, ms)
            else:
                n = len(self.numbers)
                held = (*[a + float(row[c]) for a, c in zip(held[:n], self.numbers)], *held[n:-2], held[-2] + 1, ms)
            if row[self.ends]:
                out.append(self._row(key, held))
                held = None
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer(held[-1] + self.expire)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            held = self.open.get()
            self.open.clear()
            yield self._row(key, held)

    def close(self) -> None:
        pass


def reduced(df: DataFrame, keys: Sequence[str], numbers: Sequence[str], others: Sequence[str], ends_when, expire_after_ms: int = 30_000, lateness: str = "10 seconds", time_col: str = "ts") -> DataFrame:
    """keys, sums of ``numbers``, first values of ``others``, and events of each session; see the batch operator for all strategies."""
    from ..conditions import condition

    kinds = {f.name: f.dataType for f in df.schema.fields}
    state = ", ".join([*[f"n{i} double" for i in range(len(numbers))], *[f"o{i} {kinds[o].simpleString()}" for i, o in enumerate(others)], "events bigint", "last bigint"])
    out = StructType([*[StructField(k, kinds[k]) for k in keys], *[StructField(n, _parse_datatype_string("double")) for n in numbers], *[StructField(o, kinds[o]) for o in others], StructField("events", _parse_datatype_string("bigint"))])
    rows = _stored(df).withColumn("ends_here", condition(df, ends_when)).withWatermark(time_col, lateness)
    return rows.groupBy(*keys).transformWithStateInPandas(_Reduce(list(numbers), list(others), "ends_here", expire_after_ms, state, time_col, list(keys)), out, "append", "EventTime")


def written(df: DataFrame, path: str, checkpoint: str, format: str = "parquet", mode: str = "append"):
    """A started query that writes files and keeps its place in ``checkpoint``: after a failure it goes on from there."""
    return df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
