"""Pipelines from configuration: named sources, transforms and sinks, wired by their inputs, as lazily built DataFrames."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..expr import remap
from ..operators import aggregate as _aggregate, convert, enrich, multiline, reduce as _reduce, routing, state
from ..sources.readers import read
from ..sources.sinks import write


class ConfigError(ValueError):
    """What is wrong with a configuration, all of it at once."""


def interpolated(text: str, variables: Mapping[str, str]) -> str:
    """``$NAME``, ``${NAME}``, ``${NAME:-default}`` and ``${NAME:?message}`` filled in; ``$$`` is a dollar sign."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        name, op, rest = m[1] or m[2], m[3], m[4]
        value = variables.get(name)
        if op in (":-", "-"):
            return value if value or op == "-" and value is not None else rest
        if op in (":?", "?") and not value:
            raise ConfigError(rest or f"{name} is not set")
        if value is None:
            raise ConfigError(f"{name} is not set")
        return value

    return re.sub(r"\$\$|\$(\w+)|\$\{(\w+)(?:(:?[-?])([^}]*))?\}", one, text)


def _order(c: Mapping) -> list[str]:
    return list(c.get("order", ["ts"]))


Ports = dict[str, DataFrame]


def _one(f: Callable[..., DataFrame]) -> Callable[..., Ports]:
    return lambda df, c, tables: {"": f(df, c, tables)}


def _rest(c: Mapping, *drop: str) -> dict:
    return {k: v for k, v in c.items() if k not in ("type", "inputs", *drop)}


def _remap(df: DataFrame, c: Mapping, tables: Mapping[str, DataFrame]) -> Ports:
    options = {k: c[k] for k in ("drop_on_error", "drop_on_abort") if k in c}
    if c.get("reroute_dropped"):
        kept, dropped = remap(df, c["source"], reroute_dropped=True, tables=dict(tables), **options)
        return {"": kept, "dropped": dropped}
    return {"": remap(df, c["source"], tables=dict(tables), **options)}


def _route(df: DataFrame, c: Mapping, tables: Mapping) -> Ports:
    return routing.route(df, c["route"], c.get("reroute_unmatched", True))


def _exclusive(df: DataFrame, c: Mapping, tables: Mapping) -> Ports:
    rules = [(r["name"], r["condition"]) for r in c["routes"]]
    return routing.split_routes(routing.exclusive_route(df, rules), [n for n, _ in rules])


def _dedupe(df: DataFrame, c: Mapping, tables: Mapping) -> DataFrame:
    fields = c.get("fields", {})
    match = fields.get("match") or (None if "ignore" in fields else [f for f in ("message", "host", "ts") if f in df.columns])
    if "time_settings" in c:
        return state.dedupe_timed(df, c["time_settings"]["max_age_ms"], order=_order(c), match=match, ignore=fields.get("ignore"), refresh_on_drop=c["time_settings"].get("refresh_on_drop", False))
    if "cache" in c:
        return state.dedupe_recent(df, _order(c), match, fields.get("ignore"), c["cache"].get("num_events", 5000), c.get("scope", ()))
    return state.dedupe(df, _order(c), match, fields.get("ignore"))


def _cardinality(df: DataFrame, c: Mapping, tables: Mapping) -> DataFrame:
    scope = ["namespace", "name"] if c.get("tracking_scope") == "per_metric" else []
    f = state.cardinality_limit_events if c.get("limit_exceeded_action") == "drop_event" else state.cardinality_limit
    return f(df, c.get("value_limit", 500), _order(c), scope, c.get("per_tag_limits"))


#: Transforms by name: from a DataFrame, the configuration and the enrichment tables to ports by name ("" is the main one).
TRANSFORMS: Mapping[str, Callable[[DataFrame, Mapping, Mapping], Ports]] = {
    "filter": _one(lambda df, c, t: routing.filter_events(df, c["condition"])),
    "route": _route,
    "exclusive_route": _exclusive,
    "remap": _remap,
    "log_to_metric": _one(lambda df, c, t: convert.all_metrics(df) if c.get("all_metrics") else convert.log_to_metric(df, c["metrics"])),
    "metric_to_log": _one(lambda df, c, t: convert.metric_to_log(df, c.get("host_tag", "host"), c.get("metric_tag_values", "single"))),
    "trace_to_log": _one(lambda df, c, t: convert.trace_to_log(df)),
    "lua": _one(lambda df, c, t: convert.scripted(df, c["hooks"], c.get("schema"))),
    "aggregate": _one(lambda df, c, t: _aggregate.aggregate(df, c.get("interval_ms", 10_000), c.get("mode", "auto").lower(), _order(c))),
    "incremental_to_absolute": _one(lambda df, c, t: _aggregate.incremental_to_absolute(df, _order(c), c.get("cache", {}).get("time_to_live", 300))),
    "reduce": _one(lambda df, c, t: _reduce.reduce(df, **_rest(c, "flush_period_ms"))),
    "sample": _one(lambda df, c, t: state.sample(df, **_rest(c))),
    "dedupe": _one(_dedupe),
    "window": _one(lambda df, c, t: state.context_window(df, **_rest(c))),
    "throttle": _one(lambda df, c, t: state.throttle(df, c["threshold"], c["window_secs"], c.get("key_field", ()), c.get("exclude"), order=_order(c))),
    "tag_cardinality_limit": _one(_cardinality),
    "delay": _one(lambda df, c, t: convert.delayed(df, c["delay_ms"])),
    "multiline": _one(lambda df, c, t: multiline.join_lines(df, **_rest(c))),
    "metadata": _one(lambda df, c, t: enrich.with_metadata(df, c["fields"], c.get("required", True), "tags" in df.columns)),
}


class Pipeline:
    """A checked configuration; DataFrames are built when asked for, each once."""

    def __init__(self, spark: SparkSession, config: Mapping, inputs: Mapping[str, DataFrame] | None = None, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.config = spark, config
        self.given, self.tables = dict(inputs or {}), dict(tables or {})
        self.built: dict[str, Ports] = {}
        self.check()

    @property
    def sources(self) -> Mapping:
        return self.config.get("sources", {})

    @property
    def transforms(self) -> Mapping:
        return self.config.get("transforms", {})

    @property
    def sinks(self) -> Mapping:
        return self.config.get("sinks", {})

    def ports(self, name: str) -> list[str]:
        """The outputs of a component, known before anything is built."""
        c = self.transforms.get(name, {})
        if c.get("type") == "route":
            return [*(f"{name}.{r}" for r in c.get("route", {})), *([f"{name}._unmatched"] if c.get("reroute_unmatched", True) else [])]
        if c.get("type") == "exclusive_route":
            return [*(f"{name}.{r['name']}" for r in c.get("routes", [])), f"{name}._unmatched"]
        return [name, f"{name}.dropped"] if c.get("type") == "remap" and c.get("reroute_dropped") else [name]

    def outputs(self) -> list[str]:
        return [p for n in (*self.given, *self.sources, *self.transforms) for p in self.ports(n)]

    def resolved(self, inputs: Sequence[str]) -> list[str]:
        """Names of outputs; ``*`` stands for any text."""
        known, out = self.outputs(), []
        for i in inputs:
            hits = [i] if i in known else [o for o in known if "*" in i and fnmatch.fnmatchcase(o, i)]
            if not hits:
                raise ConfigError(f"nothing is named {i}")
            out += [h for h in hits if h not in out]
        return out

    def check(self) -> None:
        wrong = []
        names = [*self.given, *self.sources, *self.transforms, *self.sinks]
        wrong += [f"{n} is there twice" for n in {n for n in names if names.count(n) > 1}]
        wrong += [f"{n}: {c.get('type')} is no transform" for n, c in self.transforms.items() if c.get("type") not in TRANSFORMS]
        edges: dict[str, list[str]] = {}
        for n, c in (*self.transforms.items(), *self.sinks.items()):
            if not c.get("inputs"):
                wrong.append(f"{n} has no inputs")
                continue
            try:
                edges[n] = [i.split(".")[0] if i not in names else i for i in self.resolved(c["inputs"])]
            except ConfigError as e:
                wrong.append(f"{n}: {e}")
        state: dict[str, int] = {}

        def visit(n: str) -> None:
            if state.get(n) == 1:
                wrong.append(f"{n} feeds itself")
            elif n not in state:
                state[n] = 1
                for m in edges.get(n, []):
                    visit(m)
                state[n] = 2

        for n in edges:
            visit(n)
        if wrong:
            raise ConfigError("; ".join(dict.fromkeys(wrong)))

    def component(self, name: str) -> Ports:
        if name not in self.built:
            if name in self.given:
                self.built[name] = {"": self.given[name]}
            elif name in self.sources:
                c = self.sources[name]
                self.built[name] = {"": read(self.spark, c["type"], **_rest(c))}
            else:
                c = self.transforms[name]
                self.built[name] = TRANSFORMS[c["type"]](self.input(c["inputs"]), c, self.tables)
        return self.built[name]

    def output(self, name: str) -> DataFrame:
        """The DataFrame of an output, by the component's name or ``name.port``."""
        if name in (*self.given, *self.sources, *self.transforms):
            return self.component(name)[""]
        owner, _, port = name.rpartition(".")
        return self.component(owner)[port]

    def input(self, inputs: Sequence[str]) -> DataFrame:
        return routing.union_inputs(*[self.output(i) for i in self.resolved(inputs)])

    def run(self) -> None:
        """Writes every sink."""
        for c in self.sinks.values():
            write(self.input(c["inputs"]), c["type"], **_rest(c))

    def test(self, inputs: Mapping[str, DataFrame], output: str, conditions: Sequence) -> list[bool]:
        """A unit test: rows put in place of components, and whether some row of an output meets each condition."""
        from ..conditions import condition

        own = Pipeline.__new__(Pipeline)
        own.spark, own.config, own.given, own.tables, own.built = self.spark, self.config, {**self.given, **inputs}, self.tables, {n: {"": df} for n, df in inputs.items()}
        found = own.output(output)
        return [bool(found.filter(condition(found, c)).head(1)) for c in conditions]
