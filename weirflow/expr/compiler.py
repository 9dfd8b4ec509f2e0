"""Compiles programs to columns: a program is run once over symbols, and what it leaves in each field is one expression.

Branches become CASE expressions, fallible calls carry an error column beside their value, and lookups in enrichment tables become
joins before the projection. Types are those of the DataFrame; open data is VARIANT. A null column counts as absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, NullType, StringType, TimestampType, VariantType

from ..functions import FUNCTIONS
from ..functions.convert import as_kind
from ..functions.registry import Value, bind
from .parser import Abort, Array, Assign, Binary, Block, Call, If, Index, Literal, Object, Path, Unary, parse


class CompileError(ValueError):
    """A program that is well formed but has no meaning here."""


@dataclass(frozen=True)
class Result:
    """A value, and when it is an error (None: never)."""

    value: Value
    error: Column | None = None
    message: str = ""


@dataclass
class State:
    fields: dict[str, Value]
    variables: dict[str, Value] = field(default_factory=dict)
    meta: dict[str, Value] = field(default_factory=dict)
    root: Value | None = None

    def copy(self) -> "State":
        return State(dict(self.fields), dict(self.variables), dict(self.meta), self.root)


#: The value that a failed ``ok, err =`` assigns, by kind.
DEFAULTS = {"string": "", "integer": 0, "float": 0.0, "boolean": False}


def literal_of(node):
    """The Python value of an expression made of literals."""
    if isinstance(node, Literal):
        return re.compile(_python(node.value)) if node.kind == "regex" else node.value
    if isinstance(node, Array):
        return [literal_of(x) for x in node.items]
    if isinstance(node, Object):
        return {k: literal_of(v) for k, v in node.items}
    if isinstance(node, Unary) and node.op == "-":
        return -literal_of(node.value)
    raise CompileError("a literal is needed here")


def _python(pattern: str) -> str:
    return re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern)


class Program:
    """A compiled program over ``df``; ``tables`` are the enrichment tables that it may look up.

    Without ``pins`` no column is added to ``df``, as is needed where only an expression is wanted.
    """

    def __init__(self, df: DataFrame, source: str, tables: dict[str, DataFrame] | None = None, lenient: bool = False, pins: bool = True):
        self.df, self.tables, self.lenient, self.pinning = df, tables or {}, lenient, pins
        self.state = State({f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})
        #: What may end the program, in order: whether it is an error, its message, and when.
        self.ends: list[tuple[bool, Column, Column]] = []
        self.guard: Column | None = None
        self._log: list[DataType] | None = None
        self._replay: list[DataType] | None = None
        self._depth = 0
        self.result = self.block(parse(source))

    @property
    def error(self) -> Column | None:
        return self._ended(True)

    @property
    def aborted(self) -> Column | None:
        return self._ended(False)

    def _ended(self, by_error: bool) -> Column | None:
        """The message of the error, or of the abort, that comes first; null if the program ends otherwise."""
        own = [i for i, (kind, _, _) in enumerate(self.ends) if kind == by_error]
        out = F
        for kind, message, test in self.ends[: own[-1] + 1] if own else ():
            out = out.when(test, message if kind == by_error else F.lit(None).cast("string"))
        return out if own else None

    # ---- types ----

    def pinned(self, v: Value) -> Value:
        """A value as a column under the program, so that what uses it more than once does not work it out again.

        Values that do not need one another lie in one projection.
        """
        frames = [self.base]
        for level in self.pins:
            frames.append(frames[-1].select("*", *[c.alias(k) for k, c in level.items()]))
        at = len(self.pins)
        for i, frame in enumerate(frames[:-1]):
            try:
                frame.select(v.col)
            except AnalysisException:
                continue
            at = i
            break
        taken = set(self.df.columns)
        name = next(n for i in range(len(taken) + 1) if (n := f"_pin{i}") not in taken)
        if at == len(self.pins):
            self.pins.append({})
        self.pins[at][name] = v.col
        self._frame = frames[at]
        for level in self.pins[at:]:
            self._frame = self._frame.select("*", *[c.alias(k) for k, c in level.items()])
        return Value(F.col(name), v.type)

    @property
    def df(self) -> DataFrame:
        return self._frame

    @df.setter
    def df(self, frame: DataFrame) -> None:
        self.base = self._frame = frame
        self.pins = []

    def typed(self, col: Column) -> Value:
        if self._replay is not None:
            return Value(col, self._replay.pop(0))
        kind = self.df.select(col.alias("x")).schema["x"].dataType
        if self._log is not None:
            self._log.append(kind)
        return Value(col, kind)

    def plain(self, v: Value, kind: str) -> Value:
        """A variant as a value of a kind, null if it has another."""
        if v.kind != "variant":
            return v
        if kind == "float":
            return Value(F.coalesce(as_kind(v, "float"), as_kind(v, "integer").cast("double")), DoubleType())
        types = {"string": StringType(), "integer": LongType(), "boolean": BooleanType(), "timestamp": TimestampType()}
        return Value(as_kind(v, kind), types[kind]) if kind in types else v

    def aligned(self, values: list[Value]) -> list[Value]:
        """The values with one type."""
        kinds = {v.kind for v in values} - {"null"}
        if not kinds:
            return values
        types = {v.type for v in values if v.kind != "null"}
        if len(types) == 1:
            target = next(iter(types))
        elif kinds <= {"integer", "float"}:
            target = DoubleType() if "float" in kinds else LongType()
        elif kinds == {"timestamp"}:
            target = TimestampType()
        else:
            target = VariantType()
        out = []
        for v in values:
            if v.type == target:
                out.append(v)
            elif target == VariantType():
                out.append(Value(self.variant(v), target))
            else:
                out.append(Value(v.col.cast(target), target))
        return out

    @staticmethod
    def variant(v: Value) -> Column:
        if v.kind == "variant":
            return v.col
        if v.kind == "null":
            return F.lit(None).cast("variant")
        if v.kind in ("object", "array"):
            return F.parse_json(F.to_json(v.col, {"ignoreNullFields": "false"}))
        return v.col.cast("variant")

    # ---- statements ----

    def block(self, node: Block) -> Result:
        out = Result(Value(F.lit(None), NullType()))
        for s in node.statements:
            out = self.statement(s)
        return out

    def statement(self, node) -> Result:
        if isinstance(node, Assign):
            return self.assign(node)
        if isinstance(node, Abort):
            text = F.lit("aborted") if node.message is None else self.handled(self.expression(node.message)).col.cast("string")
            self.end(False, text, F.lit(True))
            return Result(Value(F.lit(None), NullType()))
        out = self.expression(node)
        # the value of the last statement may still be handled where it is used
        return out

    def end(self, by_error: bool, message: Column, when: Column) -> None:
        self.ends.append((by_error, message, when if self.guard is None else self.guard & when))

    def raised(self, r: Result) -> Value:
        """The value of a call with a bang: an error ends the program."""
        if r.error is not None:
            self.end(True, F.lit(r.message), r.error)
        return r.value

    def handled(self, r: Result) -> Value:
        if r.error is not None and not self.lenient and self._depth == 0:
            raise CompileError(f"an error of {r.message} is not handled: use !, ?? or a second target")
        return r.value

    def assign(self, node: Assign) -> Result:
        r = self.statement(node.value)
        v = r.value
        if node.error is not None:
            bad = F.lit(False) if r.error is None else r.error
            default = DEFAULTS.get(v.kind)
            if r.error is not None and default is not None:
                v = Value(F.when(bad, F.lit(default).cast(v.type)).otherwise(v.col), v.type)
            self.store(node.target, v)
            self.store(node.error, Value(F.when(bad, F.lit(r.message)), StringType()))
            return Result(v)
        if node.op == "??=":
            if r.error is not None:
                old = self.load(node.target)
                a, b = self.aligned([v, old])
                v = Value(F.when(r.error, b.col).otherwise(a.col), a.type)
        elif node.op == "|=":
            old = self.load(node.target)
            v = self.handled(r)
            if old.kind == v.kind == "object":
                v = self.typed(FUNCTIONS["merge"].build(to=old, **{"from": v}))
        else:
            v = self.handled(r)
        self.store(node.target, v)
        return Result(v)

    # ---- paths ----

    def place(self, path: Path) -> dict[str, Value]:
        return self.state.fields if path.root == "." else self.state.meta if path.root == "%" else self.state.variables

    def load(self, path: Path) -> Value:
        null = Value(F.lit(None), NullType())
        if path.root in (".", "%"):
            home = self.place(path)
            if not path.steps:
                if path.root == "." and self.state.root is not None:
                    return self.state.root
                return self.typed(F.struct(*[v.col.alias(k) for k, v in home.items()])) if home else null
            v, rest = home.get(path.steps[0], null), path.steps[1:]
        else:
            if path.root not in self.state.variables:
                raise CompileError(f"there is no variable {path.root}")
            v, rest = self.state.variables[path.root], path.steps
        return self.inside(v, rest)

    def inside(self, v: Value, steps: tuple) -> Value:
        for s in steps:
            name = v.type.typeName()
            if name == "struct":
                v = Value(v.col.getField(s), v.type[s].dataType) if s in v.type.names else Value(F.lit(None), NullType())
            elif name == "map":
                v = Value(F.try_element_at(v.col, F.lit(s)), v.type.valueType)
            elif name == "array" and isinstance(s, int):
                v = Value(F.try_element_at(v.col, F.lit(s + 1 if s >= 0 else s)), v.type.elementType)
            elif name == "variant":
                step = f"[{s}]" if isinstance(s, int) else "['" + str(s).replace("'", "\\'") + "']"
                v = Value(F.try_variant_get(v.col, "$" + step, "variant"), VariantType())
            else:
                return Value(F.lit(None), NullType())
        return v

    def store(self, path: Path, v: Value) -> None:
        if path.root == "_" and not path.steps:
            return
        home = self.place(path)
        if path.root == "." and not path.steps:
            self.state.root = v
            if v.type.typeName() == "struct":
                self.state.root = None
                self.state.fields = {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type.fields}
            return
        first, rest = (path.steps[0], path.steps[1:]) if path.root in (".", "%") else (path.root, path.steps)
        home[first] = self.written(home.get(first), rest, v)

    def written(self, old: Value | None, steps: tuple, v: Value) -> Value:
        """``old`` with ``v`` under the steps; what is missing on the way is made."""
        if not steps:
            return v
        s, rest = steps[0], steps[1:]
        if isinstance(s, int):
            kind = old.type if old is not None and old.kind == "array" else None
            inner = self.written(Value(F.try_element_at(old.col, F.lit(s + 1)), kind.elementType) if kind else None, rest, v)
            if kind is None:
                return Value(F.array(*[F.lit(None).cast(inner.type)] * s, inner.col), ArrayType(inner.type))
            if kind.elementType != inner.type:
                a, b = self.aligned([Value(F.lit(None), kind.elementType), inner])
                element = lambda x: Value(x, kind.elementType)
                base = F.transform(old.col, lambda x: self.variant(element(x)) if a.type == VariantType() else x.cast(a.type))
                inner, kind = b, ArrayType(a.type)
            else:
                base = old.col
            longer = F.concat(base, F.array_repeat(F.lit(None).cast(kind.elementType), F.greatest(F.lit(0), F.lit(s) - F.size(base))), F.array(inner.col))
            return Value(F.when(F.size(base) > s, F.transform(base, lambda x, i: F.when(i == s, inner.col).otherwise(x))).otherwise(longer), kind)
        if old is None or old.kind == "null":
            return self.typed(F.struct(self.written(None, rest, v).col.alias(s)))
        if old.type.typeName() == "struct":
            inner = self.written(Value(old.col.getField(s), old.type[s].dataType) if s in old.type.names else None, rest, v)
            whole = F.struct(*[(inner.col if n == s else old.col.getField(n)).alias(n) for n in dict.fromkeys([*old.type.names, s])])
            return self.typed(whole)
        if old.type.typeName() == "map":
            new = self.aligned([v, Value(F.lit(None), old.type.valueType)])[0]
            col = new.col if new.type == old.type.valueType else v.col.cast(old.type.valueType)
            return Value(F.map_concat(F.map_filter(old.col, lambda k, _: k != s), F.create_map(F.lit(s), col)), old.type)
        if old.kind == "variant":
            top = F.from_json(F.to_json(old.col), "map<string,variant>")
            inner = self.written(Value(F.try_element_at(top, F.lit(s)), VariantType()) if rest else None, rest, v)
            made = F.map_concat(F.map_filter(top, lambda k, _: k != s), F.create_map(F.lit(s), self.variant(inner)))
            return Value(F.parse_json(F.to_json(made, {"ignoreNullFields": "false"})), VariantType())
        return self.typed(F.struct(self.written(None, rest, v).col.alias(s)))

    def removed(self, path: Path) -> Value:
        v = self.load(path)
        home = self.place(path)
        first, rest = (path.steps[0], path.steps[1:]) if path.root in (".", "%") else (path.root, path.steps)
        if not rest:
            home.pop(first, None)
        elif first in home:
            home[first] = self.without(home[first], rest)
        return v

    def without(self, old: Value, steps: tuple) -> Value:
        s, rest = steps[0], steps[1:]
        if old.type.typeName() == "struct" and s in old.type.names:
            if rest:
                inner = self.without(Value(old.col.getField(s), old.type[s].dataType), rest)
                return self.typed(F.struct(*[(inner.col if n == s else old.col.getField(n)).alias(n) for n in old.type.names]))
            names = [n for n in old.type.names if n != s]
            return self.typed(F.struct(*[old.col.getField(n).alias(n) for n in names])) if names else Value(F.lit(None), NullType())
        if old.type.typeName() == "map" and not rest:
            return Value(F.map_filter(old.col, lambda k, _: k != s), old.type)
        if old.kind == "variant" and not rest:
            top = F.map_filter(F.from_json(F.to_json(old.col), "map<string,variant>"), lambda k, _: k != s)
            return Value(F.parse_json(F.to_json(top, {"ignoreNullFields": "false"})), VariantType())
        return old

    # ---- expressions ----

    def expression(self, node) -> Result:
        if isinstance(node, Literal):
            return Result(self.literal(node))
        if isinstance(node, Path):
            return Result(self.load(node))
        if isinstance(node, Index):
            r = self.expression(node.value)
            return Result(self.inside(r.value, node.steps), r.error, r.message)
        if isinstance(node, Array):
            items = [self.expression(x) for x in node.items]
            values = self.aligned([r.value for r in items])
            kind = values[0].type if values else NullType()
            return self.joined(Value(F.array(*[v.col for v in values]), ArrayType(kind)), items)
        if isinstance(node, Object):
            items = [(k, self.expression(x)) for k, x in node.items]
            made = self.typed(F.struct(*[r.value.col.alias(k) for k, r in items])) if items else Value(F.create_map().cast("map<string,string>"), self.typed(F.create_map().cast("map<string,string>")).type)
            return self.joined(made, [r for _, r in items])
        if isinstance(node, Unary):
            r = self.expression(node.value)
            if node.op == "!":
                return Result(Value(~F.coalesce(self.plain(r.value, "boolean").col, F.lit(False)), BooleanType()), r.error, r.message)
            v = self.plain(r.value, "float")
            return Result(Value(-v.col, v.type), r.error, r.message)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Block):
            return self.block(node)
        if isinstance(node, If):
            return self.conditional(node)
        if isinstance(node, Call):
            return self.call(node)
        if isinstance(node, (Assign, Abort)):
            return self.statement(node)
        raise CompileError(f"{type(node).__name__} is no expression")

    @staticmethod
    def literal(node: Literal) -> Value:
        kinds = {"string": StringType(), "regex": StringType(), "integer": LongType(), "float": DoubleType(), "boolean": BooleanType(), "null": NullType()}
        if node.kind == "timestamp":
            return Value(F.lit(node.value).cast("timestamp"), TimestampType(), node.value, True)
        col = F.lit(node.value)
        return Value(col.cast("bigint") if node.kind == "integer" else col, kinds[node.kind], node.value, True)

    def joined(self, v: Value, parts: list[Result], error: Column | None = None, message: str = "") -> Result:
        for p in parts:
            if p.error is not None:
                error, message = (p.error, p.message) if error is None else (p.error | error, p.message or message)
        return Result(v, error, message)

    def binary(self, node: Binary) -> Result:
        op = node.op
        left = self.expression(node.left)
        if op == "??":
            right = self.expression(node.right)
            if left.error is None:
                return left
            a, b = self.aligned([left.value, right.value])
            both = None if right.error is None else left.error & right.error
            return Result(Value(F.when(left.error, b.col).otherwise(a.col), a.type), both, right.message)
        right = self.expression(node.right)
        x, y = left.value, right.value
        if op in ("&&", "||"):
            if x.kind in ("boolean", "variant") and y.kind in ("boolean", "variant", "null") or op == "&&":
                a, b = (F.coalesce(self.plain(v, "boolean").col.cast("boolean"), F.lit(False)) for v in (x, y))
                return self.joined(Value(a & b if op == "&&" else a | b, BooleanType()), [left, right])
            a, b = self.aligned([x, y])
            truth = x.col.isNotNull() & (x.col if x.kind == "boolean" else F.lit(True))
            return self.joined(Value(F.when(truth, a.col).otherwise(b.col), a.type), [left, right])
        if op in ("==", "!="):
            same = self.equal(x, y)
            return self.joined(Value(same if op == "==" else ~same, BooleanType()), [left, right])
        return self.joined(*self.arithmetic(op, x, y, [left, right]))

    def equal(self, x: Value, y: Value) -> Column:
        numbers = ("integer", "float")
        if x.kind == "variant" and y.kind != "variant":
            x = self.plain(x, "float" if y.kind in numbers else y.kind)
        elif y.kind == "variant" and x.kind != "variant":
            y = self.plain(y, "float" if x.kind in numbers else x.kind)
        if "null" in (x.kind, y.kind):
            return x.col.isNull() & y.col.isNull()
        if x.kind == "variant":
            return F.to_json(x.col).eqNullSafe(F.to_json(y.col))
        if x.kind in numbers and y.kind in numbers or x.kind == y.kind and x.kind not in ("object", "array"):
            return x.col.eqNullSafe(y.col)
        if x.kind == y.kind:
            return F.to_json(x.col).eqNullSafe(F.to_json(y.col))
        return F.lit(False)

    def arithmetic(self, op: str, x: Value, y: Value, parts: list[Result]) -> tuple:
        numbers = ("integer", "float")
        open_ = "variant" in (x.kind, y.kind) or "null" in (x.kind, y.kind)
        want = "string" if "string" in (x.kind, y.kind) else "timestamp" if "timestamp" in (x.kind, y.kind) else "float"
        x, y = self.plain(x, want), self.plain(y, want)
        a, b = x.col, y.col
        missing = a.isNull() | b.isNull() if open_ else None
        if op in ("<", "<=", ">", ">="):
            if not open_ and not (x.kind in numbers and y.kind in numbers or x.kind == y.kind and x.kind in ("timestamp", "string")):
                raise CompileError(f"{x.kind} and {y.kind} have no order")
            if x.kind == "timestamp":
                a, b = a.cast("timestamp"), b.cast("timestamp")
            test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            return Value(test, BooleanType()), parts, missing, f"{op} of values without order"
        if op == "+" and want == "string":
            if not {x.kind, y.kind} <= {"string", "null"}:
                raise CompileError(f"{x.kind} and {y.kind} cannot be added")
            return Value(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), StringType()), parts, None, ""
        if op == "*" and {x.kind, y.kind} == {"string", "integer"}:
            s, n = (a, b) if x.kind == "string" else (b, a)
            return Value(F.repeat(s, F.greatest(F.lit(0), n).cast("int")), StringType()), parts, None, ""
        if not open_ and not (x.kind in numbers and y.kind in numbers):
            raise CompileError(f"{op} of {x.kind} and {y.kind} has no meaning")
        kind = DoubleType() if "float" in (x.kind, y.kind) or op == "/" else LongType()
        if op in ("/", "//", "%"):
            zero = b == 0
            bad = zero if missing is None else zero | missing
            if y.constant and y.literal and missing is None:
                bad = None
            col = {"/": F.try_divide(a.cast("double"), b.cast("double")), "//": F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("bigint"), "%": F.try_mod(a, b)}[op]
            return Value(col, LongType() if op == "//" else kind), parts, None if bad is None else F.coalesce(bad, F.lit(False)), f"{op} by zero"
        col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
        return Value(col.cast(kind), kind), parts, missing, f"{op} of values that are no numbers"

    def conditional(self, node: If) -> Result:
        """Every branch runs on a copy; what they leave differently becomes a CASE."""
        before, guard = self.state, self.guard
        tests, states, values, rest = [], [], [], guard
        # a branch may handle its own errors only where it runs
        for cond, body in node.tests:
            self.state = before
            c = F.coalesce(self.plain(self.handled(self.expression(cond)), "boolean").col, F.lit(False))
            tests.append(c)
            self.state = before.copy()
            self.guard = c if rest is None else rest & c
            values.append(self.block(body))
            states.append(self.state)
            rest = ~c if rest is None else rest & ~c
        self.state, self.guard = before.copy(), rest
        values.append(self.block(node.otherwise) if node.otherwise is not None else Result(Value(F.lit(None), NullType())))
        states.append(self.state)
        self.guard = guard
        self.state = State(*[self.choose(tests, [getattr(s, part) for s in states]) for part in ("fields", "variables", "meta")], root=next((s.root for s in states if s.root is not None), None))
        found = self.aligned([r.value for r in values])
        error, message = None, ""
        for r in values:
            if r.error is not None:
                message = message or r.message
        if message:
            error = F.lit(False) if values[-1].error is None else values[-1].error
            for c, r in reversed(list(zip(tests, values))):
                error = F.when(c, F.lit(False) if r.error is None else r.error).otherwise(error)
        return Result(self.case(tests, found), error, message)

    @staticmethod
    def case(tests: list[Column], values: list[Value]) -> Value:
        out = values[-1].col
        for c, v in reversed(list(zip(tests, values))):
            out = F.when(c, v.col).otherwise(out)
        return Value(out, values[0].type)

    def choose(self, tests: list[Column], homes: list[dict[str, Value]]) -> dict[str, Value]:
        out = {}
        for name in dict.fromkeys(n for h in homes for n in h):
            own = [h.get(name) for h in homes]
            if all(v is own[0] for v in own):
                out[name] = own[0]
            else:
                out[name] = self.case(tests, self.aligned([v or Value(F.lit(None), NullType()) for v in own]))
        return out

    # ---- calls ----

    def call(self, node: Call) -> Result:
        own = getattr(self, f"call_{node.name}", None)
        out = own(node) if own else self.registered(node)
        return Result(self.raised(out)) if node.bang else out

    def registered(self, node: Call) -> Result:
        f = FUNCTIONS.get(node.name)
        if f is None:
            raise CompileError(f"there is no function {node.name}")
        try:
            given = bind(f, list(node.args), dict(node.named))
        except ValueError as e:
            raise CompileError(str(e)) from e
        args, parts = {}, []
        error, message = None, f"{node.name} failed"
        for k, default in f.params.items():
            if k in f.literal:
                args[k] = literal_of(given[k]) if k in given else default
            elif k not in given:
                args[k] = default
            else:
                r = self.expression(given[k])
                parts.append(r)
                v = r.value
                if v.kind == "variant" and not f.typed:
                    # an open value must have the kind that the function takes
                    want = "float" if f.build.__module__.endswith(".number") else "timestamp" if node.name in ("format_timestamp", "to_unix_timestamp") else "string"
                    v = self.plain(v, want)
                    error = v.col.isNull() if error is None else error | v.col.isNull()
                args[k] = v if f.typed else v.col
        try:
            col = f.build(**args)
        except (KeyError, ValueError) as e:
            raise CompileError(f"{node.name}: {e}") from e
        out = self.typed(col)
        # an object is used for its error and for each of its fields
        if self.pinning and f.fallible and out.kind in ("object", "array", "variant") and self.guard is None and self._depth == 0 and self._replay is None:
            out = self.pinned(out)
        # every plain value has a text
        sure = node.name == "to_string" and args["value"].kind not in ("array", "object", "variant")
        if f.fallible and not sure:
            error = out.col.isNull() if error is None else error | out.col.isNull()
        if node.name in ("assert", "assert_eq"):
            message = args.get("message") or message
        return self.joined(out, parts, error, message)

    def call_del(self, node: Call) -> Result:
        if not isinstance(node.args[0], Path):
            raise CompileError("del takes a path")
        return Result(self.removed(node.args[0]))

    def call_exists(self, node: Call) -> Result:
        path = node.args[0]
        if isinstance(path, Index):
            v = self.inside(self.expression(path.value).value, path.steps)
        else:
            v = self.load(path)
        return Result(Value(v.col.isNotNull() if v.kind != "null" else F.lit(False), BooleanType()))

    def _closure(self, node: Call, kinds: list[DataType]):
        """A function of columns from a closure; its body is compiled once to learn the types, and again for each use."""
        names, body = node.closure
        saved = self.state, self._log, self._replay

        def run(cols: list[Column]) -> Result:
            self.state = saved[0].copy()
            self._depth += 1
            for n, c, k in zip(names, cols, kinds):
                self.state.variables[n] = Value(c, k)
            try:
                return self.block(body)
            finally:
                self._depth -= 1
                self.state = saved[0]

        if self._replay is None:
            outer = self._log
            self._log = []
            probe = run([F.lit(None).cast(k) for k in kinds])
            learnt, self._log = self._log, outer
            if outer is not None:
                outer.extend(learnt)
        else:
            learnt = None
            mark = list(self._replay)
            probe = run([F.lit(None).cast(k) for k in kinds])
            learnt = mark[: len(mark) - len(self._replay)]

        def build(*cols: Column) -> Column:
            held = self._replay
            self._replay = list(learnt)
            try:
                return run(list(cols)).value.col
            finally:
                self._replay = held

        return build, probe.value.type

    def _collection(self, node: Call) -> tuple[Value, Result]:
        r = self.expression(dict(node.named).get("value", node.args[0] if node.args else None))
        v = r.value
        if v.kind == "variant":
            v = Value(F.from_json(F.to_json(v.col), "map<string,variant>"), self.typed(F.from_json(F.to_json(v.col), "map<string,variant>")).type)
        if v.type.typeName() not in ("array", "map"):
            raise CompileError(f"{node.name} takes an array or a map, not {v.type.simpleString()}")
        return v, r

    def call_filter(self, node: Call) -> Result:
        v, r = self._collection(node)
        if v.kind == "array":
            build, _ = self._closure(node, [LongType(), v.type.elementType])
            return self.joined(Value(F.filter(v.col, lambda x, i: F.coalesce(build(i.cast("bigint"), x), F.lit(False))), v.type), [r])
        build, _ = self._closure(node, [StringType(), v.type.valueType])
        return self.joined(Value(F.map_filter(v.col, lambda k, x: F.coalesce(build(k, x), F.lit(False))), v.type), [r])

    def call_map_values(self, node: Call) -> Result:
        v, r = self._collection(node)
        build, kind = self._closure(node, [v.type.elementType if v.kind == "array" else v.type.valueType])
        made = F.transform(v.col, lambda x: build(x)) if v.kind == "array" else F.transform_values(v.col, lambda _, x: build(x))
        return self.joined(self.typed(made), [r])

    def call_map_keys(self, node: Call) -> Result:
        v, r = self._collection(node)
        build, _ = self._closure(node, [StringType()])
        return self.joined(self.typed(F.transform_keys(v.col, lambda k, _: build(k))), [r])

    def call_replace_with(self, node: Call) -> Result:
        """Every match of a pattern replaced by what a closure makes of it (an object with ``string`` and ``captures``)."""
        text = self.expression(node.args[0])
        rx = literal_of(node.args[1])
        match = self.typed(F.struct(F.lit("").alias("string"), F.array(F.lit("")).alias("captures"))).type
        build, _ = self._closure(node, [match])
        pattern = F.lit(rx.pattern)
        col = self.plain(text.value, "string").col
        gaps, hits = F.split(col, pattern, -1), F.regexp_extract_all(col, pattern, F.lit(0))
        groups = [F.regexp_extract_all(col, pattern, F.lit(i)) for i in range(1, rx.groups + 1)]
        made = F.transform(hits, lambda h, i: build(F.struct(h.alias("string"), F.array(*[F.get(g, i) for g in groups]).cast("array<string>").alias("captures"))))
        return self.joined(Value(F.array_join(F.zip_with(gaps, made, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""), StringType()), [text])

    def call_unnest(self, node: Call) -> Result:
        """An array of the event, once for each item of the array under a path; assigned to the root it becomes rows."""
        path = node.args[0]
        items = self.load(path)
        if items.kind != "array":
            raise CompileError("unnest takes the path of an array")
        saved = self.state
        whole = [(k, v) for k, v in saved.fields.items()]
        name = path.steps[0]
        if len(path.steps) > 1:
            raise CompileError("unnest takes a field of the event")
        made = F.transform(items.col, lambda x: F.struct(*[(x if k == name else v.col).alias(k) for k, v in whole]))
        return Result(self.typed(made))

    def call_set_secret(self, node: Call) -> Result:
        key, v = literal_of(node.args[0]), self.expression(node.args[1]).value
        self.state.meta[f"secret:{key}"] = v
        return Result(Value(F.lit(None), NullType()))

    def call_get_secret(self, node: Call) -> Result:
        return Result(self.state.meta.get(f"secret:{literal_of(node.args[0])}", Value(F.lit(None), NullType())))

    def call_remove_secret(self, node: Call) -> Result:
        self.state.meta.pop(f"secret:{literal_of(node.args[0])}", None)
        return Result(Value(F.lit(None), NullType()))

    def call_set_semantic_meaning(self, node: Call) -> Result:
        path, meaning = node.args[0], literal_of(node.args[1])
        self.meanings = {**getattr(self, "meanings", {}), meaning: path.steps[0]}
        return Result(Value(F.lit(None), NullType()))

    def _lookup(self, node: Call, single: bool) -> Result:
        """A lookup is a join: it is added to the DataFrame under the program, and its column is the value."""
        from ..operators.enrich import Between, find_records

        names = ("table", "condition", "select", "case_sensitive", "wildcard")
        given = dict(zip(names, node.args)) | dict(node.named)
        name = literal_of(given["table"])
        if name not in self.tables:
            raise CompileError(f"there is no table {name}")
        if not isinstance(given["condition"], Object):
            raise CompileError("the condition of a lookup is an object")
        where = {}
        for k, x in given["condition"].items:
            if isinstance(x, Object) and {n for n, _ in x.items} <= {"from", "to"} and x.items:
                ends = {n: self.expression(e).value.col for n, e in x.items}
                where[k] = Between(ends.get("from"), ends.get("to"))
            else:
                where[k] = self.expression(x).value.col
        column = f"_lookup_{len(self.df.columns)}"
        options = {k: literal_of(given[k]) for k in ("select", "case_sensitive", "wildcard") if k in given}
        try:
            self.df = find_records(self.df, self.tables[name], where, column, **options)
        except ValueError as e:
            raise CompileError(str(e)) from e
        found = Value(F.col(column), self.df.schema[column].dataType)
        if not single:
            return Result(found)
        return Result(Value(F.get(found.col, 0), found.type.elementType), F.size(found.col) != 1, "the lookup did not find one row")

    def call_get_enrichment_table_record(self, node: Call) -> Result:
        return self._lookup(node, True)

    def call_find_enrichment_table_records(self, node: Call) -> Result:
        return self._lookup(node, False)


def remap(df: DataFrame, source: str, drop_on_error: bool = False, drop_on_abort: bool = True, reroute_dropped: bool = False, tables: dict[str, DataFrame] | None = None, lenient: bool = False):
    """``df`` through a program. Rows that fail or abort come out as they went in, or are dropped.

    With ``reroute_dropped`` the result is a pair: what passes, and what was dropped with its reason in ``dropped_reason``. An
    array assigned to the root gives a row for each item; a scalar becomes ``message``.
    """
    p = Program(df, source, tables, lenient)
    error = F.lit(None).cast("string") if p.error is None else p.error
    abort = F.lit(None).cast("string") if p.aborted is None else p.aborted
    failed, stopped = error.isNotNull(), abort.isNotNull()
    root = p.state.root
    names = list(p.state.fields)
    if root is not None:
        if root.kind == "array" and root.type.elementType.typeName() == "struct":
            out = p.df.select(F.explode(root.col).alias("_e")).select("_e.*")
            return (out, df.limit(0)) if reroute_dropped else out
        p.state.fields, names = {"message": root}, ["message"]
    made = {n: v for n, v in p.state.fields.items() if v.kind != "null" or n in df.columns}
    if p.error is None and p.aborted is None:
        out = p.df.select(*[v.col.alias(n) for n, v in made.items()])
        return (out, df.limit(0).withColumn("dropped_reason", F.lit(None).cast("string"))) if reroute_dropped else out
    kept = F.lit(True)
    if drop_on_error:
        kept = kept & ~failed
    if drop_on_abort:
        kept = kept & ~stopped
    # rows that stay without being changed have their own fields, and none of the new
    bad = failed | stopped
    cols = []
    for n in dict.fromkeys([*made, *df.columns]):
        old = Value(F.col(f"`{n}`"), df.schema[n].dataType) if n in df.columns else Value(F.lit(None), NullType())
        if (drop_on_error or p.error is None) and (drop_on_abort or p.aborted is None):
            if n in made:
                cols.append(made[n].col.alias(n))
            continue
        a, b = p.aligned([made.get(n, Value(F.lit(None), NullType())), old])
        cols.append(F.when(bad, b.col).otherwise(a.col).alias(n))
    marked = p.df.withColumn("_kept", kept).withColumn("_reason", F.coalesce(error, abort))
    out = marked.filter("_kept").select(*cols)
    if not reroute_dropped:
        return out
    return out, marked.filter("not _kept").select(*df.columns, F.col("_reason").alias("dropped_reason"))


