"""Programs as DataFrame columns: what a program means over a column of known type, for Catalyst.

`compile_column` gives a Column where built-in functions can say what the program says, and raises
Unsupported elsewhere; `query` then runs the evaluator in tasks instead. Where the evaluator would
raise for a null (a string function's input, say), a column gives null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import jq
from treeloom.functions.jq_syntax import parse
from treeloom.values import is_number, parse_json, to_json


class Unsupported(Exception):
    pass


@dataclass
class Out:
    """One output, or with many an array of outputs in order."""

    column: Column
    type: T.DataType
    many: bool = False


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_RANK = {T.NullType: 0, T.BooleanType: 1, T.StringType: 4, T.ArrayType: 5, T.StructType: 6, T.MapType: 6}


def _number(t: T.DataType) -> bool:
    return isinstance(t, _NUMERIC)


def _whole(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _rank(t: T.DataType) -> int:
    return 3 if _number(t) else next((r for k, r in _RANK.items() if isinstance(t, k)), 9)


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if _number(a) and _number(b):
        return T.LongType() if _whole(a) and _whole(b) else T.DoubleType()
    raise Unsupported(f"{a.simpleString()} beside {b.simpleString()}")


def truth(o: Out) -> Column:
    """Everything but null and false."""
    return F.coalesce(o.column, F.lit(False)) if isinstance(o.type, T.BooleanType) else o.column.isNotNull()


def _compare(op: str, a: Out, b: Out) -> Column:
    """In the language's order: null comes first, kinds before kinds, NaN before other numbers."""
    if op in (">", ">="):
        return _compare({">": "<", ">=": "<="}[op], b, a)
    if op == "!=":
        return ~_compare("==", a, b)
    null = isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType)
    if null or _rank(a.type) != _rank(b.type):
        low = F.lit(False if null else _rank(a.type) < _rank(b.type))
        both = a.column.isNull() & b.column.isNull()
        if op == "==":
            return both
        before = F.when(b.column.isNull(), F.lit(False)).when(a.column.isNull(), F.lit(True)).otherwise(low)
        return before | both if op == "<=" else before
    x, y = a.column, b.column
    if op == "==":
        same = x.eqNullSafe(y)
        return same & ~F.coalesce(F.isnan(x), F.lit(False)) if isinstance(a.type, (T.DoubleType, T.FloatType)) else same
    strict = F.when(y.isNull(), False).when(x.isNull(), True)
    for side, value in ((a, True), (b, False)):
        if isinstance(side.type, (T.DoubleType, T.FloatType)):
            strict = strict.when(F.isnan(side.column), value)
    strict = strict.otherwise(x < y)
    return strict | x.eqNullSafe(y) if op == "<=" else strict


def _plus(a: Out, b: Out) -> Out:
    t = _common(a.type, b.type)
    if _number(t):
        total = a.column + b.column
    elif isinstance(t, T.StringType):
        total = F.concat(a.column, b.column)
    elif isinstance(t, T.ArrayType):
        total = F.concat(a.column, b.column)
    else:
        raise Unsupported("+")
    return Out(F.coalesce(total, a.column, b.column), t)


def _arithmetic(op: str, a: Out, b: Out) -> Out:
    if op == "+":
        return _plus(a, b)
    if op == "-" and isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType):
        return Out(F.filter(a.column, lambda x: ~F.exists(b.column, lambda y: y.eqNullSafe(x))), a.type)
    if not (_number(a.type) and _number(b.type)):
        if op == "/" and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
            return Out(_split(a.column, b.column), T.ArrayType(T.StringType()))
        raise Unsupported(op)
    t = _common(a.type, b.type)
    x, y = a.column, b.column
    if op == "/":
        return Out(x.cast("double") / F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(y), T.DoubleType())
    if op == "%":
        whole = y.cast("long")
        return Out(x.cast("long") % F.abs(F.when(whole == 0, F.raise_error(F.lit("remainder by zero"))).otherwise(whole)), T.LongType())
    return Out(x - y if op == "-" else x * y, t)


def _split(s: Column, by: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), by, F.lit("\\E"))
    return F.when(s == "", F.array().cast("array<string>")).when(by == "", F.filter(F.split(s, F.lit("")), lambda c: c != "")).otherwise(F.split(s, quoted, F.lit(-1)))


def _text(o: Out) -> Column:
    """tostring."""
    if isinstance(o.type, T.StringType):
        return F.coalesce(o.column, F.lit("null"))
    if _number(o.type):
        if _whole(o.type):
            plain = o.column.cast("string")
        else:
            d = o.column.cast("double")
            plain = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(F.regexp_replace(F.to_json(F.struct(d.alias("v"))), r'^\{"v":|\}$', ""))
        return F.coalesce(plain, F.lit("null"))
    if isinstance(o.type, T.BooleanType):
        return F.coalesce(o.column.cast("string"), F.lit("null"))
    raise Unsupported("tostring of " + o.type.simpleString())


def _let(value: Column, f) -> Column:
    """f(value), the value being computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sort_key(o: Out) -> Column:
    return F.struct(o.column.isNotNull().alias("present"), o.column.alias("key"))


class Compiler:
    def __init__(self) -> None:
        self.depth = 0

    def each(self, o: Out, f) -> Out:
        """f over all outputs of o."""
        if not o.many:
            return f(Out(o.column, o.type))
        kind: list[Out] = []

        def inner(x: Column) -> Column:
            kind[:] = [f(Out(x, o.type))]
            return kind[0].column

        found = F.transform(o.column, inner)
        return Out(F.flatten(found), kind[0].type, True) if kind[0].many else Out(found, kind[0].type, True)

    def listed(self, o: Out) -> Column:
        return o.column if o.many else F.array(o.column)

    def one(self, o: Out) -> Out:
        if o.many:
            raise Unsupported("several outputs here")
        return o

    def run(self, t: tuple, v: Out, env: dict) -> Out:
        self.depth += 1
        try:
            if self.depth > 60:
                raise Unsupported("too deep")
            f = getattr(self, f"do_{t[0]}", None)
            if f is None:
                raise Unsupported(t[0])
            return f(t, v, env)
        finally:
            self.depth -= 1

    def do_here(self, t, v, env):
        return v

    def do_const(self, t, v, env):
        x = t[1]
        if x is None:
            return Out(F.lit(None), T.NullType())
        kind = T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) and abs(x) < 1 << 63 else T.DoubleType() if is_number(x) and isinstance(x, float) else T.StringType() if isinstance(x, str) else None
        if kind is None:
            raise Unsupported("constant")
        return Out(F.lit(x), kind)

    def do_var(self, t, v, env):
        if ("$", t[1]) not in env:
            raise Unsupported(f"${t[1]}")
        return env["$", t[1]]

    def do_index(self, t, v, env):
        key = self.one(self.run(t[2], v, env))

        def get(x: Out) -> Out:
            if isinstance(x.type, T.NullType):
                return x
            if t[2][0] == "const" and isinstance(t[2][1], str):
                if isinstance(x.type, T.StructType):
                    if t[2][1] not in x.type.names:
                        return Out(F.lit(None), T.NullType())
                    return Out(x.column[t[2][1]], x.type[t[2][1]].dataType)
                if isinstance(x.type, T.MapType):
                    return Out(F.try_element_at(x.column, F.lit(t[2][1])), x.type.valueType)
            if isinstance(x.type, T.ArrayType) and _number(key.type):
                i = F.when(key.column < 0, F.ceil(key.column)).otherwise(F.floor(key.column)).cast("int")
                return Out(_let(x.column, lambda a: F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i))), x.type.elementType)
            raise Unsupported("index")

        return self.each(self.run(t[1], v, env), get)

    def do_slice(self, t, v, env):
        a, b = (self.one(self.run(p, v, env)).column if p else None for p in t[2:4])

        def cut(x: Out) -> Out:
            text = isinstance(x.type, T.StringType)
            if not text and not isinstance(x.type, T.ArrayType):
                raise Unsupported("slice")
            n = F.length(x.column) if text else F.size(x.column)
            edge = lambda e, default, up: default if e is None else F.greatest(F.lit(0), F.least(n, (F.when(e < 0, n + (F.ceil(e) if up else F.floor(e))).otherwise(F.ceil(e) if up else F.floor(e))).cast("int")))
            start, end = edge(a, F.lit(0), False), edge(b, n, True)
            size = F.greatest(F.lit(0), end - start)
            return Out(F.substring(x.column, start + 1, size) if text else F.slice(x.column, start + 1, size), x.type)

        return self.each(self.run(t[1], v, env), cut)

    def do_iterate(self, t, v, env):
        def items(x: Out) -> Out:
            if isinstance(x.type, T.ArrayType):
                return Out(x.column, x.type.elementType, True)
            if isinstance(x.type, T.MapType):
                return Out(F.map_values(x.column), x.type.valueType, True)
            raise Unsupported("iterate")

        return self.each(self.run(t[1], v, env), items)

    def do_pipe(self, t, v, env):
        return self.each(self.run(t[1], v, env), lambda x: self.run(t[2], x, env))

    def do_comma(self, t, v, env):
        a, b = self.run(t[1], v, env), self.run(t[2], v, env)
        kind = _common(a.type, b.type)
        return Out(F.concat(*(self.listed(x).cast(T.ArrayType(kind)) for x in (a, b))), kind, True)

    def do_array(self, t, v, env):
        found = self.run(t[1], v, env)
        return Out(self.listed(found), T.ArrayType(found.type))

    def do_object(self, t, v, env):
        fields = []
        for k, x in t[1]:
            if k[0] != "const":
                raise Unsupported("computed key")
            o = self.one(self.run(x, v, env))
            fields.append((k[1], o))
        return Out(F.struct(*(o.column.alias(k) for k, o in fields)), T.StructType([T.StructField(k, o.type) for k, o in fields]))

    def do_if(self, t, v, env):
        test = truth(self.one(self.run(t[1], v, env)))
        a, b = self.run(t[2], v, env), self.run(t[3], v, env)
        kind = _common(a.type, b.type)
        if a.many or b.many:
            return Out(F.when(test, self.listed(a)).otherwise(self.listed(b)), kind, True)
        return Out(F.when(test, a.column.cast(kind) if kind != a.type else a.column).otherwise(b.column.cast(kind) if kind != b.type else b.column), kind)

    def do_alt(self, t, v, env):
        a, b = self.run(t[1], v, env), self.one(self.run(t[2], v, env))
        kind = _common(a.type, b.type)
        if a.many:
            good = F.filter(a.column, lambda x: truth(Out(x, a.type)))
            return Out(F.when(F.size(good) > 0, good).otherwise(F.array(b.column.cast(kind))), kind, True)
        return Out(F.when(truth(a), a.column).otherwise(b.column), kind)

    def do_and(self, t, v, env):
        return Out(truth(self.one(self.run(t[1], v, env))) & truth(self.one(self.run(t[2], v, env))), T.BooleanType())

    def do_or(self, t, v, env):
        return Out(truth(self.one(self.run(t[1], v, env))) | truth(self.one(self.run(t[2], v, env))), T.BooleanType())

    def do_binary(self, t, v, env):
        b = self.run(t[3], v, env)
        a = self.run(t[2], v, env)
        work = (lambda x, y: Out(_compare(t[1], x, y), T.BooleanType())) if t[1] in ("==", "!=", "<", "<=", ">", ">=") else (lambda x, y: _arithmetic(t[1], x, y))
        return self.each(b, lambda y: self.each(a, lambda x: work(x, y)))

    def do_negate(self, t, v, env):
        o = self.one(self.run(t[1], v, env))
        return Out(-o.column, o.type)

    def do_format(self, t, v, env):
        forms = {None: _text, "@text": _text, "@base64": lambda o: F.base64(_text(o).cast("binary")), "@uri": lambda o: F.replace(F.replace(F.replace(F.url_encode(_text(o)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), "@html": lambda o: _replaced(_text(o), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")))}
        form = forms.get(t[1])
        if t[1] == "@csv" and t[2] is None and isinstance(v.type, T.ArrayType):
            inner = v.type.elementType
            cell = (lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))) if isinstance(inner, T.StringType) else (lambda x: _text(Out(x, inner)))
            return Out(F.array_join(F.transform(v.column, lambda x: F.when(x.isNull(), "").otherwise(cell(x))), ","), T.StringType())
        if form is None:
            raise Unsupported(str(t[1]))
        if t[2] is None:
            return Out(form(v), T.StringType())
        return Out(F.concat(*(F.lit(p) if isinstance(p, str) else form(self.one(self.run(p, v, env))) for p in t[2])), T.StringType())

    def do_as(self, t, v, env):
        if len(t[2]) != 1 or t[2][0][0] != "$":
            raise Unsupported("pattern")
        return self.each(self.run(t[1], v, env), lambda x: self.run(t[3], v, {**env, ("$", t[2][0][1]): x}))

    def do_def(self, t, v, env):
        name, params, body = t[1]
        return self.run(t[2], v, {**env, (name, len(params)): (params, body, env)})

    def do_reduce(self, t, v, env):
        source = self.run(t[1], v, env)
        start = self.one(self.run(t[3], v, env))
        if t[2][0] != "$" or isinstance(start.type, T.NullType):
            raise Unsupported("reduce")
        kind = T.DoubleType() if _number(start.type) and not _whole(source.type) else start.type
        step = lambda acc, x: self.one(self.run(t[4], Out(acc, kind), {**env, ("$", t[2][1]): Out(x, source.type)})).column.cast(kind)
        return Out(F.aggregate(self.listed(source), start.column.cast(kind), step), kind)

    def do_call(self, t, v, env):
        name, args = t[1], t[2]
        if (name, len(args)) in env:
            params, body, home = env[name, len(args)]
            inner = dict(home)
            for p, a in zip(params, args, strict=True):
                if p[0] == "$":
                    inner["$", p[1:]] = self.one(self.run(a, v, env))
                else:
                    inner[p, 0] = ([], a, env)
            return self.run(body, v, inner)
        f = getattr(self, f"call_{name}", None)
        if f is not None:
            return f(v, args, env)
        if not args and name in _SIMPLE:
            check, make, kind = _SIMPLE[name]
            if not check(v.type):
                raise Unsupported(f"{name} of {v.type.simpleString()}")
            return Out(make(v.column), kind(v.type) if callable(kind) else kind)
        raise Unsupported(f"{name}/{len(args)}")

    # Functions

    def argument(self, v, args, env, n=0):
        return self.one(self.run(args[n], v, env))

    def elements(self, v: Out) -> Out:
        if not isinstance(v.type, T.ArrayType):
            raise Unsupported("an array is needed")
        return Out(v.column, v.type.elementType, True)

    def call_select(self, v, args, env):
        test = truth(self.argument(v, args, env))
        return Out(F.when(test, F.array(v.column)).otherwise(F.array().cast(T.ArrayType(v.type))), v.type, True)

    def call_map(self, v, args, env):
        items = self.elements(v)
        if args[0][0] == "call" and args[0][1] == "select":  # a filter, without arrays of one
            return Out(F.filter(v.column, lambda x: truth(self.argument(Out(x, items.type), args[0][2], env))), v.type)
        found = self.each(items, lambda x: self.run(args[0], x, env))
        return Out(found.column, T.ArrayType(found.type))

    def call_empty(self, v, args, env):
        return Out(F.array().cast("array<void>"), T.NullType(), True)

    def call_not(self, v, args, env):
        return Out(~truth(v), T.BooleanType())

    def call_length(self, v, args, env):
        if isinstance(v.type, T.StringType):
            return Out(F.coalesce(F.length(v.column), F.lit(0)).cast("long"), T.LongType())
        if isinstance(v.type, (T.ArrayType, T.MapType)):
            return Out(F.coalesce(F.size(v.column), F.lit(0)).cast("long"), T.LongType())
        if isinstance(v.type, T.StructType):
            return Out(F.lit(len(v.type.names)).cast("long"), T.LongType())
        if _number(v.type):
            return Out(F.coalesce(F.abs(v.column), F.lit(0)), v.type)
        raise Unsupported("length")

    def call_keys(self, v, args, env):
        if isinstance(v.type, T.StructType):
            return Out(F.array(*map(F.lit, sorted(v.type.names))), T.ArrayType(T.StringType()))
        if isinstance(v.type, T.MapType):
            return Out(F.array_sort(F.map_keys(v.column)), T.ArrayType(v.type.keyType))
        raise Unsupported("keys")

    def call_has(self, v, args, env):
        key = self.argument(v, args, env)
        if isinstance(v.type, T.MapType):
            return Out(F.map_contains_key(v.column, key.column), T.BooleanType())
        if isinstance(v.type, T.ArrayType) and _number(key.type):
            return Out((key.column >= 0) & (key.column < F.size(v.column)), T.BooleanType())
        if isinstance(v.type, T.StructType) and args[0][0] == "const":
            return Out(F.lit(args[0][1] in v.type.names), T.BooleanType())
        raise Unsupported("has")

    def call_to_entries(self, v, args, env):
        if isinstance(v.type, T.MapType):
            return Out(F.map_entries(v.column), T.ArrayType(T.StructType([T.StructField("key", v.type.keyType), T.StructField("value", v.type.valueType)])))
        if isinstance(v.type, T.StructType):
            kind = v.type.fields[0].dataType
            for f in v.type.fields:
                kind = _common(kind, f.dataType)
            return Out(F.array(*(F.struct(F.lit(n).alias("key"), v.column[n].cast(kind).alias("value")) for n in v.type.names)), T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kind)])))
        raise Unsupported("to_entries")

    def call_add(self, v, args, env):
        items = self.run(args[0], v, env) if args else self.elements(v)
        column = self.listed(items)
        if _number(items.type):
            kind = T.LongType() if _whole(items.type) else T.DoubleType()
            total = F.aggregate(column, F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x, F.lit(0)).cast(kind))
            return Out(F.when(F.size(column) > 0, total), kind)
        if isinstance(items.type, T.StringType):
            return Out(F.when(F.size(column) > 0, F.array_join(column, "")), items.type)
        if isinstance(items.type, T.ArrayType):
            return Out(F.when(F.size(column) > 0, F.flatten(column)), items.type)
        raise Unsupported("add")

    def call_any(self, v, args, env):
        return self._quantified(v, args, env, F.exists)

    def call_all(self, v, args, env):
        return self._quantified(v, args, env, F.forall)

    def _quantified(self, v, args, env, f):
        items = self.run(args[0], v, env) if len(args) == 2 else self.elements(v)
        test = (lambda x: truth(self.argument(Out(x, items.type), args[-1:], env))) if args else (lambda x: truth(Out(x, items.type)))
        return Out(f(self.listed(items), test), T.BooleanType())

    def call_flatten(self, v, args, env):
        out = v
        times = args[0][1] if args else 9
        while isinstance(out.type, T.ArrayType) and isinstance(out.type.elementType, T.ArrayType) and times:
            out, times = Out(F.flatten(out.column), out.type.elementType), times - 1
        return out

    def call_range(self, v, args, env):
        xs = [self.argument(v, args, env, n).column.cast("long") for n in range(len(args))]
        a, b, s = (F.lit(0), xs[0], F.lit(1)) if len(xs) == 1 else (*xs, F.lit(1))[:3]
        a, b, s = (x.cast("long") for x in (a, b, s))
        some = ((s > 0) & (a < b)) | ((s < 0) & (a > b))
        return Out(F.when(some, F.filter(F.sequence(a, b, s), lambda x: x != b)).otherwise(F.array().cast("array<bigint>")), T.LongType(), True)

    def call_first(self, v, args, env):
        items = self.run(args[0], v, env) if args else self.elements(v)
        return Out(F.get(self.listed(items), F.lit(0)), items.type)

    def call_last(self, v, args, env):
        items = self.run(args[0], v, env) if args else self.elements(v)
        return Out(_let(self.listed(items), lambda a: F.get(a, F.size(a) - 1)), items.type)

    def call_limit(self, v, args, env):
        n, found = self.argument(v, args, env), self.run(args[1], v, env)
        return Out(F.slice(self.listed(found), 1, F.greatest(F.lit(0), n.column.cast("int"))), found.type, True)

    def call_sort(self, v, args, env):
        return self._sorted(v, lambda x: Out(x, v.type.elementType))

    def call_sort_by(self, v, args, env):
        return self._sorted(v, lambda x: self.argument(Out(x, v.type.elementType), args, env))

    def _sorted(self, v, key):
        self.elements(v)
        packed = F.transform(v.column, lambda x, i: F.struct(_sort_key(key(x)).alias("k"), i.alias("i"), x.alias("x")))
        return Out(F.transform(F.array_sort(packed), lambda s: s["x"]), v.type)

    def call_min_by(self, v, args, env):
        return self._edge(self.call_sort_by(v, args, env), 0)

    def call_max_by(self, v, args, env):
        return self._edge(self.call_sort_by(v, args, env), -1)

    def call_min(self, v, args, env):
        return self._edge(self.call_sort(v, args, env), 0)

    def call_max(self, v, args, env):
        return self._edge(self.call_sort(v, args, env), -1)

    def _edge(self, o, at):
        return Out(F.get(o.column, F.lit(0)) if at == 0 else _let(o.column, lambda a: F.get(a, F.size(a) - 1)), o.type.elementType)

    def call_unique(self, v, args, env):
        return self.call_sort(Out(F.array_distinct(v.column), v.type), [], env)

    def call_unique_by(self, v, args, env):
        out = self.call_sort_by(v, args, env)
        return Out(_let(out.column, lambda a: self._heads(a, v, args, env)), v.type)

    def _key(self, x, v, args, env):
        return self.argument(Out(x, v.type.elementType), args, env).column

    def _heads(self, a: Column, v, args, env) -> Column:
        """Of a sorted array the first item of each key."""
        return F.filter(a, lambda x, i: (i == 0) | ~self._key(x, v, args, env).eqNullSafe(self._key(F.get(a, i - 1), v, args, env)))

    def call_group_by(self, v, args, env):
        out = self.call_sort_by(v, args, env)
        groups = lambda a: F.transform(self._heads(a, v, args, env), lambda h: _let(self._key(h, v, args, env), lambda k: F.filter(a, lambda x: self._key(x, v, args, env).eqNullSafe(k))))
        return Out(_let(out.column, groups), T.ArrayType(v.type))

    def call_reverse(self, v, args, env):
        return Out(F.reverse(v.column), v.type)

    def call_join(self, v, args, env):
        inner = self.elements(v).type
        cells = F.transform(v.column, lambda x: F.when(x.isNull(), "").otherwise(_text(Out(x, inner))))
        return Out(F.array_join(cells, args[0][1]), T.StringType())

    def call_split(self, v, args, env):
        return Out(_split(v.column, self.argument(v, args, env).column), T.ArrayType(T.StringType()))

    def call_test(self, v, args, env):
        return Out(F.coalesce(v.column.rlike(self._regex(args)), F.lit(False)), T.BooleanType())

    def call_sub(self, v, args, env):
        if args[1][0] != "const":
            raise Unsupported("sub with captures")
        once = "g" not in (args[2][1] if len(args) > 2 else "")
        pattern, new = self._regex([args[0], *args[2:]]), re.sub(r"([\\$])", r"\\\1", args[1][1])
        return Out(F.regexp_replace(v.column, f"(?s)^(.*?)(?:{pattern})(.*)$" if once else pattern, f"$1{new}$2" if once else new), T.StringType())

    def call_gsub(self, v, args, env):
        return self.call_sub(v, [args[0], args[1], ("const", "g" + (args[2][1] if len(args) > 2 else ""))], env)

    def call_capture(self, v, args, env):
        pattern = self._regex(args)
        names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
        if len(re.findall(r"(?<!\\)\((?!\?)", pattern)) or not names:
            raise Unsupported("capture with unnamed groups")
        fields = [F.regexp_extract(v.column, pattern, n + 1).alias(x) for n, x in enumerate(names)]
        kind = T.StructType([T.StructField(x, T.StringType()) for x in names])
        return Out(F.when(v.column.rlike(pattern), F.array(F.struct(*fields))).otherwise(F.array().cast(T.ArrayType(kind))), kind, True)

    def call_scan(self, v, args, env):
        pattern = self._regex(args)
        if re.search(r"(?<!\\)\((?!\?:)", pattern):
            raise Unsupported("scan with groups")
        return Out(F.regexp_extract_all(v.column, F.lit(pattern), F.lit(0)), T.StringType(), True)

    def _regex(self, args) -> str:
        if any(a[0] != "const" for a in args):
            raise Unsupported("computed pattern")
        flags = "".join(f for f in (args[1][1] or "" if len(args) > 1 else "") if f in "ixs")
        return (f"(?{flags})" if flags else "") + args[0][1]

    def _strings(self, v, args, env, f):
        return Out(f(v.column, self.argument(v, args, env).column), T.BooleanType())

    def call_startswith(self, v, args, env):
        return self._strings(v, args, env, F.startswith)

    def call_endswith(self, v, args, env):
        return self._strings(v, args, env, F.endswith)

    def call_contains(self, v, args, env):
        if not isinstance(v.type, T.StringType):
            raise Unsupported("contains")
        return self._strings(v, args, env, F.contains)

    def call_ltrimstr(self, v, args, env):
        s = self.argument(v, args, env).column
        return Out(F.when(F.startswith(v.column, s), F.substr(v.column, F.length(s) + 1)).otherwise(v.column), v.type)

    def call_rtrimstr(self, v, args, env):
        s = self.argument(v, args, env).column
        return Out(F.when(F.endswith(v.column, s), F.substr(v.column, F.lit(1), F.length(v.column) - F.length(s))).otherwise(v.column), v.type)

    def call_tostring(self, v, args, env):
        return Out(_text(v), T.StringType())

    def call_tonumber(self, v, args, env):
        return v if _number(v.type) else Out(v.column.cast("double"), T.DoubleType())

    def call_type(self, v, args, env):
        name = {0: "null", 1: "boolean", 3: "number", 4: "string", 5: "array", 6: "object"}[_rank(v.type)]
        return Out(F.when(v.column.isNull(), "null").otherwise(name), T.StringType())

    def call_index(self, v, args, env):
        s = self.argument(v, args, env)
        if not isinstance(v.type, T.StringType):
            raise Unsupported("index")
        at = F.instr(v.column, s.column)
        return Out(F.when(at > 0, at - 1).cast("long"), T.LongType())

    def call_pow(self, v, args, env):
        return Out(F.pow(self.argument(v, args, env).column, self.argument(v, args, env, 1).column), T.DoubleType())

    def call_strftime(self, v, args, env):
        patterns = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%Z": "'UTC'"}
        form = "".join(patterns.get(p, re.sub(r"([A-Za-z]+)", r"'\1'", p)) for p in re.findall(r"%.|[^%]+", args[0][1]))
        return Out(F.date_format(F.timestamp_seconds(v.column), form), T.StringType())

    def call_todate(self, v, args, env):
        return self.call_strftime(v, [("const", "%Y-%m-%dT%H:%M:%SZ")], env)


def _replaced(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_STRING = lambda t: isinstance(t, T.StringType)
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DOUBLE = {n: (_number, getattr(F, n), T.DoubleType()) for n in "sqrt exp log2 log10 sin cos tan asin acos atan sinh cosh tanh cbrt expm1 log1p".split()}
_SIMPLE = {
    **_DOUBLE, "log": (_number, F.log, T.DoubleType()), "floor": (_number, F.floor, T.LongType()), "ceil": (_number, F.ceil, T.LongType()), "round": (_number, lambda c: F.when(c >= 0, F.floor(c + 0.5)).otherwise(F.ceil(c - 0.5)), T.LongType()), "fabs": (_number, F.abs, lambda t: t), "abs": (_number, F.abs, lambda t: t),
    "ascii_downcase": (_STRING, lambda c: F.translate(c, _UPPER, _LOWER), T.StringType()), "ascii_upcase": (_STRING, lambda c: F.translate(c, _LOWER, _UPPER), T.StringType()), "utf8bytelength": (_STRING, lambda c: F.octet_length(c).cast("long"), T.LongType()),
    "trim": (_STRING, lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), T.StringType()), "ltrim": (_STRING, lambda c: F.regexp_replace(c, r"^\s+", ""), T.StringType()), "rtrim": (_STRING, lambda c: F.regexp_replace(c, r"\s+$", ""), T.StringType()),
    "explode": (_STRING, lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")), T.ArrayType(T.LongType())), "isnan": (_number, F.isnan, T.BooleanType()), "isinfinite": (_number, lambda c: F.abs(c) == float("inf"), T.BooleanType()), "tojson": (lambda t: isinstance(t, (T.StructType, T.ArrayType, T.MapType)), lambda c: F.to_json(c, {"ignoreNullFields": "false"}), T.StringType()), "null": (lambda t: True, lambda c: F.lit(None), T.NullType()), "true": (lambda t: True, lambda c: F.lit(True), T.BooleanType()), "false": (lambda t: True, lambda c: F.lit(False), T.BooleanType()), "nan": (lambda t: True, lambda c: F.lit(float("nan")), T.DoubleType()), "infinite": (lambda t: True, lambda c: F.lit(float("inf")), T.DoubleType()),
}


def compile_column(program: str, column: Column, kind: T.DataType) -> Out:
    """The program over a column. many: the column is an array of outputs."""
    return Compiler().run(parse(program), Out(column, kind), {})


def column(df: DataFrame, program: str, name: str) -> Column:
    """A program over a column of df; its outputs as one value, or an array where there may be several."""
    return compile_column(program, F.col(name), df.schema[name].dataType).column


def query(docs: DataFrame, program: str, name: str = "json", out: str = "outputs") -> DataFrame:
    """docs with `outputs`, an array of JSON texts, and `error`, of a program over the JSON text in column `name`.

    The evaluator runs in tasks, row by row; nothing is shuffled.
    """
    compiled = jq.compile_program(program)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in (out, "error")), T.StructField(out, T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, errors = [], []
            for text in batch.column(batch.schema.get_field_index(name)).to_pylist():
                found: list | None = []
                error = None
                try:
                    found = [to_json(x, finite=False) for x in compiled.stream(None if text is None else parse_json(text))]
                except Exception as e:  # noqa: BLE001  the row's error, told beside it
                    found, error = None, str(e)
                outputs.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outputs, pa.list_(pa.string())), pa.array(errors, pa.string())], names=[*batch.schema.names, out, "error"])

    return docs.drop(out, "error").mapInArrow(run, schema)
