"""Schemas as Catalyst expressions: one compiler over typed columns and over VARIANT.

A schema becomes flat checks, each a boolean Column with the constants of its violation folded in, and expressions for
what stands inside arrays and maps. The disjunction of the flat checks is a plain predicate, which Catalyst pushes into
a Parquet scan; the violations are an array built only for rows that reach them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.canonical import canonical_json
from fathomline.functions.vocab import keyword_text, whole

from .patterns import java
from .schema_tree import SchemaTree, every

VIOLATION = T.StructType([
    T.StructField("json_path", T.ArrayType(T.StringType())), T.StructField("validator", T.StringType()), T.StructField("validator_value", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("message", T.StringType()),
])


def nothing() -> Column:
    return F.array().cast(T.ArrayType(VIOLATION))


#: Names of VARIANT's classes of numbers.
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class NotColumnar(ValueError):
    """The schema needs the row interpreter."""


def is_whole(x: Column) -> Column:
    """Of any size: a remainder, as rounding a double gives a BIGINT."""
    return x % 1 == 0


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """make(x) with x worked out once, however often make uses it: an expression that stands twice in a plan runs twice."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


#: A double v in scientific notation with the fewest digits that read back as it.
_DIGITS = "case " + " ".join(f"when try_cast(format_string('%.{n}e', v) as double) = v then format_string('%.{n}e', v)" for n in (14, 15)) + " else format_string('%.16e', v) end"


def _trimmed(decimals: int) -> str:
    return rf"regexp_replace(regexp_replace(cast(try_cast(e as decimal(38,{decimals})) as string), '0+$', ''), r'\.$', '')"


@functools.cache
def _number_sql(python: bool) -> str:
    """As a lambda's text, which is parsed once: as many Column calls would take longer than most checks run."""
    least, power = ("1e-4D", "e$10$2") if python else ("1e-6D", "e$1$2")
    other = rf"regexp_replace(regexp_replace(e, r'\.?0+e', 'e'), r'e([+-])0(\d)$', '{power}')"
    plain = f"case when abs(v) >= 1 then {_trimmed(17)} else {_trimmed(36)} end"
    spelled = f"case when v % 1 = 0 and abs(v) < 1e21D then cast(try_cast(e as decimal(38,0)) as string) when abs(v) >= {least} and abs(v) < 1e21D then {plain} else {other} end"
    small = "v % 1 = 0 and abs(v) <= 9007199254740992D"
    return f"v -> case when {small} then cast(try_cast(v as bigint) as string) else get(transform(array({_DIGITS}), e -> {spelled}), 0) end"


def number_text(x: Column, python: bool = False) -> Column:
    """A double as JSON writes it, or as Python's repr does; whole ones below 1e21 without a fraction in both."""
    return F.get(F.call_function("transform", F.array(x), F.expr(_number_sql(python))), F.lit(0))


def quoted(s: Column) -> Column:
    """A string as Python's repr writes it (printable characters stand as they are)."""

    def made(s: Column) -> Column:
        body = F.replace(
            F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
            F.lit("\t"), F.lit("\\t"),
        )
        single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
        return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return let(s, made)


def json_text(s: Column) -> Column:
    packed = F.to_json(F.array(s))
    return F.substring(packed, 2, F.length(packed) - 2)


def java_pattern(pattern: str) -> str:
    """The pattern in Java's dialect with Python's meaning (plans/patterns.py); NotColumnar where Java can't say it."""
    try:
        found = java(pattern)
        if (jvm := getattr(SparkSession.getActiveSession(), "_jvm", None)) is not None:
            jvm.java.util.regex.Pattern.compile(found)
    except Exception as e:
        raise NotColumnar(f"no Java pattern for {pattern!r}") from e
    return found


class Node:
    """A value in the plan: what a schema can ask of it, as Columns. there: it is no SQL NULL."""

    there: Column

    def is_type(self, name: str) -> Column | bool: ...
    def number(self) -> Column | None: ...
    def text(self) -> Column | None: ...
    def array(self) -> Column | None: ...
    def element(self, c: Column) -> Node: ...
    def field(self, name: str) -> Node | None: ...
    def keys(self) -> Column | None: ...
    def values(self) -> tuple[Column, Callable[[Column], Node]] | None: ...
    def json(self) -> Column: ...
    def shown(self) -> Column: ...

    def texts(self) -> tuple[Column, Column]:
        """json() and shown(), made once for all checks of the node."""
        if "_texts" not in self.__dict__:
            self.__dict__["_texts"] = (self.json(), self.shown())
        return self.__dict__["_texts"]


#: Types whose values are JSON strings, as to_json writes them.
SPELLED = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType)


@dataclass
class Typed(Node):
    """A column of a known type. NULL is absence: a row's null field is a missing property. Dates, times and bytes are strings."""

    c: Column
    kind: T.DataType

    @property
    def there(self) -> Column:
        return self.c.isNotNull()

    def is_type(self, name):
        k = self.kind
        match name:
            case "string":
                return isinstance(k, (T.StringType, *SPELLED))
            case "boolean":
                return isinstance(k, T.BooleanType)
            case "array":
                return isinstance(k, T.ArrayType)
            case "object":
                return isinstance(k, (T.StructType, T.MapType))
            case "number":
                return isinstance(k, T.NumericType)
            case "integer":
                return isinstance(k, INTEGRAL) or (is_whole(self.c) if isinstance(k, T.NumericType) else False)
        return False

    def number(self):
        return self.c if isinstance(self.kind, T.NumericType) else None

    def text(self):
        if isinstance(self.kind, T.DateType):
            return self.c.cast("string")
        if isinstance(self.kind, SPELLED):
            return F.get_json_object(F.to_json(F.struct(self.c.alias("v"))), "$.v")
        return self.c if isinstance(self.kind, T.StringType) else None

    def array(self):
        return self.c if isinstance(self.kind, T.ArrayType) else None

    def element(self, c):
        return Typed(c, self.kind.elementType)

    def field(self, name):
        if isinstance(self.kind, T.StructType):
            return Typed(self.c[name], self.kind[name].dataType) if name in self.kind.names else None
        return Typed(F.try_element_at(self.c, F.lit(name)), self.kind.valueType) if isinstance(self.kind, T.MapType) else None

    def keys(self):
        if isinstance(self.kind, T.StructType):
            return F.array_compact(F.array(*[F.when(self.c[n].isNotNull(), F.lit(n)) for n in self.kind.names]).cast("array<string>"))
        return F.map_keys(self.c) if isinstance(self.kind, T.MapType) else None

    def values(self):
        if isinstance(self.kind, T.MapType):
            return F.map_entries(self.c), lambda v: Typed(v, self.kind.valueType)
        return None

    def json(self):
        k = self.kind
        if isinstance(k, (T.StringType, *SPELLED)):
            return json_text(self.text())
        if isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)):
            return number_text(self.c.cast("double"))
        if isinstance(k, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(self.c)
        return self.c.cast("string")

    def shown(self):
        if isinstance(self.kind, (T.StringType, *SPELLED)):
            return quoted(self.text())
        if isinstance(self.kind, T.BooleanType):
            return F.when(self.c, F.lit("True")).otherwise(F.lit("False"))
        if isinstance(self.kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return number_text(self.c.cast("double"), python=True)
        return self.json()


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Row(Typed):
    """The row itself: an object whose properties are columns."""

    def __init__(self, kind: T.StructType) -> None:
        self.kind = kind
        self.c = F.struct(*[column(n).alias(n) for n in kind.names])

    @property
    def there(self) -> Column:
        return F.lit(True)

    def field(self, name):
        return Typed(column(name), self.kind[name].dataType) if name in self.kind.names else None

    def keys(self):
        return F.array_compact(F.array(*[F.when(column(n).isNotNull(), F.lit(n)) for n in self.kind.names]).cast("array<string>"))


@dataclass
class Variant(Node):
    """A VARIANT column. JSON null is a value; a missing path is not there."""

    c: Column

    @property
    def there(self) -> Column:
        return self.c.isNotNull()

    @property
    def _class(self) -> Column:
        return F.substring_index(F.schema_of_variant(self.c), "(", 1)

    def is_type(self, name):
        """Of objects and arrays by what they can be read as: their class would be spelled out to the last leaf."""
        match name:
            case "object":
                return F.try_variant_get(self.c, "$", "map<string,variant>").isNotNull()
            case "array":
                return F.try_variant_get(self.c, "$", "array<variant>").isNotNull()
        k = self._class
        match name:
            case "integer":
                return k.isin(*NUMBERS) & F.coalesce(is_whole(F.try_variant_get(self.c, "$", "double")), F.lit(False))
            case "number":
                return k.isin(*NUMBERS)
        return k == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]

    def number(self):
        return F.when(self.is_type("number"), F.try_variant_get(self.c, "$", "double"))

    def text(self):
        return F.when(self.is_type("string"), F.try_variant_get(self.c, "$", "string"))

    def array(self):
        return F.try_variant_get(self.c, "$", "array<variant>")

    def element(self, c):
        return Variant(c)

    def field(self, name):
        """By path, in the quotes that the name leaves free; a name that a path can't hold is looked up in a map."""
        quote = next((q for q in "\"'" if q not in name), None)
        if quote is None or not name or "?" in name:
            return Variant(F.try_element_at(F.try_variant_get(self.c, "$", "map<string,variant>"), F.lit(name)))
        return Variant(F.try_variant_get(self.c, f"$[{quote}{name}{quote}]", "variant"))

    def keys(self):
        return F.map_keys(F.try_variant_get(self.c, "$", "map<string,variant>"))

    def values(self):
        return F.map_entries(F.try_variant_get(self.c, "$", "map<string,variant>")), Variant

    def json(self):
        return let(
            self._class,
            lambda k: F.when(k.isin(*NUMBERS), number_text(F.try_variant_get(self.c, "$", "double"))).otherwise(F.to_json(self.c)),
        )

    def shown(self):
        def by_class(k: Column) -> Column:
            double, text = F.try_variant_get(self.c, "$", "double"), F.try_variant_get(self.c, "$", "string")
            named = F.when(k == "STRING", quoted(text)).when(k == "BOOLEAN", F.initcap(F.to_json(self.c))).when(k == "VOID", F.lit("None"))
            return named.when(k.isin(*NUMBERS), number_text(double, python=True)).otherwise(F.to_json(self.c))

        return let(self._class, by_class)


@dataclass
class Check:
    """One way to violate: bad is the condition, never NULL-dependent; arguments as a violation's."""

    path: Column
    keyword: str
    limit: Any
    node: Node
    bad: Column

    def record(self) -> Column:
        text = keyword_text(self.keyword, self.limit)
        value, shown = self.node.texts()
        before, mark, after = text.partition("{v}")
        said = F.concat(F.lit(before), shown, F.lit(after)) if mark else F.lit(text)
        one = F.struct(
            self.path.alias("json_path"), F.lit(self.keyword).alias("validator"),
            F.lit(canonical_json(whole(self.limit))).alias("validator_value"), value.alias("value"),
            said.alias("message"),
        )
        return one.cast(VIOLATION)

    def violation(self) -> Column:
        return F.when(self.bad, F.array(self.record())).otherwise(nothing())


@dataclass
class Program:
    """A compiled schema. flat: checks outside arrays and maps; inner: arrays of violations from inside these; later: arrays
    of ITEM, the values that a recursive schema is still to be asked about."""

    flat: list[Check]
    inner: list[Column]
    later: list[Column] = field(default_factory=list)

    def invalid(self) -> Column:
        if self.later:
            raise NotColumnar("a recursive schema stands in a condition")
        parts = [c.bad for c in self.flat] + [F.size(c) > 0 for c in self.inner]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def violations(self) -> Column:
        """array<struct>, sorted by path and keyword."""
        parts = [c.violation() for c in self.flat] + self.inner
        return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0] if parts else nothing()


def _known(x: Column | bool) -> Column:
    return F.lit(x) if isinstance(x, bool) else F.coalesce(x, F.lit(False))


def compile_schema(tree: SchemaTree, node: Node) -> Program:
    """NotColumnar for what needs the interpreter. A recursive schema over a typed column ends where the type does; over VARIANT
    see recursive_violations()."""
    if tree.recursive() and isinstance(node, Variant):
        raise NotColumnar("the schema is recursive")
    compiler = _Compiler(tree)
    compiler.visit(tree.root, node, F.array().cast("array<string>"), F.lit(True))
    return Program(compiler.flat, compiler.inner)


def compile_part(tree: SchemaTree, schema: Any, node: Node, path: Column) -> Program:
    """A part of a schema on a node that stands at a path."""
    if tree.recursive():
        raise NotColumnar("the schema is recursive")
    compiler = _Compiler(tree)
    compiler.visit(schema, node, path, F.lit(True))
    return Program(compiler.flat, compiler.inner)


#: A value that a state of a recursive schema is to be asked about; instead: what any violation in it counts as.
ITEM = T.StructType([
    T.StructField("state", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("value", T.VariantType()), T.StructField("instead", VIOLATION),
])


def recursive_violations(tree: SchemaTree, value: Column) -> Column:
    """Violations of a VARIANT by a recursive schema, as one expression.

    The schema is a machine: its states are the root and the schemas that it reaches itself through. A state's program says
    what is wrong with a value down to the next states and which values these are to be asked about. Starting from the root,
    each step runs the programs of all values of a level; there are as many steps as the value may have levels, by the
    brackets of its text. Recursion under not, oneOf, contains and conditions is left to the interpreter: NotColumnar; of
    anyOf one branch may be recursive."""
    targets = tree.loops()
    states = [tree.root, *targets]
    number = {id(t): k + 1 for k, t in enumerate(targets)}

    def compiled(item: Column, pick: Callable[[Program, Column], Column]) -> Column:
        out = None
        for k, schema in enumerate(states):
            compiler = _Compiler(tree, number)
            compiler.visit(schema, Variant(item["value"]), item["path"], F.lit(True))
            found = pick(Program(compiler.flat, compiler.inner, compiler.later), item)
            out = F.when(item["state"] == k, found) if out is None else out.when(item["state"] == k, found)
        return out

    def wrong(program: Program, item: Column) -> Column:
        return F.when(item["instead"].isNull(), program.violations()).otherwise(nothing())

    def stands_for(program: Program, item: Column) -> Column:
        return F.when(item["instead"].isNotNull() & (F.size(program.violations()) > 0), F.array(item["instead"])).otherwise(nothing())

    def later(program: Program, item: Column) -> Column:
        items = F.concat(*program.later) if program.later else F.array().cast(T.ArrayType(ITEM))
        return F.transform(items, lambda x: F.struct(x["state"].alias("state"), x["path"].alias("path"), x["value"].alias("value"), F.coalesce(item["instead"], x["instead"]).alias("instead")).cast(ITEM))

    def step(held: Column, _: Column) -> Column:
        made = lambda pick: F.flatten(F.transform(held["items"], lambda item: compiled(item, pick)))
        more = lambda name, found: F.concat(held[name], found).cast(T.ArrayType(VIOLATION)).alias(name)
        stood = [more("stood", made(stands_for))] if collapses else []
        return F.struct(made(later).cast(T.ArrayType(ITEM)).alias("items"), more("done", made(wrong)), *stood)

    collapses = any("anyOf" in node for node in every(tree.root))
    first = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("path"), value.alias("value"), F.lit(None).cast(VIOLATION).alias("instead")).cast(ITEM)
    start = F.struct(F.array(first).cast(T.ArrayType(ITEM)).alias("items"), nothing().alias("done"), *([nothing().alias("stood")] if collapses else []))
    text = F.to_json(value)
    brackets = F.length(text) - F.length(F.translate(text, "{[", ""))
    # a value may be asked about by each state in turn before a step into it
    levels = F.sequence(F.lit(1), (F.least(brackets, F.lit(MAX_LEVELS)) + 1) * len(states))
    found = F.aggregate(levels, start, step, lambda held: F.array_sort(F.concat(held["done"], F.array_distinct(held["stood"])) if collapses else held["done"]))
    return F.when(value.isNull(), nothing()).otherwise(found)


#: Levels that Spark's VARIANT may have.
MAX_LEVELS = 1000


class _Compiler:
    """states: numbers of schemas (by id) that are not entered but left for later."""

    def __init__(self, tree: SchemaTree, states: dict[int, int] | None = None) -> None:
        self.tree = tree
        self.states = states or {}
        self.flat: list[Check] = []
        self.inner: list[Column] = []
        self.later: list[Column] = []

    def sub(self, schema: Any, node: Node, path: Column) -> Program:
        other = _Compiler(self.tree, self.states)
        other.visit(schema, node, path, F.lit(True))
        return Program(other.flat, other.inner, other.later)

    def each(self, over: Column, make: Callable[..., tuple[Column, Program]], when: Column) -> None:
        """For each element of an array the violations, and what is left for later, of a program where a condition holds."""
        deferred: list[bool] = []

        def found(pick: Callable[[Program], Column], none: Column) -> Callable[[Column, Column], Column]:
            def below(x: Column, i: Column) -> Column:
                holds, program = make(x, i)
                deferred.append(bool(program.later))
                return F.when(holds, pick(program)).otherwise(none)

            return below

        listed = lambda pick, none: F.coalesce(F.when(when, F.flatten(F.transform(over, found(pick, none)))), none)
        self.inner.append(listed(lambda p: p.violations(), nothing()))
        if any(deferred):
            none = F.array().cast(T.ArrayType(ITEM))
            self.later.append(listed(lambda p: F.concat(*p.later), none))

    def defer(self, state: int, node: Node, path: Column, when: Column, instead: Column | None = None) -> None:
        item = F.struct(F.lit(state).alias("state"), path.alias("path"), node.c.alias("value"), (F.lit(None) if instead is None else instead).cast(VIOLATION).alias("instead")).cast(ITEM)
        self.later.append(F.when(when & node.there, F.array(item).cast(T.ArrayType(ITEM))).otherwise(F.array().cast(T.ArrayType(ITEM))))

    def visit(self, schema: Any, node: Node, path: Column, when: Column) -> None:
        """Checks of schema on node wherever `when` holds."""
        if schema is True:
            return

        def bad(keyword: str, limit: Any, condition: Column | bool | None) -> None:
            if condition is not None and condition is not False:
                # a typed scalar's condition is NULL only with the value itself: left bare, it can reach the scan
                scalar = isinstance(node, Typed) and not isinstance(node.kind, (T.StructType, T.MapType, T.ArrayType)) and not isinstance(condition, bool)
                self.flat.append(Check(path, keyword, limit, node, when & (node.there & condition if scalar else _known(condition))))

        if schema is False:
            return bad("False schema", None, True)
        number, text, array, keys = node.number(), node.text(), node.array(), node.keys()
        for k, limit in schema.items():
            match k:
                case "$ref" | "$dynamicRef":
                    target = self.tree.targets(schema)[0 if k == "$ref" else -1]
                    if id(target) in self.states:
                        self.defer(self.states[id(target)], node, path, when)
                    else:
                        self.visit(target, node, path, when)
                case "type":
                    tests = [node.is_type(t) for t in ([limit] if isinstance(limit, str) else limit)]
                    if not any(t is True for t in tests):
                        real = [t for t in tests if t is not False]
                        bad(k, limit, ~reduce(lambda a, b: a | b, real) if real else True)
                case "enum":
                    bad(k, limit, ~self._among(node, limit))
                case "const":
                    bad(k, limit, ~self._among(node, [limit]))
                case "minimum" if number is not None:
                    bad(k, limit, number < limit)
                case "maximum" if number is not None:
                    bad(k, limit, number > limit)
                case "exclusiveMinimum" if number is not None:
                    bad(k, limit, number <= limit)
                case "exclusiveMaximum" if number is not None:
                    bad(k, limit, number >= limit)
                case "multipleOf" if number is not None:
                    bad(k, limit, self._rest(node, number, limit))
                case "minLength" if text is not None:
                    bad(k, limit, F.length(text) < limit)
                case "maxLength" if text is not None:
                    bad(k, limit, F.length(text) > limit)
                case "pattern" if text is not None:
                    bad(k, limit, ~text.rlike(java_pattern(limit)))
                case "minItems" if array is not None:
                    bad(k, limit, F.size(array) < limit)
                case "maxItems" if array is not None:
                    bad(k, limit, F.size(array) > limit)
                case "uniqueItems" if array is not None and limit:
                    texts = F.transform(array, lambda x: node.element(x).json())
                    bad(k, limit, F.size(F.array_distinct(texts)) < F.size(array))
                case "contains" if array is not None:
                    hits = F.size(F.filter(array, lambda x: ~self.sub(limit, node.element(x), path).invalid()))
                    least, most = schema.get("minContains", 1), schema.get("maxContains")
                    bad("minContains" if "minContains" in schema else k, schema.get("minContains", limit), hits < least)
                    if most is not None:
                        bad("maxContains", most, hits > most)
                case "items" | "prefixItems" if array is not None:
                    self._items(schema, k, node, array, path, when)
                case "required" if keys is not None:
                    for name in limit:
                        has = node.field(name)
                        bad(k, limit, self._object(node) & (~has.there if has is not None else F.lit(True)))
                case "minProperties" if keys is not None:
                    bad(k, limit, F.size(keys) < limit)
                case "maxProperties" if keys is not None:
                    bad(k, limit, F.size(keys) > limit)
                case "dependentRequired" if keys is not None:
                    for name, wanted in limit.items():
                        for other in wanted:
                            bad(k, limit, F.array_contains(keys, name) & ~F.array_contains(keys, other))
                case "properties" if keys is not None:
                    for name, sub in limit.items():
                        if (child := node.field(name)) is not None:
                            self.visit(sub, child, F.concat(path, F.array(F.lit(name))), when & child.there)
                case "patternProperties" if keys is not None:
                    self._values(node, limit, path, when, lambda key, p: key.rlike(java_pattern(p)))
                case "additionalProperties" if keys is not None:
                    self._additional(schema, limit, node, keys, path, when, bad)
                case "propertyNames" if keys is not None:
                    self.each(keys, lambda name, _: (F.lit(True), self.sub(limit, Typed(name, T.StringType()), path)), when)
                case "dependentSchemas" if keys is not None:
                    for name, sub in limit.items():
                        self.visit(sub, node, path, when & _known(F.array_contains(keys, name)))
                case "unevaluatedProperties" if keys is not None:
                    bad(k, limit, self._unevaluated_names({x: v for x, v in schema.items() if x != k}, limit, node, keys, path))
                case "unevaluatedItems" if array is not None:
                    covered = self._places({x: v for x, v in schema.items() if x != k}, node, path)
                    rest = F.filter(F.transform(array, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~covered(e["x"], e["i"]))
                    bad(k, limit, F.exists(rest, lambda e: self.sub(limit, node.element(e["x"]), path).invalid()))
                case "allOf":
                    for sub in limit:
                        self.visit(sub, node, path, when)
                case "anyOf" if self.states and self._recursive_branch(limit) is not None:
                    self._any_of(limit, node, path, when)
                case "anyOf" | "oneOf":
                    fine = [F.when(self.sub(s, node, path).invalid(), 0).otherwise(1) for s in limit]
                    total = reduce(lambda a, b: a + b, fine)
                    bad(k, limit, total < 1 if k == "anyOf" else total != 1)
                case "not":
                    bad(k, limit, ~self.sub(limit, node, path).invalid())
                case "if":
                    met = ~self.sub(limit, node, path).invalid()
                    if "then" in schema:
                        self.visit(schema["then"], node, path, when & met)
                    if "else" in schema:
                        self.visit(schema["else"], node, path, when & ~met)

    def _recursive_branch(self, branches: list[Any]) -> int | None:
        """The number of the one branch that is just a reference to a state."""
        at = [i for i, b in enumerate(branches) if isinstance(b, dict) and "$ref" in b and id(self.tree.resolve(b["$ref"], b)) in self.states]
        return at[0] if len(at) == 1 and set(branches[at[0]]) <= {"$ref", "description", "title"} else None

    def _any_of(self, branches: list[Any], node: Node, path: Column, when: Column) -> None:
        """Where no other branch is fine, the value's violations by the recursive one count as one of anyOf."""
        at = self._recursive_branch(branches)
        none = F.lit(True)
        for i, sub in enumerate(branches):
            if i != at:
                none = none & _known(self.sub(sub, node, path).invalid())
        branch = branches[at]
        state = self.states[id(self.tree.resolve(branch["$ref"], branch))]
        self.defer(state, node, path, when & none, Check(path, "anyOf", branches, node, none).record())

    def _in_place(self, schema: dict, node: Node, keys: Column | None, path: Column) -> list[tuple[Any, Column | None]]:
        """(subschema, condition or None) of those that the schema asks about the same value, where they count as evaluating it."""
        found: list[tuple[Any, Column | None]] = [(sub, None) for sub in schema.get("allOf", ())]
        fine = lambda sub: ~self.sub(sub, node, path).invalid()
        found += [(sub, None) for sub in self.tree.targets(schema)]
        found += [(sub, fine(sub)) for k in ("anyOf", "oneOf") for sub in schema.get(k, ())]
        if "if" in schema:
            met = fine(schema["if"])
            found.append((schema["if"], met))
            found += [(schema[k], met if k == "then" else ~met) for k in ("then", "else") if k in schema]
        if keys is not None:
            found += [(sub, _known(F.array_contains(keys, name))) for name, sub in schema.get("dependentSchemas", {}).items()]
        return found

    def _names(self, schema: Any, node: Node, keys: Column, path: Column) -> Callable[[Column], Column]:
        """Whether the schema evaluates the property of a name, as a function of the name."""
        if not isinstance(schema, dict):
            return lambda name: F.lit(False)
        if "additionalProperties" in schema or "unevaluatedProperties" in schema:
            return lambda name: F.lit(True)
        named, patterns = list(schema.get("properties", {})), [java_pattern(p) for p in schema.get("patternProperties", {})]
        more = [(self._names(sub, node, keys, path), when) for sub, when in self._in_place(schema, node, keys, path)]

        def covered(name: Column) -> Column:
            tests = [name.isin(named)] if named else []
            tests += [name.rlike(p) for p in patterns] + [sub(name) if when is None else when & sub(name) for sub, when in more]
            return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

        return covered

    def _places(self, schema: Any, node: Node, path: Column) -> Callable[[Column, Column], Column]:
        """Whether the schema evaluates an item, as a function of the item and its place."""
        if not isinstance(schema, dict):
            return lambda x, i: F.lit(False)
        if "items" in schema or "unevaluatedItems" in schema:
            return lambda x, i: F.lit(True)
        first = len(schema.get("prefixItems", ()))
        more = [(self._places(sub, node, path), when) for sub, when in self._in_place(schema, node, None, path)]

        def covered(x: Column, i: Column) -> Column:
            tests = [i < first] if first else []
            if "contains" in schema:
                tests.append(~self.sub(schema["contains"], node.element(x), path).invalid())
            tests += [sub(x, i) if when is None else when & sub(x, i) for sub, when in more]
            return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

        return covered

    def _unevaluated_names(self, schema: dict, limit: Any, node: Node, keys: Column, path: Column) -> Column:
        covered = self._names(schema, node, keys, path)
        if limit is False:
            return F.exists(keys, lambda name: ~covered(name))
        if (found := node.values()) is not None:
            entries, make = found
            return F.exists(entries, lambda e: ~covered(e["key"]) & self.sub(limit, make(e["value"]), path).invalid())
        fields = [(n, node.field(n)) for n in node.kind.names]
        tests = [f.there & ~covered(F.lit(n)) & self.sub(limit, f, path).invalid() for n, f in fields]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def _object(self, node: Node) -> Column:
        return _known(node.is_type("object"))

    def _among(self, node: Node, values: list[Any]) -> Column:
        if isinstance(node, Typed) and node.text() is not None:
            return node.text().isin([v for v in values if isinstance(v, str)])
        if isinstance(node, Typed) and node.number() is not None:
            return node.c.isin([v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)])
        return _known(node.json().isin([canonical_json(whole(v)) for v in values]))

    def _rest(self, node: Node, number: Column, of: float) -> Column:
        """Whether it is no multiple. A whole number divides as it is; else in decimal, so that 0.3 is a multiple of 0.1, up to
        1e20; beyond, the quotient of doubles has to be whole."""
        if float(of).is_integer() and of < 1e38:
            double = number % F.lit(float(of)) != 0
            exact = lambda c: c % F.lit(Decimal(int(of))) != 0
            if isinstance(node, Variant):  # integers beyond 2**53 divide as they are
                big = F.when(node._class.isin("BIGINT", "DECIMAL"), exact(F.try_variant_get(node.c, "$", "decimal(38,0)")))
                return F.when(F.abs(number) < 2.0**53, double).otherwise(F.coalesce(big, double))
            if isinstance(node.kind, (T.DoubleType, T.FloatType)):
                return double
            return number % F.lit(int(of)) != 0 if of < 1e18 else exact(number.cast("decimal(38,0)"))
        if of >= 1e38 or -Decimal(repr(of)).as_tuple().exponent > 18:
            raise NotColumnar("multipleOf of more than 18 decimals needs the interpreter")
        d, double = number.try_cast("decimal(38,18)"), number.cast("double")
        if isinstance(node, Variant):
            d = F.when(node._class.isin("BIGINT", "DECIMAL"), F.try_variant_get(node.c, "$", "decimal(38,18)")).otherwise(d)
        exact = d.cast("double") == double  # a number with more decimals is no multiple
        return F.when(d.isNull(), double / F.lit(float(of)) % 1 != 0).when(~exact, True).otherwise(d % F.lit(Decimal(repr(of))) != 0)

    def _items(self, schema: dict, keyword: str, node: Node, array: Column, path: Column, when: Column) -> None:
        first = schema.get("prefixItems", [])
        if keyword == "prefixItems":
            for i, sub in enumerate(first):
                child = node.element(F.get(array, F.lit(i)))
                self.visit(sub, child, F.concat(path, F.array(F.lit(str(i)))), when & (F.size(array) > i) & child.there)
            return
        make = lambda x, i: (
            (i >= len(first)) & node.element(x).there, self.sub(schema["items"], node.element(x), F.concat(path, F.array(i.cast("string")))),
        )
        self.each(array, make, when & array.isNotNull())

    def _values(self, node: Node, by_pattern: dict[str, Any], path: Column, when: Column, match: Callable[[Column, str], Column]) -> None:
        if (found := node.values()) is None:
            if isinstance(node.kind, T.StructType):
                raise NotColumnar("patternProperties over a struct needs the interpreter")
            return
        entries, make_ = found

        for pattern, sub in by_pattern.items():
            make = lambda e, _, pattern=pattern, sub=sub: (match(e["key"], pattern), self.sub(sub, make_(e["value"]), F.concat(path, F.array(e["key"]))))
            self.each(entries, make, when)

    def _additional(self, schema: dict, limit: Any, node: Node, keys: Column, path: Column, when: Column, bad: Callable) -> None:
        if limit is True or limit == {}:
            return
        named = list(schema.get("properties", {}))
        patterns = [java_pattern(p) for p in schema.get("patternProperties", {})]

        def extra(key: Column) -> Column:
            return reduce(lambda a, p: a & ~key.rlike(p), patterns, ~key.isin(named) if named else F.lit(True))

        if limit is False:
            return bad("additionalProperties", False, F.exists(keys, extra))
        if (found := node.values()) is None:
            for name in node.kind.names if isinstance(node.kind, T.StructType) else ():
                if name not in named:
                    child = node.field(name)
                    self.visit(limit, child, F.concat(path, F.array(F.lit(name))), when & child.there)
            return
        entries, make = found
        self.each(entries, lambda e, _: (extra(e["key"]), self.sub(limit, make(e["value"]), F.concat(path, F.array(e["key"])))), when)
