"""Instances as Spark SQL: what the tests of a plan ask of a value, for VARIANTs and for typed columns.

A typed column (a number, a string, a struct, an array, a map of strings) is tested as it is; its NULLs
are JSON nulls, except that a NULL at the root is no instance. Other types are read as VARIANTs. Answers
are exact: a DOUBLE stands for its shortest decimal, so bounds are compared with the nearest DOUBLE that
is on the right side of them. NaN passes no test of numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal

import numpy as np
from pyspark.sql import types as T

from ..plans.values import EVERY_KIND

# VARIANT's type names by kind, to six letters.
TYPES = {
    "null": ("VOID",),
    "boolean": ("BOOLEA",),
    "number": ("BIGINT", "DECIMA", "DOUBLE", "FLOAT"),
    "string": ("STRING", "DATE", "TIMEST", "BINARY", "UUID"),
}
#: Precise enough for any number that is compared here.
_WIDE = Context(prec=2000)


class Refused(ValueError):
    """The plan cannot be run soundly; the message says why."""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


@dataclass(frozen=True)
class Sql:
    """accept: true, false or NULL; unsure: whether it may be NULL; guess: true where a constraint was not enforced."""

    accept: str
    unsure: bool = False
    guess: str = "false"


YES, NO = Sql("true"), Sql("false")
UNDECIDED = Sql("CAST(NULL AS BOOLEAN)", True)


def either_text(parts) -> str:
    parts = list(dict.fromkeys(p for p in parts if p != "false"))
    return "true" if "true" in parts else "(" + " OR ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "false"


def both_text(parts) -> str:
    parts = list(dict.fromkeys(p for p in parts if p != "true"))
    return "false" if "false" in parts else "(" + " AND ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "true"


def choice(test: str, then: str, other: str) -> str:
    """CASE WHEN test THEN then ELSE other END, folded where the test is known or makes no difference."""
    if test in ("true", "false") or then == other:
        return then if test != "false" else other
    if (then, other) == ("true", "false"):
        return test
    return f"CASE WHEN {test} THEN {then} ELSE {other} END"


def word(x: str) -> str:
    """VARIANT's type name of a scalar, to six letters."""
    return f"left(schema_of_variant({x}), 6)"


def as_map(x: str) -> str:
    return f"try_cast({x} AS MAP<STRING, VARIANT>)"


def as_array(x: str) -> str:
    return f"try_cast({x} AS ARRAY<VARIANT>)"


def as_text(x: str) -> str:
    return f"try_cast({x} AS STRING)"


# --- names for expressions that are used more than once ---


class Scope:
    """Expressions with names, within the body of one lambda or of none; equal expressions have one name.

    flat: all are written out where they are used. (Lambdas within lambdas confuse Spark's extraction of Python
    functions from an expression.)
    """

    def __init__(self, names: Callable[[], str], flat: bool = False) -> None:
        self.names, self.flat, self.by_text = names, flat, {}

    def let(self, expression: str) -> str:
        if expression not in self.by_text:
            self.by_text[expression] = self.names()
        return self.by_text[expression]

    def steps(self, *bodies: str) -> tuple[list[tuple[str, str]], list[str]]:
        """(name, expression) of what is used more than once, in order of use, and the bodies with the others written out."""
        lets = {name: text for text, name in self.by_text.items()}
        texts, order = list(bodies), list(lets)
        kept: list[tuple[str, str]] = []
        for name in reversed(order):  # an expression only uses names that were made before it
            use = re.compile(rf"\b{name}\b")
            n = sum(len(use.findall(t)) for t in texts) + sum(len(use.findall(t)) for _, t in kept)
            if n > 1 and not self.flat:
                kept.append((name, lets[name]))
            elif n:
                texts = [use.sub(lambda _: lets[name], t) for t in texts]  # noqa: B023
                kept = [(k, use.sub(lambda _: lets[name], t)) for k, t in kept]  # noqa: B023
        return kept[::-1], texts

    def closed(self, body: str) -> str:
        """The body as one expression: each name is the variable of a lambda over one item."""
        steps, (text,) = self.steps(body)
        for name, expression in reversed(steps):
            text = f"transform(array({expression}), {name} -> {text})[0]"
        return text


# --- bounds of binary numbers ---


def _binary(value: Decimal, single: bool) -> float:
    return float(np.float32(str(value))) if single else float(value)


def _shortest(x: float, single: bool) -> Decimal:
    return Decimal(str(np.float32(x))) if single else Decimal(repr(x))


def _next(x: float, up: bool, single: bool) -> float:
    to = math.inf if up else -math.inf
    return float(np.nextafter(np.float32(x), np.float32(to))) if single else math.nextafter(x, to)


def nearest(bound: Decimal, above: bool, exclusive: bool, single: bool = False) -> float:
    """The least (above) or greatest DOUBLE or FLOAT whose shortest decimal meets the bound; an infinity if only that does."""

    def meets(x: float) -> bool:
        if math.isinf(x):
            return (x > 0) == above
        d = _shortest(x, single)
        return (d > bound if exclusive else d >= bound) if above else (d < bound if exclusive else d <= bound)

    with np.errstate(over="ignore"):
        x = _binary(bound, single)
        while not meets(x):
            x = _next(x, above, single)
        while not math.isinf(y := _next(x, not above, single)) and meets(y):
            x = y
    return x


def scaled(value: Decimal, digits: int, up: bool) -> Decimal:
    """The value rounded up or down to so many digits after the point."""
    return value.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_CEILING if up else ROUND_FLOOR, context=_WIDE)


def plain(value: Decimal) -> tuple[str, int, int]:
    """Text without an exponent, digits before the point, digits after it (without zeros at the end)."""
    text = f"{value:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    whole, _, fraction = text.lstrip("+-").partition(".")
    return text, len(whole.lstrip("0")), len(fraction)


def decimal(value: Decimal, digits: int = 20) -> str | None:
    """A DECIMAL(38, digits) literal, if the value is one."""
    text, whole, fraction = plain(value)
    return f"CAST('{text}' AS DECIMAL(38, {digits}))" if fraction <= digits and whole <= 38 - digits else None


LARGEST = 2**63


def compared_long(x: str, bound: Decimal, above: bool, exclusive: bool) -> str:
    n = int(scaled(bound, 0, above))
    n += (1 if above else -1) if exclusive and n == bound else 0
    if above:
        return "true" if n <= -LARGEST else "false" if n >= LARGEST else f"{x} >= {n}"
    return "true" if n >= LARGEST - 1 else "false" if n < -LARGEST else f"{x} <= {n}"


def compared_binary(x: str, kind: str, bound: Decimal, above: bool, exclusive: bool) -> str:
    b = nearest(bound, above, exclusive, kind == "FLOAT")
    literal = f"CAST('{b!r}' AS {kind})" if math.isfinite(b) else f"CAST('{'' if b > 0 else '-'}Infinity' AS {kind})"
    return f"({x} >= {literal} AND NOT isnan({x}))" if above else f"{x} <= {literal}"


def factors(of: Decimal) -> tuple[int, int, int]:
    """(least integer multiple, its part without factors 2 and 5, the highest power of either in it) of a positive decimal."""
    sign, digits, exponent = of.as_tuple()
    n, ten = int("".join(map(str, digits))) * 10 ** max(exponent, 0), 10 ** max(-exponent, 0)
    whole = n // math.gcd(n, ten)
    rest, most = whole, 0
    for prime in (2, 5):
        k = 0
        while rest % prime == 0:
            rest, k = rest // prime, k + 1
        most = max(most, k)
    return whole, rest, most


def multiple_long(x: str, of: Decimal) -> str:
    whole = factors(of)[0]
    return f"{x} = 0" if whole >= LARGEST else f"{x} % {whole} = 0"


def multiple_double(x: str, of: Decimal) -> Sql:
    """Whether the shortest decimal of a DOUBLE is a multiple."""
    whole, rest, most = factors(of)
    literal = decimal(of)
    if literal is None or whole >= 10**38:
        return UNDECIDED
    exact = f"try_cast({x} AS DECIMAL(38, 20))"
    small = f"coalesce(CAST({exact} AS DOUBLE) = {x} AND try_mod({exact}, {literal}) = 0, false)"
    large = f"coalesce(try_mod(try_cast({x} AS DECIMAL(38, 0)), CAST('{whole}' AS DECIMAL(38, 0))) = 0, false)"
    # From 1e38 on at most 17 digits are followed by 21 zeros or more.
    sure = most <= 21 and rest < LARGEST
    digits = f"try_cast(replace(split_part(CAST({x} AS STRING), 'E', 1), '.', '') AS BIGINT)"
    huge = f"coalesce({digits} % {rest} = 0, false)" if sure else "CAST(NULL AS BOOLEAN)"
    text = f"WHEN abs({x}) < 1e18 THEN {small} WHEN abs({x}) < 1e38 THEN {large} ELSE {huge} END"
    # Where decimals of 15 digits hold all multiples of 1 / 2^places, DOUBLEs are those multiples.
    places = next((j for j in range(15) if (of * 2**j) % 1 == 0), None)
    quick = f"WHEN abs({x}) < 1e{15 - places} THEN {x} % {float(of)!r}D = 0 " if places is not None and Decimal(float(of)) == of else ""
    return Sql(f"CASE {quick}{text}", not sure)


# --- values ---


class Value:
    """What a plan asks of a value. Answers that are only asked of one kind may be anything for others."""

    #: The kinds that it may still be where it is asked.
    known = EVERY_KIND

    def assuming(self, kinds: frozenset[str]) -> Value:
        """The value where it is of one of these kinds."""
        out = copy(self)
        out.known = self.known & kinds
        return out

    def is_kind(self, kinds: frozenset[str]) -> str:
        """Never NULL."""
        if self.known <= kinds:
            return "true"
        return self.kind_test(kinds & self.known) if kinds & self.known else "false"

    def kind_test(self, kinds: frozenset[str]) -> str:
        raise NotImplementedError


def only(kind: str) -> frozenset[str]:
    return frozenset((kind,))


class Variant(Value):
    """x: the name of a VARIANT that is not SQL NULL."""

    def __init__(self, x: str, scope: Scope) -> None:
        self.x, self.scope = x, scope

    @property
    def word(self) -> str:
        return self.scope.let(word(self.x))

    @property
    def map(self) -> str:
        return self.scope.let(as_map(self.x))

    @property
    def array(self) -> str:
        return self.scope.let(as_array(self.x))

    @property
    def text(self) -> str:
        return self.scope.let(as_text(self.x))

    def kind_test(self, kinds: frozenset[str]) -> str:
        tests = []
        if names := [n for k in TYPES if k in kinds for n in TYPES[k]]:
            tests.append(f"{self.word} IN ({', '.join(map(quoted, names))})")
        tests += [f"{self.map} IS NOT NULL"] if "object" in kinds else []
        tests += [f"{self.array} IS NOT NULL"] if "array" in kinds else []
        return either_text(tests)

    def is_boolean(self, value: bool) -> str:
        return f"coalesce({self.word} = 'BOOLEA' AND try_cast({self.x} AS BOOLEAN) = {str(value).lower()}, false)"

    def is_text(self, values: list[str]) -> str:
        return f"coalesce({both_text([self.is_kind(only('string')), f'{self.text} IN ({", ".join(map(quoted, values))})'])}, false)"

    def _tail(self, digits: int) -> str:
        """A DECIMAL's digits after so many behind the point."""
        return f"substring(split_part(to_json({self.x}), '.', 2), {digits + 1})"

    def _by_type(self, double: str, single: str, long: str, exact: str) -> str:
        return f"CASE {self.word} WHEN 'DOUBLE' THEN {double} WHEN 'BIGINT' THEN {long} WHEN 'DECIMA' THEN {exact} WHEN 'FLOAT' THEN {single} END"

    def _as(self, kind: str) -> str:
        return f"try_cast({self.x} AS {kind})"

    def compared(self, bound: Decimal, above: bool, exclusive: bool) -> Sql:
        text, whole, fraction = plain(bound)
        if whole > 38:  # no DECIMAL is as large
            exact, sure = str((bound < 0) == above).lower(), True
        elif whole + fraction > 38:
            exact, sure = "CAST(NULL AS BOOLEAN)", False
        else:
            digits = max(fraction, min(20, 38 - whole))
            r, literal = self._as(f"DECIMAL(38, {digits})"), f"CAST('{text}' AS DECIMAL(38, {digits}))"
            positive = f"({self._as('DOUBLE')} > 0)"
            beyond = f"{'' if above else 'NOT '}{positive}"
            # Rounded to the bound itself: what was cut off tells on which side the number is.
            side = f"({'' if above else 'NOT '}({positive} = ({self._tail(digits)} < '5')))"
            tie = f"CASE WHEN {self._tail(digits)} RLIKE '^0*$' THEN {str(not exclusive).lower()} ELSE {side} END"
            exact, sure = f"CASE WHEN {r} IS NULL THEN {beyond} WHEN {r} <> {literal} THEN {r} {'>' if above else '<'} {literal} ELSE {tie} END", True
        parts = [compared_binary(self._as(k), k, bound, above, exclusive) for k in ("DOUBLE", "FLOAT")]
        return Sql(self._by_type(*parts, compared_long(self._as("BIGINT"), bound, above, exclusive), exact), not sure)

    def is_number(self, value: Decimal) -> Sql:
        """Whether it is this number; false for other kinds."""
        text, whole, fraction = plain(value)
        long = f"{self._as('BIGINT')} = {text}" if not fraction and abs(value) < LARGEST else "false"
        parts = [long]
        for kind in ("DOUBLE", "FLOAT"):
            with np.errstate(over="ignore"):
                b = _binary(value, kind == "FLOAT")
            same = math.isfinite(b) and _shortest(b, kind == "FLOAT") == value
            parts.append(f"{self._as(kind)} = CAST('{b!r}' AS {kind})" if same else "false")
        exact = "false"
        if whole + fraction <= 38:
            digits = max(fraction, min(20, 38 - whole))
            exact = f"({self._as(f'DECIMAL(38, {digits})')} = CAST('{text}' AS DECIMAL(38, {digits})) AND {self._tail(digits)} RLIKE '^0*$')"
        return Sql(f"coalesce({self._by_type(parts[1], parts[2], parts[0], exact)}, false)")

    def integer(self) -> Sql:
        return Sql(self._by_type(f"{self._as('DOUBLE')} % 1D = 0", f"{self._as('DOUBLE')} % 1D = 0", "true", f"NOT (to_json({self.x}) RLIKE '[.]0*[1-9]')"))

    def multiple(self, of: Decimal) -> Sql:
        literal = decimal(of)
        if literal is None:
            return UNDECIDED
        whole, digits = factors(of)[0], plain(of)[2]
        double, single = multiple_double(self._as("DOUBLE"), of), multiple_double(f"try_cast({self.text} AS DOUBLE)", of)
        r = self._as(f"DECIMAL(38, {digits})")
        # More digits behind the point than the divisor has: no multiple.
        exact = f"CASE WHEN NOT ({self._tail(digits)} RLIKE '^0*$') THEN false ELSE try_mod({r}, CAST({literal} AS DECIMAL(38, {digits}))) = 0 END"
        return Sql(self._by_type(double.accept, single.accept, multiple_long(self._as("BIGINT"), of), exact), double.unsure or digits > 0 or whole >= 10**38)

    def n_items(self) -> str:
        return f"size({self.array})"

    def n_names(self) -> str:
        return f"size({self.map})"

    def item(self, i: int) -> Value:
        return Variant(self.scope.let(f"try_element_at({self.array}, {i + 1})"), self.scope)

    def items(self, start: int = 0) -> tuple[str, Callable[[str, Scope], Value]]:
        """The items from this one on, as an array, and what makes a value of a lambda's variable."""
        rest = f"slice({self.array}, {start + 1}, greatest({self.n_items()}, 1))" if start else self.array
        return rest, Variant

    def field(self, name: str) -> tuple[str, Value]:
        """(whether an object has it, its value)."""
        x = self.scope.let(f"try_element_at({self.map}, {quoted(name)})")
        return f"{x} IS NOT NULL", Variant(x, self.scope)

    def is_null_text(self) -> str:
        return f"is_variant_null({self.x})" if "null" in self.known else "false"

    def names(self) -> list[str] | None:
        """The names, if they are the same for all rows."""
        return None

    def keys(self) -> str:
        return f"map_keys({self.map})"

    def entries(self) -> tuple[str, Callable[[str, Scope], Value]]:
        """An array of (key, value), and what makes a value of an entry's."""
        return f"map_entries({self.map})", lambda v, scope: Variant(scope.let(f"{v}.value"), scope)

    def unique(self, variable: str) -> Sql:
        a, v = self.array, variable
        same = lambda kind: f"forall({a}, {v} -> {word(v)} = '{kind}')"
        distinct = f"size(array_distinct(transform({a}, {v} -> {as_text(v)}))) = size({a})"
        return Sql(f"CASE WHEN size({a}) < 2 THEN true WHEN {same('STRING')} OR {same('BIGINT')} THEN {distinct} END", True)


#: Kinds of typed values.
KIND_OF = {
    T.BooleanType: "boolean", T.StringType: "string", T.CharType: "string", T.VarcharType: "string", T.ByteType: "number", T.ShortType: "number", T.IntegerType: "number",
    T.LongType: "number", T.FloatType: "number", T.DoubleType: "number", T.DecimalType: "number", T.NullType: "null", T.StructType: "object", T.MapType: "object", T.ArrayType: "array",
}


class Typed(Value):
    """An expression of a plain type; nullable: it may be NULL, which is a JSON null."""

    def __init__(self, x: str, kind: T.DataType, nullable: bool, scope: Scope) -> None:
        self.x, self.type, self.nullable, self.scope = x, kind, nullable, scope
        self.kind = KIND_OF[type(kind)]
        if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
            raise Refused("only maps with string keys are objects")

        self.known = frozenset((self.kind, "null") if nullable else (self.kind,))

    def kind_test(self, kinds: frozenset[str]) -> str:
        return f"{self.x} IS NULL" if "null" in kinds else f"{self.x} IS NOT NULL"

    def _if(self, kind: str, test: str) -> str:
        if kind not in self.known or test == "false":
            return "false"
        return f"coalesce({test}, false)" if "null" in self.known else f"({test})"

    def is_boolean(self, value: bool) -> str:
        return self._if("boolean", self.x if value else f"NOT {self.x}")

    def is_text(self, values: list[str]) -> str:
        return self._if("string", f"{self.x} IN ({', '.join(map(quoted, values))})")

    @property
    def text(self) -> str:
        return self.x

    @property
    def binary(self) -> str | None:
        return {T.DoubleType: "DOUBLE", T.FloatType: "FLOAT"}.get(type(self.type))

    def compared(self, bound: Decimal, above: bool, exclusive: bool) -> Sql:
        if self.kind != "number":
            return NO
        if self.binary:
            return Sql(compared_binary(self.x, self.binary, bound, above, exclusive))
        if not isinstance(self.type, T.DecimalType):
            return Sql(compared_long(self.x, bound, above, exclusive))
        digits, whole = self.type.scale, self.type.precision - self.type.scale
        edge = scaled(bound, digits, above)
        exclusive = exclusive and edge == bound
        if plain(edge)[1] > whole:
            return Sql(str((edge < 0) == above).lower())
        return Sql(f"{self.x} {'>' if above else '<'}{'' if exclusive else '='} CAST('{plain(edge)[0]}' AS DECIMAL({self.type.precision}, {digits}))")

    def is_number(self, value: Decimal) -> Sql:
        if self.kind != "number":
            return NO
        text, whole, fraction = plain(value)
        if self.binary:
            with np.errstate(over="ignore"):
                b = _binary(value, self.binary == "FLOAT")
            same = math.isfinite(b) and _shortest(b, self.binary == "FLOAT") == value
            return Sql(self._if("number", f"{self.x} = CAST('{b!r}' AS {self.binary})" if same else "false"))
        if not isinstance(self.type, T.DecimalType):
            return Sql(self._if("number", f"{self.x} = {text}" if not fraction and abs(value) < LARGEST else "false"))
        fits = fraction <= self.type.scale and whole <= self.type.precision - self.type.scale
        return Sql(self._if("number", f"{self.x} = CAST('{text}' AS DECIMAL({self.type.precision}, {self.type.scale}))" if fits else "false"))

    def integer(self) -> Sql:
        if self.kind != "number":
            return NO
        if self.binary:
            return Sql(f"({self.x} % 1 = 0)")
        return Sql(f"({self.x} % 1 = 0)" if isinstance(self.type, T.DecimalType) and self.type.scale else "true")

    def multiple(self, of: Decimal) -> Sql:
        if self.kind != "number":
            return NO
        if self.binary:
            return multiple_double(self.x if self.binary == "DOUBLE" else f"CAST(CAST({self.x} AS STRING) AS DOUBLE)", of)
        if not isinstance(self.type, T.DecimalType):
            return Sql(f"({multiple_long(self.x, of)})")
        digits = max(self.type.scale, plain(of)[2])
        if self.type.precision - self.type.scale + digits > 38 or plain(of)[1] + digits > 38:
            return UNDECIDED
        return Sql(f"(CAST({self.x} AS DECIMAL(38, {digits})) % CAST('{plain(of)[0]}' AS DECIMAL(38, {digits})) = 0)")

    def n_items(self) -> str:
        return f"size({self.x})"

    def n_names(self) -> str:
        return str(len(self.type.fields)) if isinstance(self.type, T.StructType) else f"size({self.x})"

    def item(self, i: int) -> Value:
        if self.kind != "array":
            return self
        return value_of(f"try_element_at({self.x}, {i + 1})", self.type.elementType, True, self.scope)

    def items(self, start: int = 0) -> tuple[str, Callable[[str, Scope], Value]]:
        if self.kind != "array":
            return "array()", lambda v, scope: Typed(v, T.NullType(), True, scope)
        rest = f"slice({self.x}, {start + 1}, greatest({self.n_items()}, 1))" if start else self.x
        return rest, lambda v, scope: value_of(v, self.type.elementType, self.type.containsNull, scope)

    def field(self, name: str) -> tuple[str, Value]:
        if isinstance(self.type, T.StructType):
            found = next((f for f in self.type.fields if f.name == name), None)
            return ("true", value_of(f"{self.x}.`{name.replace('`', '``')}`", found.dataType, found.nullable, self.scope)) if found else ("false", self)
        if isinstance(self.type, T.MapType):
            return f"map_contains_key({self.x}, {quoted(name)})", value_of(f"try_element_at({self.x}, {quoted(name)})", self.type.valueType, True, self.scope)
        return "false", self

    def is_null_text(self) -> str:
        return self.is_kind(only("null"))

    def names(self) -> list[str] | None:
        return None if isinstance(self.type, T.MapType) else [f.name for f in self.type.fields] if isinstance(self.type, T.StructType) else []

    def keys(self) -> str:
        return f"map_keys({self.x})"

    def entries(self) -> tuple[str, Callable[[str, Scope], Value]]:
        return f"map_entries({self.x})", lambda v, scope: value_of(f"{v}.value", self.type.valueType, True, scope)

    def unique(self, variable: str) -> Sql:
        if self.kind != "array":
            return YES
        inner = self.type.elementType
        if any(isinstance(t, T.VariantType | T.MapType) or type(t) not in KIND_OF for t in _types(inner)):
            return Variant(self.scope.let(f"to_variant_object({self.x})"), self.scope).unique(variable)
        zero = isinstance(inner, T.DoubleType | T.FloatType)  # 0.0 and -0.0 are one number
        a = f"transform({self.x}, {variable} -> {variable} + 0)" if zero else self.x
        if not zero and any(isinstance(t, T.DoubleType | T.FloatType) for t in _types(inner)):
            return Variant(self.scope.let(f"to_variant_object({self.x})"), self.scope).unique(variable)
        return Sql(f"size(array_distinct({a})) = size({self.x})")


def _types(kind: T.DataType) -> Iterator[T.DataType]:
    yield kind
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _types(f.dataType)
    elif isinstance(kind, T.ArrayType):
        yield from _types(kind.elementType)
    elif isinstance(kind, T.MapType):
        yield from _types(kind.valueType)


def value_of(x: str, kind: T.DataType, nullable: bool, scope: Scope) -> Value:
    """A value of an expression; SQL NULL is a JSON null where it may be NULL."""
    if type(kind) in KIND_OF:
        folded = [f.name.lower() for f in kind.fields] if isinstance(kind, T.StructType) else []
        if len(set(folded)) == len(folded):  # names that only differ in case cannot be told apart in SQL
            return Typed(x, kind, nullable, scope)
    text = x if isinstance(kind, T.VariantType) else f"to_variant_object({x})" if isinstance(kind, T.StructType) else f"CAST({x} AS VARIANT)"
    return Variant(scope.let(f"coalesce({text}, parse_json('null'))" if nullable else text), scope)
