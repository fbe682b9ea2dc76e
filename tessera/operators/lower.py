"""Plans as Spark SQL expressions over VARIANTs or typed columns.

An expression is true, false, or NULL where only the exact evaluator can tell: recursion deeper than the
unrolled levels, items that are not comparable as they are, patterns that Java has no safe equivalent of.
What is used more than once (a field, its type) is computed once: as a column below, or as the variable
of a lambda over one item.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from itertools import count

from pyspark.sql import types as T

from ..functions import regex
from ..plans import interp
from ..plans import model as m
from ..plans.model import Plan
from ..plans.terms import Equals
from ..plans.values import EVERY_KIND
from .instance import NO, UNDECIDED, YES, Refused, Scope, Sql, Value, Variant, as_array, as_map, as_text, both_text, choice, either_text, only, quoted, value_of

#: Levels of a recursive reference that are written out, and the longest expression that is.
DEPTH, LONGEST = 3, 200_000
#: What branch() gives where only the exact evaluator can tell; no branch has this name.
UNKNOWN_BRANCH = "?"

# Storage types by format.
FORMATS = {"int32": "int", "int64": "bigint", "float": "float", "double": "double", "decimal": "decimal(38,18)", "date-time": "timestamp", "date": "date", "byte": "binary", "binary": "binary"}


class TooLong(Exception):
    """The expression would be too long; the exact evaluator runs the plan instead."""


def both(parts: list[Sql]) -> Sql:
    accept = both_text(p.accept for p in parts)
    if accept == "false":
        return NO
    return Sql(accept, any(p.unsure for p in parts), either_text(p.guess for p in parts))


def under(test: str, s: Sql, other: str = "true") -> Sql:
    """s where the test holds, else `other`."""
    if test == "false":
        return Sql(other)
    return Sql(choice(test, s.accept, other), s.unsure, both_text([test, s.guess]))


def of_kind(x: str, kinds: frozenset[str]) -> str:
    names = count()
    scope = Scope(lambda: f"kind{next(names)}")
    return scope.closed(Variant(x, scope).is_kind(kinds))


class Lowering:
    def __init__(self, compiled: m.Compiled, depth: int = DEPTH, longest: int = LONGEST, prefix: str = "x", flat: bool = False) -> None:
        self.compiled, self.depth, self.longest, self.prefix, self.flat, self.names = compiled, depth, longest, prefix, flat, 0
        self.open: list[str] = []  # references being written out
        self.scope = Scope(self.variable, flat)

    def variable(self) -> str:
        self.names += 1
        return f"{self.prefix}{self.names}"

    def checked(self, s: Sql) -> Sql:
        if len(s.accept) + sum(map(len, self.scope.by_text)) > self.longest:
            raise TooLong
        return s

    def plan(self, p: Plan, v: Value, active: tuple[str, ...] = ()) -> Sql:
        parts = []
        for t in sorted(p.tests, key=lambda t: t.predicate is not None):  # what is asserted of the kind holds for what follows
            test = v.is_kind(t.guard)
            if t.predicate is None:
                parts.append(Sql(test))
                v = v.assuming(t.guard)
            elif test != "false":
                parts.append(under(test, self.predicate(t.predicate, v.assuming(t.guard), active)))
        if not v.known:
            return NO
        return self.checked(both([*parts, self.route(p.route, v, active)]))

    def within(self, make: Callable[[str, Scope], Value], test: Callable[[str, Value], Sql]) -> tuple[str, Sql]:
        """(variable, test of a lambda's value by it), closed over what the test names."""
        v, scope = self.variable(), Scope(self.variable, self.flat)
        s = test(v, make(v, scope))
        return v, Sql(scope.closed(s.accept), s.unsure, scope.closed(s.guess))

    def each(self, array: str, v: str, s: Sql) -> Sql:
        """All items satisfy s."""
        accept = "true" if s.accept == "true" else f"forall({array}, {v} -> {s.accept})"
        return Sql(accept, s.unsure, "false" if s.guess == "false" else f"exists({array}, {v} -> {s.guess})")

    def predicate(self, p: m.Predicate, v: Value, active: tuple[str, ...]) -> Sql:
        match p:
            case m.Integer():
                return v.integer()
            case m.MinLength(n):
                return Sql(f"length({v.text}) >= {n}")
            case m.MaxLength(n):
                return Sql(f"length({v.text}) <= {n}")
            case m.MinItems(n):
                return Sql(f"{v.n_items()} >= {n}")
            case m.MaxItems(n):
                return Sql(f"{v.n_items()} <= {n}")
            case m.MinProperties(n):
                return Sql(f"{v.n_names()} >= {n}")
            case m.MaxProperties(n):
                return Sql(f"{v.n_names()} <= {n}")
            case m.Pattern(pattern):
                return self.matches(pattern, v.text)
            case m.Format():
                return Sql("true", guess="true")
            case m.Minimum(bound, exclusive):
                return v.compared(bound, True, exclusive)
            case m.Maximum(bound, exclusive):
                return v.compared(bound, False, exclusive)
            case m.MultipleOf(of):
                return v.multiple(of)
            case m.UniqueItems():
                return v.unique(self.variable())
            case m.ContainsCount(plan, least, most):
                a, make = v.items()
                x, s = self.within(make, lambda _, item: self.plan(plan, item))
                n = f"size(filter({a}, {x} -> coalesce({s.accept}, false)))"
                test = f"{n} >= {least}" if most is None else f"{n} BETWEEN {least} AND {most}"
                if s.unsure:
                    test = f"CASE WHEN exists({a}, {x} -> ({s.accept}) IS NULL) THEN NULL ELSE {test} END"
                return Sql(test, s.unsure, "false" if s.guess == "false" else f"exists({a}, {x} -> {s.guess})")
            case m.Negation(plan):
                s = self.plan(plan, v, active)
                return Sql(either_text([choice(s.accept, "false", "true") if s.accept in ("true", "false") else f"(NOT {s.accept})", s.guess]), s.unsure, s.guess)
            case m.Conforms(plan):
                return self.plan(plan, v, active)
            case m.ObjectStructure(record):
                return self.record(record, v)
            case m.ArrayStructure(sequence):
                return self.sequence(sequence, v)
            case m.Reference(name):
                if name in active:
                    raise Refused(f"{name} refers to itself on the same value")
                if self.open.count(name) >= self.depth:
                    return UNDECIDED
                self.open.append(name)
                try:
                    return self.plan(self.compiled.look_up(name), v, (*active, name))
                finally:
                    self.open.pop()
            case m.Required(names):
                return Sql(both_text(v.field(n)[0] for n in names))
            case m.DependentRequired(name, needs):
                return under(v.field(name)[0], Sql(both_text(v.field(n)[0] for n in needs)))
            case m.PropertyNames(plan):
                if (names := v.names()) is not None:
                    return both([self.named(plan, n) for n in names])
                x, s = self.within(lambda key, scope: value_of(key, T.StringType(), False, scope), lambda _, key: self.plan(plan, key))
                return self.each(v.keys(), x, s)
        raise TypeError(f"unknown predicate {p!r}")

    def named(self, plan: Plan, name: str) -> Sql:
        """The plan on a name that is known."""
        verdict = interp.interpret(m.Compiled(plan, self.compiled.definitions, m.Capability.DIRECT_TYPE, m.Exactness.EXACT_WITH_VALIDATION, [], []), name)
        return Sql("true", guess=str(bool(verdict.approximated)).lower()) if verdict.accepted else NO

    def matches(self, pattern: str, text: str) -> Sql:
        found = regex.translate(pattern)
        if found.python is None:
            return Sql("true", guess="true")
        if found.java is None or found.slow:
            return UNDECIDED
        return Sql(f"{text} RLIKE {quoted(found.java)}")

    def record(self, r: m.Record, v: Value) -> Sql:
        parts = []
        for f in r.fields:
            there, x = v.field(f.name)
            if there == "false":
                continue
            null = x.is_null_text() if f.nullable else "false"
            if null != "true":
                s = under("true" if null == "false" else f"NOT {null}", self.plan(f.plan, x.assuming(EVERY_KIND - only("null")) if f.nullable else x))
                parts.append(under(there, s))
        declared = {f.name for f in r.fields}
        if (names := v.names()) is not None:
            parts += [self.free(r, n, v.field(n)[1]) for n in names if n not in declared]
            return both(parts)
        if not r.patterns and r.additional == m.NOTHING:  # as many names as declared ones that are there
            own = " + ".join(f"CAST({v.field(n)[0]} AS INT)" for n in sorted(declared)) or "0"
            return both([*parts, Sql(f"{v.n_names()} = {own}")])
        array, make = v.entries()
        unsure = False

        def entry(x: str, value: Value) -> Sql:
            nonlocal unsure
            hits = [(self.matches(pattern, f"{x}.key"), plan) for pattern, plan in r.patterns]
            unknown = any(h.accept == "true" for h, _ in hits)  # undecidable: the name is claimed, its value not constrained
            unsure = any(h.unsure for h, _ in hits)
            known = [(h.accept, self.plan(plan, value)) for h, plan in hits if h.accept != "true" and not h.unsure]
            rest = Sql("true", guess="true") if unknown else self.plan(r.additional, value)
            own = under(both_text(f"NOT {h}" for h, _ in known), rest)
            s = both([*(under(h, s) for h, s in known), own])
            return under(f"{x}.key NOT IN ({', '.join(map(quoted, sorted(declared)))})", s) if declared else s

        x, s = self.within(make, entry)
        return UNDECIDED if unsure else both([*parts, self.each(array, x, s)])

    def free(self, r: m.Record, name: str, value: Value) -> Sql:
        """A name that is known and not declared: patterns that match it, else the rest."""
        parts, claimed = [], False
        for pattern, plan in r.patterns:
            hit = regex.search(pattern, name)
            claimed = claimed or hit is not False
            if hit:
                parts.append(self.plan(plan, value))
            elif hit is None:
                parts.append(Sql("true", guess="true"))
        return both(parts if claimed else [*parts, self.plan(r.additional, value)])

    def sequence(self, q: m.Sequence, v: Value) -> Sql:
        parts, size = [], v.n_items()
        parts += [under(f"{size} > {i}", self.plan(plan, v.item(i))) for i, plan in enumerate(q.prefix)]
        n = len(q.prefix)
        if q.rest is None:
            return both([*parts, Sql(f"{size} <= {n}")])
        array, make = v.items(n)
        return both([*parts, self.each(array, *self.within(make, lambda _, item: self.plan(q.rest, item)))])

    # --- routes ---

    def equal(self, e: Equals, v: Value) -> Sql:
        """Whether the value is the literal; never NULL."""
        k, value = e.shape[0], e.value
        is_kind = v.is_kind(only(k))
        if is_kind == "false":
            return NO
        if k == "null":
            return Sql(is_kind)
        if k == "boolean":
            return Sql(v.is_boolean(value))
        if k == "string":
            return Sql(v.is_text([value]))
        if k == "number":
            return v.is_number(Decimal(value))
        if k == "array":
            parts = [self.equal(Equals.of(x), v.item(i)) for i, x in enumerate(value)]
            return under(is_kind, both([Sql(f"{v.n_items()} = {len(value)}"), *parts]), "false")
        parts = [Sql(f"{v.n_names()} = {len(value)}")]
        for n, x in value.items():
            there, inner = v.field(n)
            parts.append(NO if there == "false" else under(there, self.equal(Equals.of(x), inner), "false"))
        return under(is_kind, both(parts), "false")

    def cases(self, cases: list[tuple[Sql, Sql]]) -> Sql:
        """The first case that holds decides; no case: false. A case that is undecided leaves all undecided, unless another one holds."""
        cases = [(c, s) for c, s in cases if c.accept != "false"]
        if not cases:
            return NO
        unsure = [c.accept for c, _ in cases if c.unsure]
        guess = either_text(both_text([c.accept, s.guess]) for c, s in cases if s.guess != "false")
        if cases[0][0].accept == "true":
            return Sql(cases[0][1].accept, cases[0][1].unsure, cases[0][1].guess)
        text = "CASE " + " ".join(f"WHEN {c.accept} THEN {s.accept}" for c, s in cases)
        text += (f" WHEN {' OR '.join(f'({u}) IS NULL' for u in unsure)} THEN NULL" if unsure else "") + " ELSE false END"
        return Sql(text, bool(unsure) or any(s.unsure for _, s in cases), guess)

    def route(self, r: m.Route, v: Value, active: tuple[str, ...]) -> Sql:
        match r:
            case m.Straight():
                return YES
            case m.ByKind(cases):
                parts = [(k, self.plan(p, v.assuming(only(k)), active)) for k, p in cases if k in v.known]
                free = frozenset(k for k, s in parts if s == YES)
                tests = [(Sql(v.is_kind(only(k))), s) for k, s in parts if k not in free]
                # What is left when the others are told apart needs no test.
                rest = v.assuming(EVERY_KIND - {k for k, _ in parts if k not in free})
                return self.cases([*tests, (Sql(rest.is_kind(free)), YES)])
            case m.ByLiteral(cases):
                return self.literals(cases, v, active)
            case m.ByProperty(name, cases):
                there, at = v.field(name)
                test = both_text([v.is_kind(only("object")), there])
                if test == "false":
                    return NO
                v = v.assuming(only("object"))
                return under(test, self.cases([(self.equal(e, at), self.plan(p, v, active)) for e, p in cases]), "false")
            case m.ByPresence(name, present, absent):
                there = v.field(name)[0]
                return self.cases([(Sql(both_text([v.is_kind(only("object")), there])), self.plan(present, v, active)), (YES, self.plan(absent, v, active))])
            case m.ByCount(branches, least, most):
                parts = [self.plan(p, v, active) for p in branches]
                unsure, guess = any(p.unsure for p in parts), either_text(p.guess for p in parts)
                if least == 1 and most >= len(parts):
                    return Sql(either_text(p.accept for p in parts) if len(set(parts)) == len(parts) else "(" + " OR ".join(p.accept for p in parts) + ")", unsure, guess)
                return Sql(f"({' + '.join(f'CAST({p.accept} AS INT)' for p in parts)}) BETWEEN {least} AND {most}", unsure, guess)
        raise TypeError(f"unknown route {r!r}")

    def literals(self, cases: tuple[tuple[Equals, Plan], ...], v: Value, active: tuple[str, ...]) -> Sql:
        texts = [e.value for e, _ in cases if e.shape[0] == "string"]
        # A literal's own plan often only repeats that the value is the literal.
        if len(texts) == len(cases) and all(isinstance(p.shape, m.Scalar | m.AnyShape) and isinstance(p.route, m.Straight) and all(t.predicate is None for t in p.tests) for _, p in cases):
            return Sql(v.is_text(texts))
        return self.cases([(self.equal(e, v), self.plan(p, v.assuming(only(e.shape[0])), active)) for e, p in cases if e.shape[0] in v.known])


@dataclass(frozen=True)
class Lowered:
    """A plan's expression with the columns that it needs below it: lists of (name, SQL), each over those before."""

    accept: str
    unsure: bool
    steps: tuple[tuple[tuple[str, str], ...], ...] = ()

    def closed(self) -> str:
        """All in one expression."""
        text = self.accept
        for name, expression in reversed([x for level in self.steps for x in level]):
            text = f"transform(array({expression}), {name} -> {text})[0]"
        return text


def levels(steps: list[tuple[str, str]]) -> tuple[tuple[tuple[str, str], ...], ...]:
    """Steps by how many others they build on."""
    depth: dict[str, int] = {}
    for name, text in steps:
        depth[name] = 1 + max((depth[n] for n in depth if n in text and re.search(rf"\b{n}\b", text)), default=-1)
    return tuple(tuple(s for s in steps if depth[s[0]] == k) for k in range(max(depth.values(), default=-1) + 1))


def checked_plan(compiled: m.Compiled) -> None:
    if compiled.capability >= m.Capability.EVALUATION_STATE:
        raise Refused(f"{compiled.capability.name}: " + "; ".join(d.message for d in compiled.diagnostics if d.severity == "error"))


def lowered(compiled: m.Compiled, x: str, kind: T.DataType | None = None, depth: int = DEPTH, prefix: str = "x", flat: bool = False) -> Lowered:
    """The plan on an expression (a VARIANT, or of the type given) that is not SQL NULL. Plans that cannot be run soundly are refused."""
    checked_plan(compiled)
    low = Lowering(compiled, depth, prefix=prefix, flat=flat)
    try:
        s = low.plan(compiled.plan, value_of(x, kind or T.VariantType(), False, low.scope))
        steps, (accept,) = low.scope.steps(s.accept)
        if len(accept) > LONGEST:
            raise TooLong
    except (TooLong, RecursionError):
        return Lowered(UNDECIDED.accept, True)
    return Lowered(accept, s.unsure, levels(steps))


def branch(compiled: m.Compiled, x: str, kind: T.DataType | None = None, prefix: str = "x", flat: bool = False) -> Lowered:
    """An expression that names the root route's branch; NULL if none is taken, UNKNOWN_BRANCH if only the exact evaluator can tell."""
    checked_plan(compiled)
    low, r = Lowering(compiled, prefix=prefix, flat=flat), compiled.plan.route
    v = value_of(x, kind or T.VariantType(), False, low.scope)

    def case(tests: list[tuple[Sql, str]]) -> Sql:
        tests = [(t, n) for t, n in tests if t.accept != "false"]
        unsure = [t.accept for t, _ in tests if t.unsure]
        text = " ".join(f"WHEN {t.accept} THEN {quoted(n)}" for t, n in tests) + (f" WHEN {' OR '.join(f'({u}) IS NULL' for u in unsure)} THEN '{UNKNOWN_BRANCH}'" if unsure else "")
        return Sql(f"CASE {text} END" if tests else "CAST(NULL AS STRING)", bool(unsure))

    match r:
        case m.Straight():
            s = Sql("'-'")
        case m.ByKind(cases):
            s = case([(Sql(v.is_kind(only(k))), k) for k, _ in cases])
        case m.ByLiteral(cases):
            s = case([(low.equal(e, v), e.text) for e, _ in cases])
        case m.ByProperty(name, cases):
            there, at = v.field(name)
            test = both_text([v.is_kind(only("object")), there])
            inner = case([(low.equal(e, at), e.text) for e, _ in cases] if test != "false" else [])
            s = Sql(choice(test, inner.accept, "CAST(NULL AS STRING)"), inner.unsure)
        case m.ByPresence(name):
            s = Sql(choice(both_text([v.is_kind(only("object")), v.field(name)[0]]), quoted("with " + name), quoted("without " + name)))
        case m.ByCount(branches):
            parts = [low.plan(p, v) for p in branches]
            taken = ", ".join(f"CASE WHEN {p.accept} THEN '{i}' END" for i, p in enumerate(parts))
            hits = f"nullif(array_join(array({taken}), ','), '')"
            unknown = [f"({p.accept}) IS NULL" for p in parts if p.unsure]
            s = Sql(choice(either_text(unknown), quoted(UNKNOWN_BRANCH), hits) if unknown else hits, bool(unknown))
        case _:
            raise TypeError(f"unknown route {r!r}")
    steps, (accept,) = low.scope.steps(s.accept)
    return Lowered(accept, s.unsure, levels(steps))


# --- storage ---


def storage_type(compiled: m.Compiled, shape: m.Shape, bounds: tuple[m.Test, ...] = ()) -> str:
    """The Spark type that the shape is stored as."""
    match shape:
        case m.Scalar("boolean"):
            return "boolean"
        case m.Scalar("number", integer, fmt):
            if fmt in FORMATS:
                return FORMATS[fmt]
            low = [t.predicate.amount for t in bounds if isinstance(t.predicate, m.Minimum)]
            high = [t.predicate.amount for t in bounds if isinstance(t.predicate, m.Maximum)]
            fits = low and high and min(low) >= -(2**63) and max(high) < 2**63
            return ("bigint" if fits else "decimal(38,0)") if integer else "double"
        case m.Scalar("string", _, fmt):
            return FORMATS.get(fmt, "string")
        case m.Sequence(prefix, rest):
            item = "variant" if rest is None else storage_type(compiled, rest.shape, rest.tests)
            if not prefix:
                return f"array<{item}>"
            return "struct<" + ", ".join([*(f"_{i}: {storage_type(compiled, p.shape, p.tests)}" for i, p in enumerate(prefix)), f"_rest: array<{item}>"]) + ">"
        case m.Record(fields, additional, patterns):
            extra = "variant" if isinstance(additional.shape, m.NoShape) else storage_type(compiled, additional.shape, additional.tests)
            if not fields and not patterns:
                return f"map<string, {extra}>"
            parts = [f"`{f.name}`: {storage_type(compiled, f.plan.shape, f.plan.tests)}" for f in fields]
            parts += [f"_pattern_{i}: map<string, {storage_type(compiled, p.shape, p.tests)}>" for i, (_, p) in enumerate(patterns)]
            parts += [] if isinstance(additional.shape, m.NoShape) else [f"_additional: map<string, {extra}>"]
            parts += ["_present: array<string>"] if any(f.nullable and not f.required for f in fields) else []
            return "struct<" + ", ".join(parts) + ">"
        case m.Named(name, recursive):
            target = compiled.definitions.get(name)
            return "variant" if recursive or target is None else storage_type(compiled, target.shape, target.tests)
    return "variant"


def stored(compiled: m.Compiled, plan: Plan, x: str, low: Lowering | None = None) -> str:
    """An expression that gives the value in its storage type; NULL for what doesn't fit it."""
    low = low or Lowering(compiled)
    kind = storage_type(compiled, plan.shape, plan.tests)
    match plan.shape:
        case m.Scalar(k) if kind != "variant":
            if kind == "binary":
                return f"CASE WHEN {of_kind(x, frozenset((k,)))} THEN try_to_binary({as_text(x)}, 'base64') END"
            return f"CASE WHEN {of_kind(x, frozenset((k,)))} THEN try_cast({x} AS {kind}) END"
        case m.Sequence(prefix, rest):
            v, a, n = low.variable(), as_array(x), len(prefix)
            item = v if rest is None else stored(compiled, rest, v, low)
            if not prefix:
                return f"transform({a}, {v} -> {item})"
            parts = [f"'_{i}', {stored(compiled, p, f'try_element_at({a}, {i + 1})', low)}" for i, p in enumerate(prefix)]
            return f"CASE WHEN {a} IS NOT NULL THEN named_struct({', '.join(parts)}, '_rest', transform(slice({a}, {n + 1}, greatest(size({a}), 1)), {v} -> {item})) END"
        case m.Record(fields, additional, patterns):
            a, v = as_map(x), low.variable()
            free = isinstance(additional.shape, m.NoShape)
            value = f"{v}" if free else stored(compiled, additional, v, low)
            if not fields and not patterns:
                return f"transform_values({a}, (k, {v}) -> {value})"
            names = ", ".join(quoted(f.name) for f in fields)
            parts = [f"{quoted(f.name)}, {stored(compiled, f.plan, f'try_element_at({a}, {quoted(f.name)})', low)}" for f in fields]
            taken = [f"k IN ({names})"] if names else []
            for i, (pattern, p) in enumerate(patterns):
                hit = low.matches(pattern, "k").accept
                parts.append(f"'_pattern_{i}', transform_values(map_filter({a}, (k, y) -> {hit} AND NOT ({' OR '.join(taken[:1]) or 'false'})), (k, {v}) -> {stored(compiled, p, v, low)})")
                taken.append(hit)
            if not free:
                parts.append(f"'_additional', transform_values(map_filter({a}, (k, y) -> NOT ({' OR '.join(taken) or 'false'})), (k, {v}) -> {value})")
            if any(f.nullable and not f.required for f in fields):
                parts.append(f"'_present', map_keys(map_filter({a}, (k, y) -> k IN ({names})))")
            return f"CASE WHEN {a} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
        case m.Named(name, recursive) if not recursive and name in compiled.definitions:
            return stored(compiled, compiled.definitions[name], x, low)
        case m.NoShape():
            return "CAST(NULL AS VARIANT)"
    return x
