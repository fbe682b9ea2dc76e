"""Plans: how a schema's values are stored, what is checked, and which branch a value takes.

A value is accepted if all checks and the route accept it; the storage shape never decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from enum import Enum, IntEnum
from functools import cached_property
from typing import TypeVar

from .source import Diagnostic
from .terms import Equals, Meta
from .values import EVERY_KIND


A = TypeVar("A")


class Capability(IntEnum):
    """What running the plan takes, from least to most."""

    DIRECT_TYPE = 0
    TYPE_WITH_VALIDATION = 1
    STATIC_DISPATCH = 2
    PREDICATE_DISPATCH = 3
    EVALUATION_STATE = 4
    DYNAMIC_RESOLUTION = 5
    UNSUPPORTED = 6


class Exactness(IntEnum):
    """How the plan's accepted values compare with the schema's."""

    EXACT_REPRESENTATION = 0
    EXACT_WITH_VALIDATION = 1
    OVER_APPROXIMATION = 2
    DECLARED_INCOMPLETE = 3
    UNSUPPORTED = 4


# --- storage shapes ---


class Shape:
    pass


@dataclass(frozen=True)
class AnyShape(Shape):
    pass


@dataclass(frozen=True)
class NoShape(Shape):
    pass


@dataclass(frozen=True)
class Scalar(Shape):
    kind: str
    integer: bool = False
    format: str = ""


@dataclass(frozen=True)
class Field:
    name: str
    plan: Plan
    required: bool
    nullable: bool
    meta: Meta = Meta()


@dataclass(frozen=True)
class Record(Shape):
    fields: tuple[Field, ...]
    additional: Plan
    patterns: tuple[tuple[str, Plan], ...] = ()


@dataclass(frozen=True)
class Sequence(Shape):
    prefix: tuple[Plan, ...]
    rest: Plan | None


@dataclass(frozen=True)
class Union(Shape):
    parts: tuple[Shape, ...]


@dataclass(frozen=True)
class Named(Shape):
    """A reference's target; recursive where the target leads back."""

    name: str
    recursive: bool = False


# --- predicates ---


class Predicate:
    keyword = ""


def _amount(word: str, kind: type = int) -> type:
    """A predicate of one amount."""
    return dataclass(frozen=True)(type(word[0].upper() + word[1:], (Predicate,), {"__annotations__": {"amount": kind}, "keyword": word, "__module__": __name__}))


MinLength, MaxLength = _amount("minLength"), _amount("maxLength")
MinItems, MaxItems = _amount("minItems"), _amount("maxItems")
MinProperties, MaxProperties = _amount("minProperties"), _amount("maxProperties")
MultipleOf = _amount("multipleOf", Decimal)


@dataclass(frozen=True)
class Integer(Predicate):
    keyword = "integer"


@dataclass(frozen=True)
class Pattern(Predicate):
    regex: str
    keyword = "pattern"


@dataclass(frozen=True)
class Format(Predicate):
    name: str
    keyword = "format"


@dataclass(frozen=True)
class Minimum(Predicate):
    amount: Decimal
    exclusive: bool = False
    keyword = "minimum"


@dataclass(frozen=True)
class Maximum(Predicate):
    amount: Decimal
    exclusive: bool = False
    keyword = "maximum"


@dataclass(frozen=True)
class UniqueItems(Predicate):
    keyword = "uniqueItems"


@dataclass(frozen=True)
class ContainsCount(Predicate):
    plan: Plan
    least: int
    most: int | None
    keyword = "contains"


@dataclass(frozen=True)
class Negation(Predicate):
    plan: Plan
    keyword = "not"


@dataclass(frozen=True)
class Conforms(Predicate):
    """The whole value satisfies another plan."""

    plan: Plan
    keyword = "schema"


@dataclass(frozen=True)
class ObjectStructure(Predicate):
    record: Record
    keyword = "properties"


@dataclass(frozen=True)
class ArrayStructure(Predicate):
    sequence: Sequence
    keyword = "items"


@dataclass(frozen=True)
class Reference(Predicate):
    name: str
    keyword = "$ref"


@dataclass(frozen=True)
class Required(Predicate):
    names: tuple[str, ...]
    keyword = "required"


@dataclass(frozen=True)
class DependentRequired(Predicate):
    name: str
    needs: tuple[str, ...]
    keyword = "dependentRequired"


@dataclass(frozen=True)
class PropertyNames(Predicate):
    plan: Plan
    keyword = "propertyNames"


PREDICATES = (
    Integer, MinLength, MaxLength, Pattern, Format, Minimum, Maximum, MultipleOf, MinItems, MaxItems, UniqueItems, ContainsCount,
    Negation, Conforms, ObjectStructure, ArrayStructure, Reference, Required, MinProperties, MaxProperties, DependentRequired, PropertyNames,
)


#: Predicates with plans inside.
NESTED = (ContainsCount, Negation, Conforms, ObjectStructure, ArrayStructure, Reference, PropertyNames)


@dataclass(frozen=True)
class Test:
    """A predicate for values of the guard's kinds. Without a predicate the kind itself is asserted."""

    guard: frozenset[str]
    predicate: Predicate | None = None


# --- routes ---


class Route:
    pass


@dataclass(frozen=True)
class Straight(Route):
    pass


@dataclass(frozen=True)
class ByKind(Route):
    cases: tuple[tuple[str, Plan], ...]


@dataclass(frozen=True)
class ByLiteral(Route):
    cases: tuple[tuple[Equals, Plan], ...]


@dataclass(frozen=True)
class ByProperty(Route):
    name: str
    cases: tuple[tuple[Equals, Plan], ...]
    source: str  # inferred, declared or asserted


@dataclass(frozen=True)
class ByPresence(Route):
    name: str
    present: Plan
    absent: Plan


@dataclass(frozen=True)
class ByCount(Route):
    branches: tuple[Plan, ...]
    least: int
    most: int


ROUTES = (Straight, ByKind, ByLiteral, ByProperty, ByPresence, ByCount)
SHAPES = (AnyShape, NoShape, Scalar, Record, Sequence, Union, Named)


@dataclass(frozen=True)
class Plan:
    shape: Shape
    tests: tuple[Test, ...] = ()
    route: Route = Straight()
    capability: Capability = Capability.DIRECT_TYPE
    refs: str = "resolved"  # resolved, static or dynamic
    meta: Meta = field(default=Meta(), compare=False)

    @cached_property
    def flat(self) -> bool:
        """Whether no other plan decides: all tests are of the value itself."""
        return isinstance(self.route, Straight) and not any(isinstance(x.predicate, NESTED) for x in self.tests)

    def residual(self) -> tuple[Test, ...]:
        """Tests that the storage shape does not imply."""
        return tuple(x for x in self.tests if not implied(self.shape, x.predicate))


def implied(shape: Shape, p: Predicate | None) -> bool:
    match p:
        case None:
            return True
        case Integer():
            return isinstance(shape, Scalar) and shape.integer
        case Reference(name):
            return isinstance(shape, Named) and shape.name == name
        case ObjectStructure(record):
            return record is shape or record == shape
        case ArrayStructure(sequence):
            return sequence is shape or sequence == shape
    return False


def predicate_plans(p: Predicate | None) -> Iterator[tuple[str, Plan]]:
    match p:
        case ContainsCount() | Negation() | Conforms() | PropertyNames():
            yield p.keyword, p.plan
        case ObjectStructure(r):
            yield from ((f"property {f.name}", f.plan) for f in r.fields)
            yield from ((f"pattern {n}", x) for n, x in r.patterns)
            yield "additional", r.additional
        case ArrayStructure(s):
            yield from ((f"item {i}", x) for i, x in enumerate(s.prefix))
            if s.rest:
                yield "items", s.rest
        case None:
            return
        case _ if not isinstance(p, PREDICATES):
            raise TypeError(f"unknown predicate {p!r}")


def route_plans(r: Route) -> Iterator[tuple[str, Plan]]:
    match r:
        case Straight():
            return
        case ByKind(cases):
            yield from ((f"kind {k}", p) for k, p in cases)
        case ByLiteral(cases):
            yield from ((f"value {e.text}", p) for e, p in cases)
        case ByProperty(name, cases):
            yield from ((f"{name} = {e.text}", p) for e, p in cases)
        case ByPresence(name, present, absent):
            yield f"with {name}", present
            yield f"without {name}", absent
        case ByCount(branches):
            yield from ((f"branch {i}", p) for i, p in enumerate(branches))
        case _:
            raise TypeError(f"unknown route {r!r}")


def children(plan: Plan) -> Iterator[tuple[str, Plan]]:
    """(edge, plan) of all plans directly inside: checks first, then the route."""
    for x in plan.tests:
        yield from predicate_plans(x.predicate)
    yield from route_plans(plan.route)


class Visit(Enum):
    """What a fold does after a plan: go inside, pass over what is inside, or end."""

    DESCEND = "descend"
    SKIP = "skip"
    STOP = "stop"


def fold(plan: Plan, start: A, step: Callable[[A, str, Plan], tuple[A, Visit]]) -> A:
    """step's result carried through the plan and all plans inside, each before those inside it, in order.

    step gets what was carried, the edges that lead to the plan, and the plan. Definitions are not entered:
    they are plans of their own.
    """
    carried, waiting = start, [("", plan)]
    while waiting:
        at, p = waiting.pop()
        carried, then = step(carried, at, p)
        if then is Visit.STOP:
            break
        if then is Visit.DESCEND:
            waiting += reversed([(f"{at}/{edge}", inner) for edge, inner in children(p)])
    return carried


def walk(plan: Plan) -> list[tuple[str, Plan]]:
    """The plan and all plans inside, with the edges that lead there."""

    def add(out: list, at: str, p: Plan) -> tuple[list, Visit]:
        out.append((at, p))
        return out, Visit.DESCEND

    return fold(plan, [], add)


def find(plan: Plan, good: Callable[[Plan], bool]) -> str | None:
    """The edges to the first plan that is good, or None."""

    def look(_: str | None, at: str, p: Plan) -> tuple[str | None, Visit]:
        return (at, Visit.STOP) if good(p) else (None, Visit.DESCEND)

    return fold(plan, None, look)


def references(plan: Plan) -> set[str]:
    return {x.predicate.name for _, p in walk(plan) for x in p.tests if isinstance(x.predicate, Reference)}


@dataclass(frozen=True)
class Need:
    """Something a consumer must take care of, at a place in the schema."""

    slot: str  # raw_evaluation, unbounded_numeric, json_equality, regex_dialect, evaluation_tracking
    pointer: str
    detail: str


@dataclass
class Compiled:
    """The analysis of one schema: its plan, the plans of what it refers to, and what there is to say about them."""

    plan: Plan
    definitions: dict[str, Plan]
    capability: Capability
    exactness: Exactness
    needs: list[Need]
    diagnostics: list[Diagnostic]

    def look_up(self, name: str) -> Plan:
        return self.definitions[name]


ANYTHING = Plan(AnyShape())
NOTHING = Plan(NoShape(), (Test(frozenset()),))
assert EVERY_KIND
