"""Schemas as terms of a predicate algebra over JSON values. Terms are immutable and compare by structure."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import cached_property
from typing import Any

from .values import EVERY_KIND, canonical, kind, plain


class Term:
    @property
    def kinds(self) -> frozenset[str]:
        """Kinds of which some value may satisfy the term: never too few."""
        return EVERY_KIND


@dataclass(frozen=True)
class Top(Term):
    pass


@dataclass(frozen=True)
class Bottom(Term):
    @property
    def kinds(self) -> frozenset[str]:
        return frozenset()


@dataclass(frozen=True)
class KindIs(Term):
    """The value is of one of these kinds; of numbers, only integers if asked for."""

    allowed: frozenset[str]
    integer: bool = False

    @property
    def kinds(self) -> frozenset[str]:
        return self.allowed


@dataclass(frozen=True)
class Equals(Term):
    """The value equals this one. Only its canonical form counts in comparisons."""

    shape: tuple
    value: Any = field(compare=False)

    @staticmethod
    def of(value: Any) -> Equals:
        return Equals(canonical(value), value)

    @property
    def kinds(self) -> frozenset[str]:
        return frozenset((self.shape[0],))

    @property
    def text(self) -> str:
        return plain(self.value)


@dataclass(frozen=True)
class Check(Term):
    """A keyword that values of other kinds than its guard satisfy."""

    guard: frozenset[str]
    keyword: str
    amount: int | Decimal | None = None
    text: str | None = None
    names: tuple[str, ...] = ()
    schema: Term | None = None
    most: int | None = None


@dataclass(frozen=True)
class Meta:
    """What a schema says about itself."""

    items: tuple[tuple[str, str], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.items)


@dataclass(frozen=True)
class Fields(Term):
    """Objects' declared properties, patterns and additional properties, as one schema object has them."""

    properties: tuple[tuple[str, Term], ...] = ()
    patterns: tuple[tuple[str, Term], ...] = ()
    additional: Term | None = None
    unevaluated: bool = False
    meta: tuple[tuple[str, Meta], ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Items(Term):
    """Arrays' leading items and the rest, as one schema object has them."""

    prefix: tuple[Term, ...] = ()
    rest: Term | None = None
    unevaluated: bool = False


@dataclass(frozen=True)
class Tag:
    """A declared discriminator: the property, and values with the reference each names."""

    name: str
    mapping: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Every(Term):
    parts: tuple[Term, ...]

    @cached_property
    def _kinds(self) -> frozenset[str]:
        out = EVERY_KIND
        for p in self.parts:
            out &= p.kinds
        return out

    @property
    def kinds(self) -> frozenset[str]:
        return self._kinds


@dataclass(frozen=True)
class _Union(Term):
    parts: tuple[Term, ...]
    tag: Tag | None = None

    @property
    def kinds(self) -> frozenset[str]:
        return frozenset().union(*(p.kinds for p in self.parts))


class Some(_Union):
    """At least one part holds."""


class Single(_Union):
    """Exactly one part holds."""


@dataclass(frozen=True)
class Nay(Term):
    part: Term

    @property
    def kinds(self) -> frozenset[str]:
        p = self.part
        return EVERY_KIND - p.allowed if isinstance(p, KindIs) and not p.integer else EVERY_KIND


@dataclass(frozen=True)
class Link(Term):
    """A reference; the target's kinds are known where it could be followed."""

    target: str
    found: frozenset[str] = field(default=EVERY_KIND, compare=False)
    known: bool = field(default=False, compare=False)

    @property
    def kinds(self) -> frozenset[str]:
        return self.found


@dataclass(frozen=True)
class DynamicLink(Term):
    target: str


def every(*parts: Term) -> Term:
    return parts[0] if len(parts) == 1 else Every(tuple(parts))


def kind_of_literal(t: Equals) -> str:
    return kind(t.value)
