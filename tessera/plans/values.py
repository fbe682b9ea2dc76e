"""JSON values: decoding without loss, kinds, and equality."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from typing import Any

#: The six kinds; integers are numbers without a fraction.
KINDS = ("null", "boolean", "number", "string", "array", "object")
EVERY_KIND = frozenset(KINDS)


class InvalidValue(ValueError):
    """The input is not one JSON value."""


def decode(text: str) -> Any:
    """One JSON value; fractions and exponents as Decimal, integers as int. The last of repeated names counts."""

    def no(name: str) -> Any:
        raise InvalidValue(f"{name} is not JSON")

    try:
        return json.loads(text, parse_float=Decimal, parse_constant=no)
    except (ValueError, RecursionError) as e:
        raise InvalidValue(str(e)) from e


def kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float | Decimal):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list | tuple):
        return "array"
    if isinstance(value, dict):
        return "object"
    raise InvalidValue(f"{type(value).__name__} is not a JSON value")


def number(value: Any) -> Decimal:
    """The exact number; a float stands for its shortest decimal."""
    return Decimal(repr(value)) if isinstance(value, float) else Decimal(value)


def canonical(value: Any) -> tuple:
    """Equal for equal JSON values and hashable: kinds never mix, numbers by value, names in any order.

    One flat tuple, each part led by its kind and, if it has parts itself, their number.
    """
    out: list = []
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, _Name):
            out.append(v.text)
            continue
        k = kind(v)
        out.append(k)
        if k == "number":
            sign, digits, exponent = number(v).as_tuple()
            text = "".join(map(str, digits)).lstrip("0")
            short = text.rstrip("0")
            out += (sign, short, exponent + len(text) - len(short)) if short else (0, "", 0)
        elif k == "array":
            out.append(len(v))
            waiting += reversed(v)
        elif k == "object":
            out.append(len(v))
            for n in sorted(v, reverse=True):
                waiting += (v[n], _Name(n))
        else:
            out.append(v)
    return tuple(out)


@dataclass(frozen=True)
class _Name:
    text: str


def is_integer(value: Any) -> bool:
    if isinstance(value, int):
        return True
    shape = canonical(value)
    return shape[3] >= 0


class TooLarge(ArithmeticError):
    """Numbers so far apart that an exact remainder isn't worth its cost."""


def is_multiple(value: Any, of: Decimal) -> bool:
    """Exactly, in decimals."""
    v = number(value)
    if abs(v.adjusted()) > 2000 or abs(of.adjusted()) > 2000:
        raise TooLarge
    return Fraction(v) % Fraction(of) == 0


def plain(value: Any) -> str:
    """JSON text with numbers as written."""
    if isinstance(value, Decimal):
        return str(value).replace("E+", "e").replace("E", "e")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return json.dumps(value, ensure_ascii=False)
