"""Terms, plans and graphs as text and DOT."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

from . import model as m
from . import terms as t
from .source import Library
from .values import EVERY_KIND


def _kinds(kinds: frozenset[str]) -> str:
    return "any" if kinds == EVERY_KIND else "|".join(sorted(kinds)) or "none"


def term_text(x: t.Term, depth: int = 0) -> str:
    """A term as an indented tree."""
    pad = "  " * depth
    match x:
        case t.Top() | t.Bottom():
            return f"{pad}{type(x).__name__.lower()}"
        case t.KindIs(allowed, integer):
            return f"{pad}kind {_kinds(allowed)}{' integer' if integer else ''}"
        case t.Equals():
            return f"{pad}equals {x.text}"
        case t.Check():
            says = " ".join(str(v) for v in (x.amount, x.most, x.text, ",".join(x.names)) if v not in (None, ""))
            inner = f"\n{term_text(x.schema, depth + 1)}" if x.schema is not None else ""
            return f"{pad}{x.keyword} {says}".rstrip() + f" [{_kinds(x.guard)}]{inner}"
        case t.Fields():
            lines = [f"{pad}fields"]
            for label, group in (("property", x.properties), ("pattern", x.patterns)):
                lines += [f"{pad}  {label} {n}\n{term_text(s, depth + 2)}" for n, s in group]
            lines += [f"{pad}  additional\n{term_text(x.additional, depth + 2)}"] if x.additional is not None else []
            return "\n".join([*lines, *([f"{pad}  unevaluated"] if x.unevaluated else [])])
        case t.Items():
            lines = [f"{pad}items", *(f"{pad}  {i}\n{term_text(s, depth + 2)}" for i, s in enumerate(x.prefix))]
            lines += [f"{pad}  rest\n{term_text(x.rest, depth + 2)}"] if x.rest is not None else []
            return "\n".join([*lines, *([f"{pad}  unevaluated"] if x.unevaluated else [])])
        case t.Every(parts) | t._Union(parts):
            name = {"Every": "all", "Some": "any of", "Single": "one of"}[type(x).__name__]
            tag = f" by {x.tag.name}" if getattr(x, "tag", None) else ""
            return "\n".join([f"{pad}{name}{tag}", *(term_text(p, depth + 1) for p in parts)])
        case t.Nay(part):
            return f"{pad}not\n{term_text(part, depth + 1)}"
        case t.Link(target) | t.DynamicLink(target):
            return f"{pad}{'ref' if isinstance(x, t.Link) else 'dynamic ref'} {target}"
    raise TypeError(f"unknown term {x!r}")


def shape_text(s: m.Shape) -> str:
    match s:
        case m.AnyShape():
            return "any"
        case m.NoShape():
            return "nothing"
        case m.Scalar(kind, integer, fmt):
            return ("integer" if integer else kind) + (f"({fmt})" if fmt else "")
        case m.Record(fs, additional, patterns):
            names = [f.name + ("" if f.required else "?") + (" or null" if f.nullable else "") for f in fs] + [f"/{p}/" for p, _ in patterns]
            return "{" + ", ".join([*names, *([] if isinstance(additional.shape, m.NoShape) else ["..."])]) + "}"
        case m.Sequence(prefix, rest):
            return "[" + ", ".join([*(shape_text(p.shape) for p in prefix), *([] if rest is None or isinstance(rest.shape, m.NoShape) else [shape_text(rest.shape) + "..."])]) + "]"
        case m.Union(parts):
            return " | ".join(map(shape_text, parts))
        case m.Named(name):
            return f"ref {name}"
    raise TypeError(f"unknown shape {s!r}")


def _amounts(p: Any) -> str:
    return " ".join(str(v) for f in fields(p) if not is_dataclass(v := getattr(p, f.name)) and v is not None) if is_dataclass(p) else ""


def plan_text(p: m.Plan, depth: int = 0, label: str = "") -> str:
    """A plan as an indented tree: shape, tests, route, and the plans inside."""
    pad = "  " * depth
    lines = [f"{pad}{label + ': ' if label else ''}{shape_text(p.shape)} [{p.capability.name}{'' if p.refs == 'resolved' else ', ' + p.refs}]"]
    lines += [f"{pad}  | {k} {v}" for k, v in p.meta.items]
    for x in p.tests:
        what = f"is {_kinds(x.guard)}" if x.predicate is None else f"{x.predicate.keyword} {_amounts(x.predicate)}".rstrip() + f" [{_kinds(x.guard)}]"
        lines.append(f"{pad}  - {what}")
        lines += [plan_text(inner, depth + 2, edge) for edge, inner in m.predicate_plans(x.predicate)]
    if not isinstance(p.route, m.Straight):
        lines.append(f"{pad}  > {type(p.route).__name__}")
        lines += [plan_text(inner, depth + 2, edge) for edge, inner in m.route_plans(p.route)]
    return "\n".join(lines)


def compiled_text(c: m.Compiled) -> str:
    lines = [f"{c.capability.name} {c.exactness.name}", plan_text(c.plan)]
    lines += [f"\ndefinition {n}\n{plan_text(p)}" for n, p in sorted(c.definitions.items()) if p is not c.plan]
    lines += [f"{d.severity} {d.pointer or '/'}{f' ({d.line}:{d.column})' if d.line else ''}: {d.message}" for d in c.diagnostics]
    return "\n".join([*lines, *(f"needs {n.slot} {n.pointer or '/'}: {n.detail}" for n in c.needs)])


def _q(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def reference_dot(library: Library) -> str:
    """The schemas and their edges: solid where the instance is descended into, dashed where not; cycles green if guarded, else red."""
    kinds = library.recursion()
    color = {"guarded": "green", "unguarded": "red"}
    lines = ["digraph schemas {"]
    lines += [f"  {_q(k)}{f' [color={color[kinds[k]]}]' if k in kinds else ''};" for k in library.nodes]
    lines += [f"  {_q(a)} -> {_q(b)} [style={'solid' if d else 'dashed'}];" for a, b, d in library.edges]
    return "\n".join([*lines, "}"])


def route_edges(c: m.Compiled) -> list[tuple[str, str, str]]:
    """(from, to, label) of the plans inside a plan and inside all that it refers to.

    A plan is named by its place (`root`, then the edges that lead there), a definition by `ref` and its key;
    plans that allow anything are left out. A definition is entered once, one that is missing not at all.
    """
    out: list[tuple[str, str, str]] = []
    work, known = [("root", c.plan)], set()
    while work:
        start, plan = work.pop()
        waiting = [(start, plan)]
        while waiting:
            name, p = waiting.pop()
            for key in dict.fromkeys(x.predicate.name for x in p.tests if isinstance(x.predicate, m.Reference)):
                out.append((name, f"ref {key}", "refers to"))
                if key not in known:
                    known.add(key)
                    work += [(f"ref {key}", c.definitions[key])] if key in c.definitions else []
            inside = [(f"{name}/{edge}", edge, inner) for edge, inner in m.children(p) if inner != m.ANYTHING]
            out += [(name, below, edge) for below, edge, _ in inside]
            waiting += reversed([(below, inner) for below, _, inner in inside])
    return out


def route_dot(c: m.Compiled) -> str:
    """Those edges as a graph: routes bold, references dotted, definitions as boxes, one that is missing as an octagon."""
    edges = route_edges(c)
    names = dict.fromkeys(["root", *(n for a, b, _ in edges for n in (a, b))])
    plans = {"root": c.plan} | {f"ref {k}": p for k, p in c.definitions.items()}
    for a, b, label in edges:
        if label != "refers to":
            plans[b] = next(inner for edge, inner in m.children(plans[a]) if edge == label)
    routes = {(a, edge) for a, p in plans.items() for edge, _ in m.route_plans(p.route)}
    ids = {n: f"n{i}" for i, n in enumerate(names)}
    lines = ["digraph routes {"]
    for n, i in ids.items():
        shape = "octagon" if n not in plans else "box" if n[4:] in c.definitions else "ellipse"
        text = shape_text(plans[n].shape) if n in plans and n[4:] not in c.definitions else n.removeprefix("ref ")
        route = f" / {type(plans[n].route).__name__}" if n in plans and not isinstance(plans[n].route, m.Straight) else ""
        lines.append(f"  {i} [shape={shape}, label={_q(text + route)}];")
    lines += [f"  {ids[a]} -> {ids[b]} [label={_q(label)}{', style=dotted' if label == 'refers to' else ', style=bold' if (a, label) in routes else ''}];" for a, b, label in edges]
    return "\n".join([*lines, "}"])
