"""Entry points: a schema text, one component, or a document of components, to plans."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from . import model as m
from .model import Capability, Exactness
from .planner import Planner, exactness
from .simplify import BUDGET
from .source import BadSchema, Diagnostic, Library, Loader, about, parse, pointer_step, positions


@dataclass(frozen=True)
class Options:
    base_uri: str = ""
    budget: int = BUDGET  # steps of distribution; 0 stands for the default
    loader: Loader | None = None


def table_loader(documents: dict[str, str | bytes]) -> Loader:
    """A loader that knows these documents only."""

    def load(uri: str) -> str | bytes:
        return documents[uri]

    return load


#: Frames for schemas within schemas; deeper ones are refused.
FRAMES = 60_000


def deep(compile_):
    """compile_() with room for schemas nested some hundreds deep; deeper ones are bad schemas."""

    @wraps(compile_)
    def run(*given, **named):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, FRAMES))
        try:
            return compile_(*given, **named)
        except RecursionError as e:
            raise BadSchema("the schema is nested too deeply") from e
        finally:
            sys.setrecursionlimit(before)

    return run


@deep
def compile_schema(text: str | bytes | dict | bool, options: Options = Options()) -> m.Compiled:
    """The analysis of a schema: JSON or YAML text, or a parsed one. Only input that cannot be read is an error."""
    source = None
    if isinstance(text, str | bytes):
        source = text.decode() if isinstance(text, bytes) else text
        text = parse(source)
    library = Library(options.loader)
    root = library.add_document(options.base_uri, text)
    library.resolve()
    out = _Assembly(library, options).compiled(root.key)
    return _placed(out, source)


@deep
def compile_document(document: dict | str | bytes, options: Options = Options()) -> dict[str, m.Compiled]:
    """The analysis of every component (components/schemas of an OpenAPI document, $defs, or a plain map), in order of pointers."""
    source = None
    if isinstance(document, str | bytes):
        source = document.decode() if isinstance(document, bytes) else document
        document = parse(source)
    if not isinstance(document, dict):
        raise BadSchema("a document is an object")
    components = (document.get("components") or {}).get("schemas") if "components" in document else None
    at = "/components/schemas" if components is not None else "/$defs" if "$defs" in document else ""
    named = components if components is not None else document.get("$defs", document)
    library = Library(options.loader)
    library.documents[options.base_uri] = document
    keys = {}
    for name, raw in named.items():
        pointer = at + pointer_step(name)
        keys[name] = library._add(options.base_uri, options.base_uri, pointer, raw, [(options.base_uri, "")]).key
    library.resolve()
    assembly = _Assembly(library, options)
    return {name: _placed(assembly.compiled(key), source) for name, key in sorted(keys.items())}


def compile_component(document: dict, name: str, options: Options = Options()) -> m.Compiled:
    """The analysis of one component without its siblings: references to them stay unresolved."""
    raw = (document.get("components") or {}).get("schemas", document.get("$defs", document))[name]
    return compile_schema(raw, options)


def _placed(c: m.Compiled, source: str | None) -> m.Compiled:
    """Diagnostics with lines and columns, where the text is at hand."""
    if not source or not c.diagnostics:
        return c
    try:
        where = positions(source)
    except Exception:  # noqa: BLE001  positions are only a help
        return c
    c.diagnostics = [replace(d, line=where.get(d.pointer, (0, 0))[0], column=where.get(d.pointer, (0, 0))[1]) for d in c.diagnostics]
    return c


@dataclass
class _Assembly:
    library: Library
    options: Options
    plans: dict[str, m.Plan] = field(default_factory=dict)
    exact: dict[str, Exactness] = field(default_factory=dict)
    said: dict[str, list[Diagnostic]] = field(default_factory=dict)
    needs: dict[str, list[m.Need]] = field(default_factory=dict)

    def plan(self, key: str) -> m.Plan:
        if key not in self.plans:
            node = self.library.nodes[key]
            p = Planner(self.library, node, self.options.budget or BUDGET)
            plan = p.compile(key)
            self.plans[key] = replace(plan, meta=about(node.raw))
            self.exact[key] = exactness(plan, p.gaps)
            self.said[key], self.needs[key] = p.diagnostics, p.needs
        return self.plans[key]

    def compiled(self, key: str) -> m.Compiled:
        """The root with all it reaches; its level and exactness are the worst of them."""
        reached, work = [], [key]
        broken: list[Diagnostic] = []
        while work:
            k = work.pop()
            if k in reached:
                continue
            if k not in self.library.nodes:
                broken.append(Diagnostic("error", self.library.nodes[key].pointer, f"reference {k} names no compiled schema"))
                continue
            reached.append(k)
            work += sorted(m.references(self.plan(k)), reverse=True)
        level = Capability.UNSUPPORTED if broken else max(self.plans[k].capability for k in reached)
        worst = max(self.exact[k] for k in reached)
        if level >= Capability.EVALUATION_STATE:
            worst = Exactness.UNSUPPORTED
        found = [*broken, *self.library.found, *(d for k in reached for d in self.said[k])]
        found += [Diagnostic("warning", self.library.nodes[k].pointer, "uninhabited: every value would need another of itself") for k in self.library.uninhabited()]
        needs = sorted({n for k in reached for n in self.needs[k]}, key=lambda n: (n.slot, n.pointer, n.detail))
        return m.Compiled(self.plans[key], {k: self.plans[k] for k in reached}, level, worst, needs, list(dict.fromkeys(found)))


Compile = Callable[[Any], m.Compiled]
