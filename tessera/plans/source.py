"""Schema documents: parsing, keyword ingestion, references and their graph."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin, uses_relative

from . import terms as t
from .values import EVERY_KIND, InvalidValue, decode, kind, plain

try:  # YAML schemas need PyYAML; JSON ones don't
    import yaml
except ImportError:
    yaml = None

# Where schemas are nested, by how the keyword holds them.
ONE = frozenset("additionalProperties contains contentSchema else if items not propertyNames then unevaluatedItems unevaluatedProperties".split())
MANY = frozenset("allOf anyOf oneOf prefixItems".split())
NAMED = frozenset("$defs dependentSchemas patternProperties properties".split())
#: Keywords that lead into a part of the instance: a cycle through one of them ends with the instance.
DESCENT = frozenset("prefixItems items contains properties patternProperties additionalProperties unevaluatedProperties unevaluatedItems".split())
COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
TYPES = {"null": "null", "boolean": "boolean", "number": "number", "integer": "number", "string": "string", "array": "array", "object": "object"}
NUMBER_FORMATS = frozenset("int32 int64 float double decimal".split())
ABOUT = ("title", "description", "deprecated", "readOnly", "writeOnly", "default", "examples", "xml")
OBJECT, ARRAY, STRING, NUMBER = (frozenset((k,)) for k in ("object", "array", "string", "number"))


class BadSchema(ValueError):
    """The document cannot be read as a schema."""


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # error, warning or info
    pointer: str
    message: str
    line: int = 0
    column: int = 0


def parse(text: str | bytes) -> Any:
    """A JSON or YAML document; numbers keep every digit."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    if not text.strip():
        raise BadSchema("the document is empty")
    try:
        return decode(text)
    except InvalidValue as e:
        if yaml is None or text.lstrip()[:1] in "{[":
            if yaml is None:
                raise BadSchema(f"not JSON ({e}); YAML needs PyYAML") from e
    try:
        return _from_yaml(yaml.compose(text, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise BadSchema(f"neither JSON nor YAML: {e}") from e


def _from_yaml(node: Any) -> Any:
    """A composed YAML tree as JSON values; numeric text is kept as a Decimal."""
    if isinstance(node, yaml.MappingNode):
        return {k.value: _from_yaml(v) for k, v in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_from_yaml(v) for v in node.value]
    tag = node.tag.rpartition(":")[2]
    if tag == "null":
        return None
    if tag == "bool":
        return node.value.lower() in ("true", "yes", "on")
    if tag == "int":
        return int(node.value.replace("_", ""), 0)
    if tag == "float":
        return Decimal(node.value.replace("_", ""))
    return node.value


def pointer_step(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def joined(base: str, ref: str) -> str:
    """The address of a reference, for any scheme with paths; urllib only joins those that it knows."""
    scheme, colon, rest = base.partition("://")
    if not colon or scheme.lower() in uses_relative:
        return urljoin(base, ref)
    out = urljoin(f"http://{rest}", ref)
    return out if not out.startswith("http://") or ref.startswith("http://") else f"{scheme}://{out.removeprefix('http://')}"


@dataclass
class Node:
    """A schema object or boolean at a place in a document."""

    uri: str  # of the document, without fragment
    base: str  # against which references inside are resolved
    pointer: str
    raw: Any
    children: dict[str, Any] = field(default_factory=dict)
    target: str | None = None  # key of what $ref leads to

    @property
    def key(self) -> str:
        return f"{self.uri}#{self.pointer}"


def nested(raw: Any) -> Iterator[tuple[str, str, Any]]:
    """(keyword, pointer from the schema, schema) of the schemas directly inside."""
    if not isinstance(raw, dict):
        return
    for word, value in raw.items():
        if word in ONE and isinstance(value, dict | bool):
            yield word, pointer_step(word), value
        elif word in MANY and isinstance(value, list):
            for i, s in enumerate(value):
                yield word, f"/{word}/{i}", s
        elif word in NAMED and isinstance(value, dict):
            for name, s in value.items():
                yield word, f"/{word}{pointer_step(name)}", s


Loader = Callable[[str], bytes | str]


class Library:
    """All schemas that a root reaches, by absolute address, with their edges and findings."""

    def __init__(self, loader: Loader | None = None) -> None:
        self.loader = loader
        self.nodes: dict[str, Node] = {}
        self.anchors: dict[str, str] = {}
        self.aliases: dict[str, str] = {}  # addresses below an $id -> key
        self.found: list[Diagnostic] = []
        self.edges: list[tuple[str, str, bool]] = []  # from, to, descent
        self.targets: set[str] = set()
        self.failed: dict[str, str] = {}
        self.documents: dict[str, Any] = {}
        self._terms: dict[str, t.Term] = {}

    def add_document(self, uri: str, raw: Any, at: str = "") -> Node:
        uri = urldefrag(uri)[0]
        self.documents.setdefault(uri, raw)
        return self._add(uri, uri, at, raw, [(uri, at)])

    def _add(self, uri: str, base: str, pointer: str, raw: Any, frames: list[tuple[str, str]]) -> Node:
        if not isinstance(raw, dict | bool):
            raise BadSchema(f"{uri}#{pointer}: a schema is an object or a boolean")
        key = f"{uri}#{pointer}"
        if key in self.nodes:
            return self.nodes[key]
        if isinstance(raw, dict) and isinstance(raw.get("$id"), str):
            base = joined(base, urldefrag(raw["$id"])[0])
            frames = [*frames, (base, pointer)]
        node = self.nodes[key] = Node(uri, base, pointer, raw)
        for frame, start in frames:
            self.aliases.setdefault(f"{frame}#{pointer.removeprefix(start)}", key)
        if isinstance(raw, dict):
            for word in ("$anchor", "$dynamicAnchor"):
                if isinstance(raw.get(word), str):
                    self.anchors.setdefault(f"{base}#{raw[word]}", key)
        for word, step, inner in nested(raw):
            child = self._add(uri, base, pointer + step, inner, frames)
            node.children[step] = child
            self.edges.append((key, child.key, word in DESCENT))
        return node

    def resolve(self) -> None:
        """Follow every $ref, loading documents as needed, until nothing new appears. References that lead nowhere are findings."""
        done: set[str] = set()
        while pending := [n for k, n in self.nodes.items() if k not in done]:
            for node in pending:
                done.add(node.key)
                ref = node.raw.get("$ref") if isinstance(node.raw, dict) else None
                if isinstance(ref, str):
                    self._follow(node, ref)

    def _follow(self, node: Node, ref: str) -> None:
        address = joined(node.base, ref) if node.base else ref
        document, fragment = urldefrag(address)
        if not ref.startswith("#") or node.base:
            document = document or node.base
        else:
            document = node.uri
        key = self._look_up(document, fragment)
        if key is None and document not in self.documents and document not in {n.base for n in self.nodes.values()}:
            self._load(document)
            key = self._look_up(document, fragment)
        if key is None:
            why = self.failed.get(document, "nothing is at that address")
            self.found.append(Diagnostic("error", node.pointer, f"unresolved $ref {ref}: {why}"))
            return
        node.target = key
        self.targets.add(key)
        self.edges.append((node.key, key, False))

    def _load(self, uri: str) -> None:
        if uri in self.failed:
            return
        if self.loader is None:
            self.failed[uri] = "there is no loader"
            return
        try:
            self.add_document(uri, parse(self.loader(uri)))
        except Exception as e:  # noqa: BLE001  a loader may fail in any way; that is a finding
            self.failed[uri] = f"{type(e).__name__}: {e}"

    def _look_up(self, document: str, fragment: str) -> str | None:
        if fragment and not fragment.startswith("/"):
            return self.anchors.get(f"{document}#{fragment}")
        pointer = unquote(fragment)
        key = self.aliases.get(f"{document}#{pointer}")
        if key is None and document in self.documents:
            # A place that no schema keyword leads to may still be referred to.
            value = self.documents[document]
            for step in pointer.split("/")[1:]:
                step = step.replace("~1", "/").replace("~0", "~")
                if isinstance(value, dict) and step in value:
                    value = value[step]
                elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
                    value = value[int(step)]
                else:
                    return None
            if isinstance(value, dict | bool):
                key = self._add(document, document, pointer, value, [(document, "")]).key
        return key

    # --- the graph ---

    def strong_components(self) -> list[list[str]]:
        """Cycles of the graph (Tarjan, without recursion)."""
        after: dict[str, list[str]] = {}
        loops = set()
        for a, b, _ in self.edges:
            after.setdefault(a, []).append(b)
            if a == b:
                loops.add(a)
        order: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        on: set[str] = set()
        out = []
        for root in self.nodes:
            if root in order:
                continue
            work = [(root, iter(after.get(root, ())))]
            order[root] = low[root] = len(order)
            stack.append(root)
            on.add(root)
            while work:
                v, rest = work[-1]
                for w in rest:
                    if w not in order:
                        order[w] = low[w] = len(order)
                        stack.append(w)
                        on.add(w)
                        work.append((w, iter(after.get(w, ()))))
                        break
                    if w in on:
                        low[v] = min(low[v], order[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == order[v]:
                        part = []
                        while True:
                            w = stack.pop()
                            on.discard(w)
                            part.append(w)
                            if w == v:
                                break
                        if len(part) > 1 or v in loops:
                            out.append(part)
        return out

    def recursion(self) -> dict[str, str]:
        """key -> guarded or unguarded, of the nodes on cycles. A cycle is guarded if none is left without its descents."""
        out = {}
        for part in self.strong_components():
            inside = set(part)
            left = Library()
            left.nodes = {k: self.nodes[k] for k in part}
            left.edges = [(a, b, d) for a, b, d in self.edges if a in inside and b in inside and not d]
            bad = {k for p in left.strong_components() for k in p}
            out |= {k: "unguarded" if bad else "guarded" for k in part}
        return out

    def uninhabited(self) -> list[str]:
        """Keys of schemas on cycles that require a value of themselves (a least fixpoint: what has a finite value)."""
        finite: set[str] = set()
        changed = True
        while changed:
            changed = False
            for k, n in self.nodes.items():
                if k not in finite and self._has_value(n, finite):
                    finite.add(k)
                    changed = True
        return [k for k in self.recursion() if k not in finite and self._needs_itself(k)]

    def _needs_itself(self, key: str) -> bool:
        raw = self.nodes[key].raw
        return isinstance(raw, dict) and raw.get("type") == "object" and bool(raw.get("required"))

    def _has_value(self, n: Node, finite: set[str]) -> bool:
        if not isinstance(n.raw, dict):
            return n.raw is True
        if n.target and n.target not in finite:
            return False
        ok = lambda step: step not in n.children or n.children[step].key in finite
        if any(not ok(f"/allOf/{i}") for i in range(len(n.raw.get("allOf") or ()))):
            return False
        for word in ("anyOf", "oneOf"):
            parts = n.raw.get(word)
            if isinstance(parts, list) and parts and not any(ok(f"/{word}/{i}") for i in range(len(parts))):
                return False
        if n.raw.get("type") == "object":
            return all(ok(f"/properties{pointer_step(p)}") for p in n.raw.get("required") or () if isinstance(p, str))
        return True

    # --- terms ---

    def term(self, key: str) -> t.Term:
        if key not in self._terms:
            self._terms[key] = self._compile(self.nodes[key])
        return self._terms[key]

    def kinds_behind(self, key: str, seen: frozenset[str] = frozenset()) -> frozenset[str]:
        """Kinds of a reference's target, through further references; every kind on a cycle without descent."""
        if key in seen:
            return EVERY_KIND
        raw, n = self.nodes[key].raw, self.nodes[key]
        if isinstance(raw, bool):
            return EVERY_KIND if raw else frozenset()
        out, seen = self._own_kinds(raw), seen | {key}
        if n.target:
            out &= self.kinds_behind(n.target, seen)
        for i in range(len(raw.get("allOf") or ())):
            out &= self.kinds_behind(n.children[f"/allOf/{i}"].key, seen)
        for word in ("anyOf", "oneOf"):
            if isinstance(raw.get(word), list) and raw[word]:
                out &= frozenset().union(*(self.kinds_behind(n.children[f"/{word}/{i}"].key, seen) for i in range(len(raw[word]))))
        return out

    def _own_kinds(self, raw: dict) -> frozenset[str]:
        out = EVERY_KIND
        if "type" in raw:
            out = frozenset(TYPES[x] for x in _types(raw) if x in TYPES)
        if "const" in raw:
            out &= {kind(raw["const"])}
        if isinstance(raw.get("enum"), list):
            out &= {kind(x) for x in raw["enum"]}
        return out

    def _finding(self, n: Node, severity: str, message: str) -> None:
        d = Diagnostic(severity, n.pointer, message)
        if d not in self.found:
            self.found.append(d)

    def _compile(self, n: Node) -> t.Term:
        raw = n.raw
        if isinstance(raw, bool):
            return t.Top() if raw else t.Bottom()
        inner = lambda step: self.term(n.children[step].key) if step in n.children else None
        listed = lambda word: tuple(inner(f"/{word}/{i}") for i in range(len(raw.get(word) or ())))
        out: list[t.Term] = []
        if "type" in raw:
            names = _types(raw)
            if raw.get("nullable") is True:
                names = [*names, "null"]
            kinds = frozenset(TYPES[x] for x in names if x in TYPES)
            out.append(t.KindIs(kinds, "integer" in names and "number" not in names) if kinds else t.Bottom())
        elif raw.get("nullable") is True:
            self._finding(n, "warning", "nullable has no effect without a type beside it")
        if "const" in raw:
            out.append(t.Equals.of(raw["const"]))
        if isinstance(raw.get("enum"), list):
            members = tuple(dict.fromkeys(t.Equals.of(x) for x in raw["enum"]))
            out.append(members[0] if len(members) == 1 else t.Some(members) if members else t.Bottom())
        out += self._scalars(n)
        out += self._arrays(n, inner, listed)
        out += self._objects(n, inner)
        if n.target:
            out.append(t.Link(n.target, self.kinds_behind(n.target), True))
        elif isinstance(raw.get("$ref"), str):
            out.append(t.Link(raw["$ref"]))
        if isinstance(raw.get("$dynamicRef"), str):
            out.append(t.DynamicLink(raw["$dynamicRef"]))
        tag = self._tag(n)
        if isinstance(raw.get("allOf"), list):
            out += listed("allOf")
        if isinstance(raw.get("anyOf"), list):
            out.append(t.Some(listed("anyOf"), tag))
        if isinstance(raw.get("oneOf"), list):
            out.append(t.Single(listed("oneOf"), tag))
        if (no := inner("/not")) is not None:
            out.append(t.Nay(no))
        if (test := inner("/if")) is not None and ("then" in raw or "else" in raw):
            yes, no = inner("/then") or t.Top(), inner("/else") or t.Top()
            out.append(t.Some((t.every(test, yes), t.every(t.Nay(test), no))))
        return t.Every(tuple(out)) if len(out) != 1 else out[0] if out else t.Top()

    def _tag(self, n: Node) -> t.Tag | None:
        d = n.raw.get("discriminator")
        if not isinstance(d, dict):
            return None
        if not isinstance(n.raw.get("oneOf"), list) and not isinstance(n.raw.get("anyOf"), list):
            self._finding(n, "warning", "discriminator has no oneOf or anyOf beside it and is not used")
            return None
        mapping = d.get("mapping") if isinstance(d.get("mapping"), dict) else {}
        name = d.get("propertyName")
        return t.Tag(name if isinstance(name, str) else "", tuple((str(k), str(v)) for k, v in mapping.items()))

    def _amount(self, n: Node, word: str) -> int | None:
        """A count keyword's value; others than whole numbers from 0 up are findings."""
        value = n.raw.get(word)
        if word not in n.raw:
            return None
        if kind(value) == "number" and value == int(value) >= 0:
            return int(value)
        self._finding(n, "error", f"{word}: {plain(value)} is not a non-negative integer; the keyword is ignored")
        return None

    def _bound(self, n: Node, word: str) -> Decimal | None:
        value = n.raw.get(word)
        if word not in n.raw or isinstance(value, bool):
            return None
        if kind(value) == "number":
            return Decimal(value) if not isinstance(value, float) else Decimal(repr(value))
        self._finding(n, "error", f"{word}: {plain(value)} is not a number; the keyword is ignored")
        return None

    def _dropped(self, n: Node, word: str) -> bool:
        return word in n.raw and any(d.pointer == n.pointer and d.message.startswith(f"{word}:") for d in self.found)

    def _scalars(self, n: Node) -> list[t.Term]:
        raw, out = n.raw, []
        for word in ("minLength", "maxLength"):
            if (k := self._amount(n, word)) is not None:
                out.append(t.Check(STRING, word, k))
        if isinstance(raw.get("pattern"), str):
            out.append(t.Check(STRING, "pattern", text=raw["pattern"]))
        if isinstance(raw.get("format"), str):
            out.append(t.Check(NUMBER if raw["format"] in NUMBER_FORMATS else STRING, "format", text=raw["format"]))
        for word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            if (b := self._bound(n, word)) is None:
                continue
            if word == "multipleOf" and b <= 0:
                self._finding(n, "error", f"multipleOf: {b} is not above 0; the keyword is ignored")
                continue
            out.append(t.Check(NUMBER, word, b))
        if any(self._dropped(n, w) for w in (*COUNTS, "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")):
            out.append(t.Check(EVERY_KIND, "dropped"))
        return out

    def _arrays(self, n: Node, inner: Callable, listed: Callable) -> list[t.Term]:
        raw, out = n.raw, []
        if any(w in raw for w in ("items", "prefixItems", "unevaluatedItems")):
            out.append(t.Items(listed("prefixItems"), inner("/items"), "unevaluatedItems" in raw))
        for word in ("minItems", "maxItems"):
            if (k := self._amount(n, word)) is not None:
                out.append(t.Check(ARRAY, word, k))
        if raw.get("uniqueItems") is True:
            out.append(t.Check(ARRAY, "uniqueItems"))
        if (has := inner("/contains")) is not None:
            least, most = self._amount(n, "minContains"), self._amount(n, "maxContains")
            out.append(t.Check(ARRAY, "contains", 1 if least is None else least, schema=has, most=most))
        return out

    def _objects(self, n: Node, inner: Callable) -> list[t.Term]:
        raw, out = n.raw, []
        if any(w in raw for w in ("properties", "patternProperties", "additionalProperties", "unevaluatedProperties")):
            group = lambda word: tuple((k, inner(f"/{word}{pointer_step(k)}")) for k in (raw.get(word) or {}))
            meta = tuple((k, about(s)) for k, s in (raw.get("properties") or {}).items())
            out.append(t.Fields(group("properties"), group("patternProperties"), inner("/additionalProperties"), "unevaluatedProperties" in raw, meta))
        if isinstance(raw.get("required"), list) and raw["required"]:
            out.append(t.Check(OBJECT, "required", names=tuple(dict.fromkeys(raw["required"]))))
        for word in ("minProperties", "maxProperties"):
            if (k := self._amount(n, word)) is not None:
                out.append(t.Check(OBJECT, word, k))
        for name, needs in (raw.get("dependentRequired") or {}).items():
            if needs:
                out.append(t.Check(OBJECT, "dependentRequired", text=name, names=tuple(needs)))
        if (names := inner("/propertyNames")) is not None:
            out.append(t.Check(OBJECT, "propertyNames", schema=names))
        for name in raw.get("dependentSchemas") or {}:
            has = t.every(t.KindIs(OBJECT), t.Check(OBJECT, "required", names=(name,)))
            out.append(t.Some((t.Nay(has), t.every(has, inner(f"/dependentSchemas{pointer_step(name)}")))))
        return out


def _types(raw: dict) -> list:
    return raw["type"] if isinstance(raw["type"], list) else [raw["type"]]


def about(raw: Any) -> t.Meta:
    """A schema's annotations and x- extensions as JSON text."""
    if not isinstance(raw, dict):
        return t.Meta()
    return t.Meta(tuple((k, plain(v)) for k, v in raw.items() if k in ABOUT or re.match("x-", k)))


def positions(text: str) -> dict[str, tuple[int, int]]:
    """pointer -> (line, column) of each value of a JSON or YAML text; empty without PyYAML."""
    if yaml is None:
        return {}
    out: dict[str, tuple[int, int]] = {}
    work = [("", yaml.compose(text, Loader=yaml.SafeLoader))]
    while work:
        at, node = work.pop()
        out[at] = (node.start_mark.line + 1, node.start_mark.column + 1)
        if isinstance(node, yaml.MappingNode):
            work += [(at + pointer_step(k.value), v) for k, v in node.value]
        elif isinstance(node, yaml.SequenceNode):
            work += [(f"{at}/{i}", v) for i, v in enumerate(node.value)]
    return out


def dump_json(value: Any) -> str:
    return json.dumps(value, default=str)
