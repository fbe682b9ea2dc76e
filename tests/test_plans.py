"""Compiling and the exact evaluator."""

import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import regex
from tessera.plans import dump, interp, model, source
from tessera.plans import terms as t
from tessera.plans.compiler import Options, compile_document, compile_schema, table_loader
from tessera.plans.model import Capability, Exactness
from tessera.plans.simplify import disjoint, implies, simplify
from tessera.plans.values import InvalidValue, canonical, decode, is_multiple

from .cases import ACCEPTANCE, CLASSES


def verdict(schema, text):
    return interp.interpret(compile_schema(schema), decode(text))


@pytest.mark.parametrize("schema,good,bad", ACCEPTANCE)
def test_acceptance(schema, good, bad):
    assert all(verdict(schema, x).accepted for x in good)
    for x in bad:
        v = verdict(schema, x)
        assert not v.accepted and v.reasons


@pytest.mark.parametrize("schema,capability,exactness,reported", CLASSES)
def test_classes(schema, capability, exactness, reported):
    c = compile_schema(schema)
    assert c.capability == Capability[capability]
    assert exactness is None or c.exactness == Exactness[exactness]
    assert not reported or c.diagnostics


def test_reasons_and_approximations():
    v = verdict('{"properties":{"a":{"items":{"minimum":3}}}}', '{"a":[3,4,1]}')
    assert [(r.path, r.constraint) for r in v.reasons][:2] == [("/a/2", "minimum"), ("/a/2", "items")]
    assert verdict('{"format":"email"}', '"x"').approximated == ["/: format email"]
    assert verdict('{"properties":{"a/b~c":{"type":"null"}}}', '{"a/b~c":1}').reasons[0].path == "/a~1b~0c"
    v = verdict('{"not":{"type":"string","format":"email"}}', '"x"')
    assert v.accepted and v.approximated


def test_refuses_what_it_cannot_run():
    for schema in ('{"type":"object","unevaluatedProperties":false}', '{"$dynamicRef":"#m"}', '{"$ref":"#/nowhere"}'):
        with pytest.raises(interp.BrokenPlan):
            verdict(schema, "{}")
    with pytest.raises(source.BadSchema):
        compile_schema("")
    with pytest.raises(source.BadSchema):
        compile_schema("[1]")


def test_diagnostics():
    says = lambda s: [(d.severity, d.pointer) for d in compile_schema(s).diagnostics]
    assert ("error", "") in says('{"minLength":-1}') and ("error", "") in says('{"maxItems":1.5}') and says('{"minLength":2.0}') == []
    assert ("warning", "") in says('{"nullable":true}') and says('{"type":"string","nullable":true}') == []
    assert ("warning", "") in says('{"discriminator":{"propertyName":"t"}}')
    assert ("error", "/properties/a") in says('{"properties":{"a":{"$ref":"#/$defs/x"}}}')
    assert any(d.message.startswith("uninhabited") for d in compile_schema('{"$defs":{"N":{"type":"object","required":["n"],"properties":{"n":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}').diagnostics)
    assert not any(d.message.startswith("uninhabited") for d in compile_schema('{"$defs":{"N":{"type":"object","properties":{"n":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}').diagnostics)
    assert compile_schema('{"minLength":-1}').exactness == Exactness.DECLARED_INCOMPLETE
    assert not verdict('{"type":"string","nullable":true}', "1").accepted and verdict('{"type":"string","nullable":true}', "null").accepted


def test_references_across_documents():
    load = table_loader({"http://x/b.json": '{"$id":"http://x/b.json","$defs":{"n":{"$anchor":"num","type":"number"},"s":{"$ref":"a.json"}},"$ref":"#num"}', "http://x/a.json": '{"type":"string"}'})
    c = compile_schema('{"properties":{"n":{"$ref":"b.json"},"m":{"$ref":"b.json#/$defs/n"},"s":{"$ref":"b.json#/$defs/s"}}}', Options("http://x/root.json", loader=load))
    run = lambda x: interp.interpret(c, decode(x)).accepted
    assert run('{"n":1,"m":2,"s":"x"}') and not run('{"n":"x"}') and not run('{"m":"x"}') and not run('{"s":1}')
    assert c.capability < Capability.UNSUPPORTED
    assert compile_schema('{"$ref":"http://y/z"}').capability == Capability.UNSUPPORTED


def test_addresses_of_any_scheme():
    assert source.joined("mem://a/b.json", "c.json#x") == "mem://a/c.json#x" and source.joined("mem://b.json", "c.json") == "mem://b.json/c.json"
    assert source.joined("http://x/a", "/b") == "http://x/b" and source.joined("mem://a/b", "http://y/z") == "http://y/z" and source.joined("mem://a/b", "urn:z") == "urn:z"


def test_same_pointer_in_two_documents():
    load = table_loader({"http://x/b.json": '{"$defs":{"n":{"type":"number"}}}'})
    c = compile_schema('{"$defs":{"n":{"type":"string"}},"properties":{"a":{"$ref":"#/$defs/n"},"b":{"$ref":"http://x/b.json#/$defs/n"}}}', Options("http://x/a.json", loader=load))
    run = lambda x: interp.interpret(c, decode(x)).accepted
    assert run('{"a":"x","b":1}') and not run('{"a":1}') and not run('{"b":"x"}')


def test_documents():
    doc = {"components": {"schemas": {"Pet": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "owner": {"$ref": "#/components/schemas/Owner"}}}, "Owner": {"type": "object", "properties": {"pets": {"type": "array", "items": {"$ref": "#/components/schemas/Pet"}}}}}}}
    found = compile_document(doc)
    assert list(found) == ["Owner", "Pet"] and all(c.capability < Capability.EVALUATION_STATE for c in found.values())
    assert not interp.interpret(found["Owner"], decode('{"pets":[{"owner":{}}]}')).accepted


def test_yaml_and_positions():
    pytest.importorskip("yaml")
    c = compile_schema("type: object\nproperties:\n  a:\n    minLength: -1\n    multipleOf: 0.10\n")
    assert [(d.line, d.pointer) for d in c.diagnostics] == [(4, "/properties/a")]
    assert interp.interpret(c, decode('{"a":0.3}')).accepted and not interp.interpret(c, decode('{"a":0.35}')).accepted


def test_discriminators():
    defs = '"$defs":{"A":{"type":"object","required":["t"],"properties":{"t":{"const":"a"}}},"B":{"type":"object","required":["t"],"properties":{"t":{"type":"string"}}}}'
    c = compile_schema('{%s,"oneOf":[{"$ref":"#/$defs/A"},{"$ref":"#/$defs/B"}],"discriminator":{"propertyName":"t","mapping":{"a":"A","b":"#/$defs/B"}}}' % defs)
    assert isinstance(c.plan.route, model.ByProperty) and c.plan.route.source == "asserted" and c.exactness == Exactness.OVER_APPROXIMATION
    assert interp.branch(c, {"t": "b"}) == '"b"' and interp.branch(c, {"t": "z"}) is None
    c = compile_schema('{%s,"oneOf":[{"$ref":"#/$defs/A"},{"$ref":"#/$defs/B"}],"discriminator":{"propertyName":"t","mapping":{"a":"nowhere"}}}' % defs)
    assert any("cannot be used" in d.message for d in c.diagnostics)


def test_a_gap_inside_nested_negations_is_seen():
    c = compile_schema('{"not":{"not":{"not":{"type":"string","minLength":-1}},"type":"string"}}')
    assert c.exactness == Exactness.DECLARED_INCOMPLETE and interp.interpret(c, "x").accepted


def test_simplify_rules():
    s, n = t.KindIs(frozenset(("string",))), t.KindIs(frozenset(("number",)))
    low = lambda k: t.Check(frozenset(("number",)), "minimum", Decimal(k))
    assert simplify(t.Every((s, n))) == t.Bottom() and simplify(t.Nay(t.Nay(s))) == s
    assert simplify(t.Every((low(1), low(2), t.Top()))) == low(2)
    assert simplify(t.Single((s, n))) == t.Some((s, n)) and simplify(t.Single((s, s))) == t.Bottom()
    assert simplify(t.Every((s, low(1)))) == s
    assert simplify(t.Every((t.Equals.of(1), t.Equals.of(Decimal("1.0"))))) == t.Equals.of(1)
    assert disjoint(t.Equals.of("a"), t.Equals.of("b")) and implies(t.Equals.of("a"), s)


def test_budget_keeps_unions_factored():
    parts = ",".join('{"anyOf":[{"type":"string"},{"type":"number"}]}' for _ in range(3))
    assert interp.interpret(compile_schema('{"allOf":[%s],"minLength":2}' % parts, Options(budget=1)), "ab").accepted


def test_values():
    assert canonical(decode("1e2")) == canonical(decode("100")) == canonical(decode("100.00")) and canonical(decode("-0")) == canonical(decode("0"))
    assert canonical(decode('{"a":1,"b":[1]}')) == canonical(decode('{"b":[1.0],"a":1}')) and canonical(True) != canonical(1)
    assert is_multiple(Decimal("0.0075"), Decimal("0.0001")) and not is_multiple(Decimal("0.00751"), Decimal("0.0001"))
    for bad in ("1 2", "", "{", "NaN", "[1,]"):
        with pytest.raises(InvalidValue):
            decode(bad)


@pytest.mark.parametrize(
    "pattern,text,expected",
    [("^a$", "a\n", False), (r"^\s$", "\u00a0", True), (r"^\s$", "\ufeff", True), (r"^\S$", "x", True), (r"^\w$", "é", False), (r"^\d$", "٣", False), (r"\u0041", "A", True), (r"[\d-z]", "-", True), (r"^[^\s]$", " ", False),
     (r"\p{Letter}", "é", True), (r"^\p{Script=Greek}$", "α", True), ("(?<=a)b", "ab", True), (r"\bfoo\b", "a foo!", True), (".", "\u2028", False), ("[", "x", None), (r"(a)\1", "aa", None), (r"\cJ", "\n", True), ("a{2,3}?b", "aab", True), ("[]", "x", False), ("[^]", "\n", True), (r"^\/$", "/", True)],
)
def test_patterns(pattern, text, expected):
    assert regex.search(pattern, text) is expected


def test_patterns_that_backtrack_end_in_time():
    import time

    began = time.time()
    assert regex.search("^(a+)+$", "a" * 64 + "!") is not True and regex.search("^(a|a|b)*c$", "a" * 40 + "!") is not True
    assert time.time() - began < 10 and regex.translate("^(a+)+$").slow


def test_every_variant_has_a_way():
    """Each predicate, route and shape appears in some plan and is handled by all that walk plans."""
    seen = set()
    for schema, *_ in ACCEPTANCE + CLASSES:
        c = compile_schema(schema)
        for _, p in model.walk(c.plan):
            seen |= {type(p.shape), type(p.route), *(type(x.predicate) for x in p.tests if x.predicate)}
        assert dump.compiled_text(c) and dump.route_dot(c).endswith("}")
    assert seen >= set(model.PREDICATES) and seen >= set(model.ROUTES) and seen >= set(model.SHAPES)


# --- random schemas ---

KEYWORDS = {
    "type": st.sampled_from(["string", "number", "integer", "object", "array", "null", "boolean", ["string", "null"], ["integer", "number"]]),
    "minLength": st.integers(0, 3), "maxLength": st.integers(0, 3), "minimum": st.integers(-2, 3), "exclusiveMaximum": st.integers(-2, 3), "multipleOf": st.sampled_from([1, 2, 0.5]),
    "minItems": st.integers(0, 2), "uniqueItems": st.just(True), "required": st.lists(st.sampled_from("ab"), max_size=2), "maxProperties": st.integers(0, 2),
    "enum": st.lists(st.sampled_from([1, "a", None, True, [1], {"a": 1}]), min_size=1, max_size=3), "const": st.sampled_from([1, "ab", None]), "pattern": st.sampled_from(["^a", "b$", r"\d"]),
}


def schemas(depth=2):
    base = st.fixed_dictionaries({}, optional=KEYWORDS)
    if not depth:
        return base | st.booleans()
    inner = schemas(depth - 1)
    named = st.dictionaries(st.sampled_from("ab"), inner, max_size=2)
    more = {"properties": named, "additionalProperties": inner, "patternProperties": st.dictionaries(st.just("^a"), inner, max_size=1), "items": inner, "prefixItems": st.lists(inner, min_size=1, max_size=2), "contains": inner, "propertyNames": inner, "allOf": st.lists(inner, min_size=1, max_size=2), "anyOf": st.lists(inner, min_size=1, max_size=2), "oneOf": st.lists(inner, min_size=1, max_size=3), "not": inner, "if": inner, "then": inner, "else": inner, "dependentSchemas": named}
    return st.fixed_dictionaries({}, optional=KEYWORDS | more) | inner


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 4) | st.sampled_from(["", "a", "ab", "b1", "abcd"]) | st.sampled_from([Decimal("0.5"), Decimal("1.0"), Decimal("2.5")]), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "ac"]), v, max_size=3), max_leaves=5)


def direct(s, v):
    """The specification, keyword by keyword."""
    from tessera.plans.values import is_integer, kind

    if isinstance(s, bool):
        return s
    k, ok = kind(v), []
    if "type" in s:
        names = s["type"] if isinstance(s["type"], list) else [s["type"]]
        ok.append(k in names or (k == "number" and "integer" in names and is_integer(v)))
    if "enum" in s:
        ok.append(canonical(v) in [canonical(x) for x in s["enum"]])
    if "const" in s:
        ok.append(canonical(v) == canonical(s["const"]))
    if k == "string":
        ok += [len(v) >= s.get("minLength", 0), len(v) <= s.get("maxLength", 9), regex.search(s.get("pattern", ""), v)]
    if k == "number":
        ok += [v >= s.get("minimum", -99), v < s.get("exclusiveMaximum", 99), is_multiple(v, Decimal(str(s["multipleOf"]))) if "multipleOf" in s else True]
    if k == "array":
        ok += [len(v) >= s.get("minItems", 0), not s.get("uniqueItems") or len({canonical(x) for x in v}) == len(v)]
        prefix = s.get("prefixItems", [])
        ok += [direct(p, x) for p, x in zip(prefix, v)] + [direct(s.get("items", True), x) for x in v[len(prefix) :]]
        ok.append("contains" not in s or any(direct(s["contains"], x) for x in v))
    if k == "object":
        ok += [n in v for n in s.get("required", ())] + [len(v) <= s.get("maxProperties", 9)]
        for n, x in v.items():
            known = [s["properties"][n]] if n in s.get("properties", {}) else []
            known += [q for p, q in s.get("patternProperties", {}).items() if regex.search(p, n)]
            ok += [direct(q, x) for q in known] if known else [direct(s.get("additionalProperties", True), x)]
            ok.append(direct(s.get("propertyNames", True), n))
            ok.append(direct(s.get("dependentSchemas", {}).get(n, True), v))
    ok += [direct(q, v) for q in s.get("allOf", ())]
    ok.append("anyOf" not in s or any(direct(q, v) for q in s["anyOf"]))
    ok.append("oneOf" not in s or sum(direct(q, v) for q in s["oneOf"]) == 1)
    ok.append("not" not in s or not direct(s["not"], v))
    if "if" in s:
        ok.append(direct(s.get("then" if direct(s["if"], v) else "else", True), v))
    return all(ok)


@settings(max_examples=600, deadline=None)
@given(schemas(), st.lists(VALUES, min_size=1, max_size=4))
def test_random_schemas_agree_with_the_specification(schema, values):
    c = compile_schema(schema)
    for v in values:
        got, want = interp.interpret(c, v), direct(schema, v)
        assert got.accepted or not want, "a valid value was rejected"
        if got.accepted and not want:
            assert c.exactness > Exactness.EXACT_WITH_VALIDATION or got.approximated


def test_fold_descends_skips_and_stops():
    c = compile_schema('{"type":"object","properties":{"a":{"type":"array","items":{"type":"string"}},"b":{"type":"number"}},"additionalProperties":false}')
    assert [at for at, _ in model.walk(c.plan)] == ["", "/property a", "/property a/items", "/property b", "/additional"]

    def without_arrays(seen, at, p):
        return [*seen, at], model.Visit.SKIP if isinstance(p.shape, model.Sequence) else model.Visit.DESCEND

    assert model.fold(c.plan, [], without_arrays) == ["", "/property a", "/property b", "/additional"]
    assert model.find(c.plan, lambda p: isinstance(p.shape, model.Scalar)) == "/property a/items"
    assert model.find(c.plan, lambda p: isinstance(p.shape, model.Union)) is None


def test_one_of_takes_in_what_stands_beside_it():
    s = t.KindIs(frozenset(("string",)))
    check = lambda word, n: t.Check(frozenset(("string",)), word, n)
    any_of = t.Some((check("minLength", 4), t.Check(frozenset(("string",)), "pattern", text="a")))
    single = t.Single((check("maxLength", 9), t.Check(frozenset(("string",)), "pattern", text="b")))
    out = simplify(t.Every((s, any_of, single)))
    assert isinstance(out, t.Single) and len(out.parts) == 2 and all(isinstance(p, t.Some) for p in out.parts)
    two = t.Single((check("minLength", 1), t.Check(frozenset(("string",)), "pattern", text="c")))
    assert isinstance(simplify(t.Every((s, single, two))), t.Every)


def test_the_graph_of_nested_plans():
    c = compile_schema('{"type":"object","properties":{"u":{"oneOf":[{"type":"string"},{"$ref":"#/$defs/L"}]}},"patternProperties":{"^x":{"$ref":"#/$defs/L"}},"additionalProperties":{"type":"array","prefixItems":[{"$ref":"#/$defs/L"}],"items":{"$ref":"#/$defs/gone"},"contains":{"type":"null"}},"$defs":{"L":{"type":"array","items":{"type":"number"}}}}')
    edges = dump.route_edges(c)
    labels = {label for _, _, label in edges}
    assert {"property u", "kind string", "kind array", "pattern ^x", "additional", "item 0", "items", "contains", "refers to"} <= labels
    assert [b for a, b, label in edges if a == "ref #/$defs/L" and label == "items"] == ["ref #/$defs/L/items"]  # once
    dot = dump.route_dot(c)
    assert "octagon" in dot and dot.count('shape=box, label="#/$defs/L"') == 1 and dot == dump.route_dot(c)


def test_deep_values_and_schemas():
    c = compile_schema('{"$defs":{"N":{"type":"object","properties":{"v":{"type":"number"},"n":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}')
    for leaf, good in (('{"v":1}', True), ('{"v":"x"}', False)):
        v = interp.interpret(c, decode('{"n":' * 9000 + leaf + "}" * 9000))
        assert v.accepted is good and (good or v.reasons[0].path == "/n" * 9000 + "/v")
    deep = decode("[" * 9000 + "]" * 9000)
    assert canonical(deep) == canonical(deep) and not interp.interpret(compile_schema('{"uniqueItems":true}'), [deep, deep]).accepted
    nest = lambda n: '{"properties":{"a":' * n + '{"type":"string"}' + "}}" * n
    c = compile_schema(nest(400))
    assert not interp.interpret(c, decode('{"a":' * 400 + "1" + "}" * 400)).accepted
    with pytest.raises(source.BadSchema, match="deeply"):
        compile_schema(nest(8000))


def test_a_large_bundle_compiles_in_time():
    """Ours: 200 components, each with references to others, unions and constraints."""
    part = lambda i: {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": i}, "next": {"$ref": f"#/$defs/P{(i * 7 + 1) % 200}"}, "any": {"oneOf": [{"$ref": f"#/$defs/P{(i + 3) % 200}"}, {"type": "string", "maxLength": i + 1}]}, "tags": {"type": "array", "items": {"enum": [f"t{j}" for j in range(20)]}, "uniqueItems": True}}, "patternProperties": {"^x-": {"type": ["string", "null"]}}}
    began = time.time()
    c = compile_schema({"$defs": {f"P{i}": part(i) for i in range(200)}, "oneOf": [{"$ref": f"#/$defs/P{i}"} for i in range(0, 200, 50)]})
    assert len(c.definitions) >= 200 and time.time() - began < 60
