"""Plans as Spark expressions, against the exact evaluator and against SQL."""

import json
import os
import random
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import api, cli, queries
from tessera.operators import instance, lower
from tessera.plans import interp
from tessera.plans.values import decode, plain
from tessera.sources import schemas as schema_sources
from tessera.streaming import validate

from .cases import ACCEPTANCE
from .test_plans import VALUES, schemas

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_acceptance(spark):
    rows = [(i, x, want) for i, (_, good, bad) in enumerate(ACCEPTANCE) for want, xs in ((True, good), (False, bad)) for x in xs]
    df = spark.createDataFrame(rows, "i int, text string, want boolean").coalesce(1).withColumn("v", api.from_json("text")).cache()
    native = 0
    for i, (schema, *_) in enumerate(ACCEPTANCE):
        c = api.compile_schema(schema)
        for r in df.where(F.col("i") == i).select("text", "want", api.accepts(c, "v", exact=False).alias("native"), api.accepts(c, "v", "text").alias("exact")).collect():
            assert r.exact == r.want, (schema, r)
            assert r.native in (None, r.want), (schema, r)
            native += r.native is not None
    assert native > 0.9 * len(rows)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas(), st.lists(VALUES, min_size=1, max_size=6))
def test_random_schemas_agree_with_the_exact_evaluator(spark, schema, values):
    c = api.compile_schema(schema)
    df = spark.createDataFrame([(plain(v),) for v in values], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    try:
        got = [r.a for r in df.select(api.accepts(c, "v", exact=False).alias("a")).collect()]
    except api.Refused:
        return
    for v, a in zip(values, got):
        assert a in (None, interp.interpret(c, v).accepted), (schema, v)


def test_three_states_and_hazards(spark):
    rows = [("null",), ("{",), (None,), ("1 2",), ('{"a":1,"a":"x"}',), ("1e400",), ("123456789012345678901234567890123456789012",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1).withColumn("v", api.from_json("text"))
    c = api.compile_schema('{"type":["null","number"],"minimum":5}')
    got = df.select(api.evaluate(c, "text").alias("r"), api.accepts(c, "v", "text").alias("a")).collect()
    assert [(r.r.status, r.r.accepted) for r in got] == [("evaluated", True), ("invalid_value", None), ("no_instance", None), ("invalid_value", None), ("evaluated", False), ("evaluated", True), ("evaluated", True)]
    assert [r.a for r in got][:3] == [True, None, None] and [r.a for r in got][4:] == [False, True, True]


def test_numbers_at_the_edges(spark):
    texts = ["9007199254740992", "9007199254740993", "1e308", "-1e308", "1e-19", "0", "0.1", "1e-1", "123456789012345678901", "1.5e1"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    for schema in ('{"minimum":9007199254740993}', '{"exclusiveMinimum":0}', '{"multipleOf":0.1}', '{"type":"integer"}', '{"const":0.1}', '{"enum":[15,"x"]}', '{"maximum":1e300}'):
        c = api.compile_schema(schema)
        got = [r.a for r in df.select(api.accepts(c, "v").alias("a")).collect()]
        assert got == [interp.interpret(c, decode(x)).accepted for x in texts], schema


def test_deep_recursion_goes_to_the_exact_evaluator(spark):
    c = api.compile_schema('{"$defs":{"N":{"type":"object","properties":{"v":{"type":"number"},"n":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}')
    deep = lambda k, last: '{"n":' * k + last + "}" * k
    texts = [deep(1, '{"v":1}'), deep(1, '{"v":"x"}'), deep(20, '{"v":1}'), deep(20, '{"v":"x"}')]
    df = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    got = df.select(api.accepts(c, "v", exact=False).alias("n"), api.accepts(c, "v").alias("e")).collect()
    assert [r.n for r in got] == [True, False, None, None] and [r.e for r in got] == [True, False, True, False]


def test_project_and_route(spark):
    c = api.compile_schema('{"type":"object","required":["id"],"properties":{"id":{"type":"integer","minimum":0,"maximum":9},"at":{"type":"string","format":"date"},"tags":{"type":"array","items":{"type":"string"}},"note":{"type":["string","null"]},"t":{"type":"array","prefixItems":[{"type":"number"}],"items":{"type":"boolean"}}},"patternProperties":{"^x-":{"type":"number"}},"additionalProperties":{"type":"string"}}')
    text = '{"id":3,"at":"2024-01-02","tags":["a","b"],"note":null,"t":[1.5,true],"x-a":2,"more":"m"}'
    df = spark.createDataFrame([(text,), ('{"id":"no"}',), ("7",)], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    got = [r.p for r in df.select(api.project(c, "v").alias("p")).collect()]
    assert (got[0].id, str(got[0].at), got[0].tags, got[0].t._0, got[0].t._rest, got[0]._pattern_0, got[0]._additional) == (3, "2024-01-02", ["a", "b"], 1.5, [True], {"x-a": 2.0}, {"more": "m"})
    assert "note" in got[0]._present and got[1].id is None and got[2] is None
    assert df.select(api.project(c, "v").alias("p")).schema["p"].dataType.simpleString().replace(" ", "") == lower.storage_type(c, c.plan.shape, c.plan.tests).replace("`", "").replace(" ", "")
    k = api.compile_schema('{"type":["string","number"]}')
    assert [r.b for r in df.select(api.route(k, "v").alias("b")).collect()] == [None, None, "number"]


def test_storage_schema_has_metadata(spark):
    c = api.compile_schema('{"type":"object","properties":{"a":{"type":"string","title":"A","x-unit":{"of":1}},"b":{"type":"object","properties":{"c":{"type":"boolean","default":true}}}},"additionalProperties":false}')
    found = api.storage_schema(c)
    assert found["a"].metadata == {"title": '"A"', "x-unit": '{"of":1}'} and found["b"].dataType["c"].metadata == {"default": "true"}


def test_refused(spark):
    c = api.compile_schema('{"type":"object","unevaluatedProperties":false}')
    with pytest.raises(api.Refused, match="unevaluatedProperties"):
        api.accepts(c, "v")
    with pytest.raises(api.Refused):
        api.evaluate(c, "text")


def test_tables_of_findings(spark):
    found = {"a": api.compile_schema('{"uniqueItems":true,"pattern":"\\\\s"}'), "b": api.compile_schema('{"minLength":-1}')}
    assert api.catalog(spark, found).count() == 2
    assert {r.slot for r in api.needs(spark, found).collect()} == {"json_equality", "regex_dialect"}
    assert api.diagnostics(spark, found).where("severity = 'error'").count() == 1
    assert api.plan_rows(spark, found).count() == 2
    edges = api.reference_edges(spark, queries.CORPUS["list"])
    assert edges.where("recursion = 'guarded'").count() == 3 and edges.where("descent").count() == 2
    assert [r.branch for r in api.branches(spark, api.compile_schema(queries.TAGGED)).collect()] == ['t = "click"', 't = "view"']


def test_sources_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"$ref":"b.json"}')
    (tmp_path / "b.json").write_text('{"type":"string"}')
    found = schema_sources.compile_files(spark, str(tmp_path))
    assert set(found) == {"a.json", "b.json"} and not interp.interpret(found["a.json"], 1).accepted
    with pytest.raises(ValueError):
        schema_sources.spark_loader(spark, str(tmp_path))("../x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text('"a"\n1\n{\n')
    rows = schema_sources.instances(spark, str(tmp_path / "in"))
    assert [r.a for r in rows.select(api.accepts(found["b.json"], "v", "text").alias("a")).collect()] == [True, False, None]


def test_stream_split_repeats_nothing(spark, tmp_path):
    c = api.compile_schema('{"type":"object","properties":{"k":{"maximum":50}}}')
    source = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "src").mkdir()
    source.repartition(3).write.mode("append").parquet(str(tmp_path / "src"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "src"))
        validate.split(stream, c, "props", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() + bad.count() == source.count()
    assert good.count() == source.where("cast(get_json_object(props, '$.k') as int) <= 50").count()


EDGES = ["9007199254740992", "9007199254740993", "-9007199254740993", "9223372036854775807", "-9223372036854775808", "1e30", "1.5e300", "-1e300", "1e-9", "-1e-9", "0", "-0.0", "0.1", "1e-1", "0.10000000000000000000000001", "0.09999999999999999999999999",
         "123456789012345678901", "12345678901234567890.5", "99999999999999999999999999999999999999", "0.00000000000000000000000000000000000001", "-0.000000000000000000000000000001", "2.5", "7.5e0", "1e22", "3e38", "5e-324", "0.05", "0.049999999999999996"]
BOUNDS = ["9007199254740993", "0", "0.1", "1e-9", "-1e-9", "1e30", "1e-30", "0.05", "9223372036854775807", "12345678901234567890.5", "1e300", "1e400", "-1e400", "0.1000000000000000055511151231257827"]


@pytest.fixture(scope="module")
def edges(spark):
    """Numbers as text, as Spark prints them (a VARIANT's DOUBLE stands for that), and as VARIANTs."""
    df = spark.createDataFrame([(x,) for x in EDGES], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    return df.withColumn("t", F.expr("to_json(v)"))


def agree(df, schemas):
    """Each schema's answers, native ones in one pass, are those of the exact evaluator."""
    compiled = [api.compile_schema(x) for x in schemas]
    for i, c in enumerate(compiled):
        df = api.check(df, c, "v", f"r{i}")
    for r in df.collect():
        for i, c in enumerate(compiled):
            assert r[f"r{i}"] == interp.interpret(c, decode(r.t)).accepted, (schemas[i], r.text)
    return df


@pytest.mark.parametrize("bound", BOUNDS)
def test_bounds_are_exact_and_native(edges, bound):
    df = agree(edges, [f'{{"{rule}":{bound}}}' for rule in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "const")])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_multiples_and_integers(edges):
    agree(edges, ['{"type":"integer"}', '{"multipleOf":0.1}', '{"multipleOf":2.5}', '{"multipleOf":3}', '{"multipleOf":1e-9}', '{"multipleOf":7e20}', '{"multipleOf":1e10}'])


def test_route_and_sql_function_decide_all_numbers(spark):
    c = api.compile_schema('{"anyOf":[{"minimum":10},{"maximum":1e-6}],"type":"number"}')
    df = spark.createDataFrame([("1e30",), ("1e-9",), ("5",), ("-1e300",)], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    want = ["0", "1", None, "1"]
    assert [r.b for r in df.select(api.route(c, "v").alias("b")).collect()] == want
    assert [r.branch for r in api.routed(df, c, "v").collect()] == want
    api.register(spark, "decides", c)
    assert [r.f for r in df.selectExpr("decides(v) f").collect()] == [True, True, False, True]
    some = api.compile_schema('{"uniqueItems":true}')
    with pytest.raises(api.Refused):
        api.register(spark, "cannot", some)
    api.register(spark, "can_in_part", some, partial=True)
    # What only the exact evaluator can tell goes to it.
    r = api.compile_schema('{"oneOf":[{"uniqueItems":true},{"maxItems":2}]}')
    pairs = spark.createDataFrame([("[1,1.0]",), ("[1,2.5,3]",), ("[1,1,1.0]",)], "text string").coalesce(1).withColumn("v", api.from_json("text"))
    assert [x.branch for x in api.routed(pairs, r, "v").collect()] == ["1", "0", None]
    assert [x.b for x in pairs.select(api.route(r, "v").alias("b")).collect()] == ["1", "0", None]


TYPED = "struct<a: double, b: string, ab: array<bigint>, c: boolean, d: decimal(20,4), e: struct<a: float, b: bigint>, m: map<string, double>, v: variant, l: array<double>>"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(schemas(), st.integers(0, 10**6))
def test_typed_values_agree_with_the_exact_evaluator(spark, schema, seed):
    c = api.compile_schema(schema)
    r = random.Random(seed)
    one = lambda x: x if r.random() < 0.8 else None
    rows = [
        ((one(r.choice([0.0, 1.0, 2.5, -3.0, 1e30])), one(r.choice(["", "a", "ab", "xyz"])), one([one(r.randint(0, 3)) for _ in range(r.randint(0, 3))]), one(r.random() < 0.5), one(Decimal(r.randint(-30, 30)) / 4),
          one((one(r.choice([0.5, 2.0])), one(r.randint(0, 5)))), one({k: one(r.choice([1.0, 2.5])) for k in r.sample(["a", "b", "ab"], 2)}), None, one([one(r.choice([0.0, -0.0, 1.0])) for _ in range(r.randint(0, 3))])),)
        for _ in range(5)
    ]
    df = spark.createDataFrame(rows, f"v {TYPED}").coalesce(1)
    nested = {"v": "v", "ab": "v.ab", "e": "v.e", "m": "v.m", "l": "v.l", "a": "v.a", "b": "v.b", "d": "v.d"}
    df = df.selectExpr(*(f"{x} {n}" for n, x in nested.items()))
    text = [f"to_json({'to_variant_object' if n in ('v', 'ab', 'e', 'm', 'l') else ''}({n if n in ('v', 'ab', 'e', 'm', 'l') else f'cast({n} as variant)'})) t_{n}" for n in nested]
    df = df.selectExpr("*", *text)
    try:
        for n in nested:
            df = api.check(df, c, n, f"r_{n}", exact=False)
    except api.Refused:
        return
    for r in df.collect():
        for n in nested:
            if r[n] is None:
                assert r[f"r_{n}"] is None
            else:
                assert r[f"r_{n}"] in (None, interp.interpret(c, decode(r[f"t_{n}"])).accepted), (schema, n, r)


def test_check_keeps_columns_and_clashing_names(spark):
    c = api.compile_schema('{"type":"object","properties":{"x":{"minimum":2,"maximum":5}},"required":["x"]}')
    df = spark.createDataFrame([(1, '{"x":3}', True), (2, '{"x":9}', True), (3, None, True)], "_t0_s1 int, text string, accepted boolean").coalesce(1).withColumn("v", api.from_json("text"))
    out = api.check(df, c, "v")
    assert out.columns == ["_t0_s1", "text", "v", "accepted"]
    assert [(r._t0_s1, r.accepted) for r in out.collect()] == [(1, True), (2, False), (3, None)]
    assert api.check(df.limit(0), c, "v").collect() == []


@pytest.mark.parametrize("name", sorted(queries.COUNTS))
def test_count_queries_have_no_python(spark, name):
    assert "Python" not in queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_native_plans_have_no_python(spark):
    df = queries.read(spark, SF, "events").withColumn("v", api.from_json("props"))
    c = api.compile_schema('{"type":"object","required":["k"],"properties":{"k":{"type":"string","minLength":2}}}')
    plan = df.select(api.accepts(c, "v"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "props" in plan and "event_type" not in plan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert rows
    if name not in queries.SQL:
        return
    out = con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(out.columns)
    want = [tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_command_line(tmp_path, capsys):
    path = tmp_path / "s.json"
    path.write_text(queries.CORPUS["list"])
    for show in ("plan", "term", "source", "refs-dot", "routes-dot", "types"):
        assert cli.main([str(path), "--show", show]) == 0
        assert capsys.readouterr().out.strip()
    path.write_text("[")
    assert cli.main([str(path)]) == 2
    path.write_text('{"$dynamicRef":"#x"}')
    assert cli.main([str(path)]) == 1


def test_entry_without_the_subpackage(tmp_path):
    """The driver takes some folders and a file away; what is left still works."""
    root = Path(__file__).resolve().parent.parent
    for item in root.iterdir():
        if item.name not in (".git", "corpus_pipeline.py", "tessera", "tests"):
            os.symlink(item, tmp_path / item.name)
    (tmp_path / "tessera").mkdir()
    for item in (root / "tessera").iterdir():
        if item.name != "llm":
            os.symlink(item, tmp_path / "tessera" / item.name)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    names, sql = json.loads(out.stdout)
    assert set(names) == set(queries.QUERIES) and set(sql) <= set(names)


def test_workers_find_the_package_from_anywhere(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        f"print('ROWS', e.queries()['evaluate_reasons'](spark, {SF!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200, env=env)
    assert "ROWS 3" in out.stdout


def test_decimal_literals():
    assert instance.decimal(Decimal("1e-20")) and instance.decimal(Decimal("1e-21")) is None and instance.decimal(Decimal("1e18")) is None
    assert lower.quoted("a'\\\n") == "'a\\'\\\\\\n'"
