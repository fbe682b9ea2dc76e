"""Driver queries: schema features on whole tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .plans import dump
from .plans.source import Library, parse
from .shared import shared_dir
from .streaming import validate

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass(frozen=True)
class Count:
    """Accepted instances by group: `instance` is SQL for a VARIANT or a typed value, `where` the same test on columns."""

    table: str
    group: str
    instance: str
    schema: str
    where: str

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        compiled = api.compile_schema(self.schema)
        df = read(spark, sf_dir, self.table).select(F.col(self.group).alias("grp"), F.expr(self.instance).alias("v"))
        return api.check(df, compiled, "v", "ok").groupBy("grp").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"))

    def sql(self) -> str:
        return f"SELECT {self.group} AS grp, count(*) AS n, count(*) FILTER (WHERE {self.where}) AS n_valid FROM {self.table} GROUP BY 1"


def obj(**columns: str) -> str:
    """An object of columns; NULLs are JSON nulls."""
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in columns.items()) + ")"


def sparse(**columns: str) -> str:
    """A VARIANT object of columns without those that are NULL."""
    return "try_parse_json(to_json(named_struct(" + ", ".join(f"'{n}', {e}" for n, e in columns.items()) + ")))"


LINE = obj(quantity="l_quantity", discount="l_discount", flag="l_returnflag", number="l_linenumber")
K = "CAST(json_extract(props, '$.k') AS BIGINT)"
PART = sparse(name="p_name", size="p_size", brand="if(p_size > 25, p_brand, NULL)", label="if(p_size % 3 = 0, p_type, NULL)")
ORDER = sparse(key="o_orderkey", status="o_orderstatus", urgent="if(o_orderpriority = '1-URGENT', true, NULL)", clerk="if(o_orderkey % 2 = 0, 'c', NULL)")

COUNTS = {
    "events_valid": Count("events", "event_type", "try_parse_json(props)", '{"type":"object","required":["k"],"additionalProperties":false,"properties":{"k":{"type":"integer","minimum":0,"maximum":50}}}', f"{K} BETWEEN 0 AND 50"),
    "type_assert": Count("events", "event_type", "try_parse_json(props)", '{"type":"object"}', "json_type(props) = 'OBJECT'"),
    "type_union": Count("part", "p_brand", "if(p_size < 10, CAST(p_name AS VARIANT), if(p_size < 30, CAST(p_size AS VARIANT), CAST(true AS VARIANT)))", '{"type":["string","number"]}', "p_size < 30"),
    "integer_domain": Count("lineitem", "l_returnflag", "l_extendedprice", '{"type":"integer"}', "l_extendedprice = floor(l_extendedprice)"),
    "numeric_bounds": Count("lineitem", "l_returnflag", "l_discount", '{"minimum":0.02,"maximum":0.08}', "l_discount >= 0.02::DOUBLE AND l_discount <= 0.08::DOUBLE"),
    "exclusive_bounds": Count("orders", "o_orderstatus", "o_totalprice", '{"type":"number","exclusiveMinimum":50000,"exclusiveMaximum":300000}', "o_totalprice > 50000 AND o_totalprice < 300000"),
    "multiple_of": Count("lineitem", "l_linestatus", "l_quantity", '{"multipleOf":2.5}', "CAST(l_quantity AS DECIMAL(18, 4)) % 2.5 = 0"),
    "string_length": Count("part", "p_brand", "p_name", '{"type":"string","minLength":8,"maxLength":14}', "length(p_name) BETWEEN 8 AND 14"),
    "string_pattern": Count("part", "p_brand", "p_type", '{"type":"string","pattern":"^[A-M]\\\\w* ?.*[A-Z]$"}', "regexp_matches(p_type, '^[A-M][A-Za-z0-9_]* ?.*[A-Z]$')"),
    "enum_literal": Count("orders", "o_orderstatus", "o_orderpriority", '{"enum":["1-URGENT","2-HIGH",null,7]}', "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "const_tag": Count("customer", "c_nationkey", "c_mktsegment", '{"const":"BUILDING"}', "c_mktsegment = 'BUILDING'"),
    "nullable_field": Count("part", "p_brand", obj(a="if(p_size > 25, NULL, p_name)", b="p_size"), '{"type":"object","properties":{"a":{"type":["string","null"],"maxLength":11},"b":{"type":"integer"}},"required":["a"]}', "p_size > 25 OR length(p_name) <= 11"),
    "required_fields": Count("part", "p_brand", PART, '{"type":"object","required":["brand","size"]}', "p_size > 25"),
    "additional_false": Count("part", "p_brand", PART, '{"type":"object","properties":{"name":{},"size":{},"brand":{}},"additionalProperties":false}', "NOT p_size % 3 = 0"),
    "additional_schema": Count("part", "p_brand", PART, '{"properties":{"name":{},"size":{}},"additionalProperties":{"type":"string","maxLength":9}}', "(p_size <= 25 OR length(p_brand) <= 9) AND (p_size % 3 <> 0 OR length(p_type) <= 9)"),
    "pattern_properties": Count("part", "p_brand", PART, '{"patternProperties":{"^[bl]":{"minLength":12},"^s":{"maximum":40}}}', "(p_size <= 25 OR length(p_brand) >= 12) AND (p_size % 3 <> 0 OR length(p_type) >= 12) AND p_size <= 40"),
    "property_names": Count("orders", "o_orderstatus", ORDER, '{"propertyNames":{"pattern":"^[^g]+$"}}', "o_orderpriority <> '1-URGENT'"),
    "property_name_set": Count("orders", "o_orderstatus", ORDER, '{"propertyNames":{"enum":["key","status","urgent"]}}', "o_orderkey % 2 <> 0"),
    "min_max_properties": Count("orders", "o_orderstatus", ORDER, '{"minProperties":3,"maxProperties":3}', "(o_orderpriority = '1-URGENT') <> (o_orderkey % 2 = 0)"),
    "dependent_required": Count("orders", "o_orderstatus", ORDER, '{"dependentRequired":{"urgent":["clerk","key"]}}', "o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0"),
    "all_of": Count("lineitem", "l_returnflag", LINE, '{"allOf":[{"properties":{"quantity":{"minimum":10}}},{"properties":{"quantity":{"maximum":30}}}]}', "l_quantity BETWEEN 10 AND 30"),
    "any_of": Count("lineitem", "l_returnflag", LINE, '{"anyOf":[{"properties":{"quantity":{"minimum":40}}},{"properties":{"discount":{"maximum":0.01}}}]}', "l_quantity >= 40 OR l_discount <= 0.01::DOUBLE"),
    "one_of_count": Count("lineitem", "l_returnflag", LINE, '{"oneOf":[{"properties":{"quantity":{"minimum":20}}},{"properties":{"discount":{"maximum":0.04}}}]}', "(l_quantity >= 20) <> (l_discount <= 0.04::DOUBLE)"),
    "not_schema": Count("lineitem", "l_linestatus", LINE, '{"not":{"properties":{"flag":{"enum":["A","R"]}}}}', "l_returnflag NOT IN ('A', 'R')"),
    "if_then_else": Count("lineitem", "l_returnflag", LINE, '{"if":{"properties":{"flag":{"const":"N"}}},"then":{"properties":{"quantity":{"minimum":25}}},"else":{"properties":{"number":{"maximum":2}}}}', "CASE WHEN l_returnflag = 'N' THEN l_quantity >= 25 ELSE l_linenumber <= 2 END"),
    "tagged_union": Count("events", "event_type", obj(t="event_type", v="value"), '{"oneOf":[{"type":"object","required":["t"],"properties":{"t":{"const":"click"},"v":{"minimum":5}}},{"type":"object","required":["t"],"properties":{"t":{"const":"view"},"v":{"maximum":5}}}]}', "(event_type = 'click' AND value >= 5) OR (event_type = 'view' AND value <= 5)"),
    "declared_tag": Count("events", "event_type", obj(t="event_type", v="value"), '{"$defs":{"C":{"type":"object","required":["t"],"properties":{"t":{"const":"click"},"v":{"minimum":5}}},"V":{"type":"object","required":["t"],"properties":{"t":{"enum":["view","signup"]},"v":{"maximum":5}}}},"oneOf":[{"$ref":"#/$defs/C"},{"$ref":"#/$defs/V"}],"discriminator":{"propertyName":"t","mapping":{"click":"#/$defs/C","view":"V","signup":"V"}}}', "(event_type = 'click' AND value >= 5) OR (event_type IN ('view', 'signup') AND value <= 5)"),
    "presence_dispatch": Count("orders", "o_orderstatus", ORDER, '{"type":"object","dependentSchemas":{"urgent":{"required":["clerk"]}}}', "o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0"),
    "kind_dispatch": Count("part", "p_brand", "if(p_size < 10, CAST(p_name AS VARIANT), CAST(p_size AS VARIANT))", '{"oneOf":[{"type":"string","minLength":10},{"type":"number","maximum":30}]}', "CASE WHEN p_size < 10 THEN length(p_name) >= 10 ELSE p_size <= 30 END"),
    "ref_definition": Count("customer", "c_mktsegment", obj(id="c_custkey", balance="c_acctbal"), '{"$defs":{"money":{"type":"number","minimum":0}},"type":"object","properties":{"balance":{"$ref":"#/$defs/money"},"id":{"$ref":"#/$defs/money"}}}', "c_acctbal >= 0"),
    "array_items": Count("embeddings", "label", "embedding", '{"type":"array","items":{"type":"number","minimum":-0.35,"maximum":0.35},"minItems":64,"maxItems":64}', "len(embedding) = 64 AND list_min(embedding) >= -0.35::FLOAT AND list_max(embedding) <= 0.35::FLOAT"),
    "tuple_prefix": Count("nation", "n_regionkey", "to_variant_object(array(CAST(n_nationkey AS VARIANT), CAST(n_name AS VARIANT)))", '{"type":"array","prefixItems":[{"minimum":5},{"type":"string","maxLength":7}],"items":false}', "n_nationkey >= 5 AND length(n_name) <= 7"),
    "contains_count": Count("embeddings", "label", "embedding", '{"contains":{"exclusiveMinimum":0.25},"minContains":2,"maxContains":5}', "len(list_filter(embedding, lambda x: x > 0.25::FLOAT)) BETWEEN 2 AND 5"),
}


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"), F.collect_list("l_suppkey").alias("suppliers"))


def unique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = api.compile_schema('{"type":"array","uniqueItems":true,"minItems":2}')
    df = api.check(api.check(_orders_lines(spark, sf_dir), compiled, "flags", "f"), compiled, "suppliers", "s")
    return df.agg(F.count_if("f").alias("n_flags"), F.count_if("s").alias("n_suppliers"))


def array_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = api.compile_schema('{"type":"array","minItems":3,"maxItems":5,"items":{"enum":["A","N"]}}')
    return api.check(_orders_lines(spark, sf_dir), compiled, "flags", "ok").select("l_orderkey", "ok")


def enum_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enum as large as a table: a semi join against its values."""
    names = read(spark, sf_dir, "nation").where("n_regionkey = 1")
    customers = read(spark, sf_dir, "customer")
    return api.literal_filter(customers, "c_nationkey", names, "n_nationkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = api.compile_schema('{"type":"object","properties":{"total":{"type":"number","maximum":400000},"priority":{"pattern":"^[1-4]"}}}')
    orders = read(spark, sf_dir, "orders").withColumn("v", F.expr(obj(total="o_totalprice", priority="o_orderpriority")))
    return api.quarantine(orders, compiled, "v").select("o_orderkey", "o_totalprice", "o_orderpriority")


def project_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = api.compile_schema('{"type":"object","properties":{"k":{"type":"integer","format":"int32"}},"required":["k"],"additionalProperties":false}')
    df = read(spark, sf_dir, "events").withColumn("v", api.from_json("props")).withColumn("p", api.project(compiled, "v"))
    return df.groupBy("event_type").agg(F.sum(F.col("p.k").cast("bigint")).alias("sum_k"), F.max("p.k").alias("max_k"))


TAGGED = '{"oneOf":[{"type":"object","required":["t"],"properties":{"t":{"const":"click"}}},{"type":"object","required":["t"],"properties":{"t":{"const":"view"}}}]}'


def route_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("v", F.expr(obj(t="event_type")))
    return api.routed(df, api.compile_schema(TAGGED), "v").groupBy("branch").agg(F.count("*").alias("n"))


def route_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = api.compile_schema('{"anyOf":[{"minimum":10},{"maximum":30}],"type":"number"}')
    return api.routed(read(spark, sf_dir, "lineitem"), compiled, "l_quantity").groupBy("branch").agg(F.count("*").alias("n"))


def evaluate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why events are rejected: the innermost reason, by the exact evaluator."""
    compiled = api.compile_schema('{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":20,"maximum":80}}}')
    df = read(spark, sf_dir, "events").withColumn("r", api.evaluate(compiled, "props"))
    first = F.try_element_at("r.reasons", F.lit(1))
    return df.groupBy(F.col("r.status").alias("status"), F.col("r.accepted").alias("accepted"), first["path"].alias("path"), first["constraint"].alias("rule")).agg(F.count("*").alias("n"))


def invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON null, text that isn't JSON, and no text at all stay apart."""
    compiled = api.compile_schema('{"type":["object","null"]}')
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 4 = 1 THEN substr(props, 2) WHEN event_id % 4 = 2 THEN NULL ELSE props END")
    df = read(spark, sf_dir, "events").withColumn("t", text).withColumn("r", api.evaluate(compiled, "t"))
    return df.groupBy(F.col("r.status").alias("status"), F.col("r.accepted").alias("accepted")).agg(F.count("*").alias("n"))


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    api.register(spark, "accepts_discount", api.compile_schema('{"type":"number","minimum":0.05}'))
    df = read(spark, sf_dir, "lineitem")
    return df.groupBy("l_linestatus").agg(F.count_if(F.expr("accepts_discount(CAST(l_discount AS VARIANT))")).alias("n_valid"))


def recursive_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as linked lists, deeper than the unrolled levels: native where it is shallow, exact where it isn't."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    chain = "aggregate(reverse(t), CAST('null' AS STRING), (acc, x) -> concat('{\"role\":\"', x.role, '\",\"next\":', acc, '}'))"
    compiled = api.compile_schema('{"$defs":{"N":{"type":["object","null"],"required":["role"],"properties":{"role":{"enum":["user","assistant"]},"next":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}')
    df = turns.withColumn("text", F.expr(chain)).withColumn("v", api.from_json("text"))
    return api.check(df, compiled, "v", "ok", "text").select("conv_id", F.size("t").alias("turns"), "ok")


CORPUS = {
    "any": "{}", "never": "false", "switch": '{"type":"object","properties":{"on":{"type":"boolean"}},"additionalProperties":false}', "hours": '{"type":"number","minimum":0,"exclusiveMaximum":24}',
    "row": '{"type":"array","prefixItems":[{"type":"integer"}],"items":{"type":"boolean"}}', "level": '{"enum":["low","mid","high"]}', "either": '{"oneOf":[{"type":"boolean"},{"type":"array"}]}', "tagged": TAGGED,
    "fizz": '{"oneOf":[{"type":"number","multipleOf":3},{"type":"number","multipleOf":5}]}', "guest": '{"type":"string","not":{"enum":["admin","root"]}}', "rest": '{"type":"object","properties":{"a":{}},"unevaluatedProperties":{"type":"number"}}',
    "dynamic": '{"$dynamicRef":"#node"}', "dangling": '{"$ref":"#/$defs/absent"}', "cycle": '{"$defs":{"p":{"anyOf":[{"$ref":"#/$defs/q"}]},"q":{"allOf":[{"$ref":"#/$defs/p"}]}},"$ref":"#/$defs/q"}',
    "list": '{"$defs":{"tree":{"type":"object","properties":{"sub":{"type":"array","items":{"$ref":"#/$defs/tree"}}}}},"$ref":"#/$defs/tree"}',
}


def catalog_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.catalog(spark, {n: api.compile_schema(s) for n, s in CORPUS.items()}).select("schema_id", "capability", "exactness", "route")


def catalog_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.diagnostics(spark, {n: api.compile_schema(s) for n, s in CORPUS.items()})
    return found.groupBy("schema_id", "severity").agg(F.count("*").alias("n"))


def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.reference_edges(spark, CORPUS["list"])


SHOP = {
    "components": {
        "schemas": {
            "Order": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "lines": {"type": "array", "items": {"$ref": "#/components/schemas/Line"}}}},
            "Line": {"type": "object", "properties": {"qty": {"type": "number", "minimum": 1}, "of": {"$ref": "#/components/schemas/Order"}}},
            "Status": {"enum": ["open", "done"]},
            "Bad": {"minLength": -1},
        }
    }
}


def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of a document, each with what it refers to."""
    return api.catalog(spark, api.compile_document(SHOP)).select("schema_id", "capability", "exactness", "definitions", "diagnostics")


def one_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component by itself: its siblings are not there."""
    found = {n: api.compile_component(SHOP, n) for n in ("Line", "Status")}
    return api.catalog(spark, found).select("schema_id", "capability", "exactness")


def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by a schema in two documents, found by a loader."""
    load = api.table_loader({"mem://x/b.json": '{"$defs":{"share":{"$anchor":"share","type":"number","minimum":0.01,"maximum":0.07}}}'})
    compiled = api.compile_schema('{"type":"object","properties":{"discount":{"$ref":"b.json#share"},"tax":{"$ref":"b.json#/$defs/share"}}}', api.Options("mem://x/a.json", loader=load))
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(obj(discount="l_discount", tax="l_tax")).alias("v"))
    return api.check(df, compiled, "v", "ok").groupBy("l_returnflag").agg(F.count_if("ok").alias("n_valid"))


def finding_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the text a schema's errors and warnings are."""
    text = '{\n  "properties": {\n    "a": {"minLength": -1},\n    "b": {"nullable": true},\n    "c": {"$ref": "#/none"}\n  }\n}'
    return api.diagnostics(spark, {"s": api.compile_schema(text)}).select("severity", "pointer", "line").distinct()


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer of each plan must take care of."""
    schemas = {"unique": '{"type":"array","uniqueItems":true}', "space": '{"type":"object","properties":{"p":{"type":"string","pattern":"^\\\\s"}}}', "free": '{"type":"array","unevaluatedItems":false}', "none": '{"type":"string"}'}
    return api.needs(spark, {n: api.compile_schema(s) for n, s in schemas.items()}).select("schema_id", "slot", "pointer").distinct()


def plan_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the plans inside a plan: fields, items, tests, routes and references."""
    compiled = api.compile_schema('{"type":"object","properties":{"u":{"oneOf":[{"type":"string"},{"$ref":"#/$defs/L"}]}},"additionalProperties":{"$ref":"#/$defs/L"},"$defs":{"L":{"type":"array","prefixItems":[{"type":"number"}],"contains":{"type":"null"}}}}')
    return spark.createDataFrame(dump.route_edges(compiled), "src string, dst string, label string")


def storage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = {"hours": CORPUS["hours"], "row": CORPUS["row"], "switch": CORPUS["switch"], "list": CORPUS["list"], "int": '{"type":"integer","minimum":0,"maximum":9}', "day": '{"type":"string","format":"date"}', "map": '{"type":"object","additionalProperties":{"type":"number"}}'}
    rows = [(n, api.storage_schema(api.compile_schema(s)).simpleString()) for n, s in schemas.items()]
    return spark.createDataFrame(rows, "schema_id string, type string")


def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers with escapes and references through $id and $anchor lead to one plan each."""
    schema = '{"$id":"mem://x/r.json","$defs":{"a/b":{"type":"string"},"c~d":{"$anchor":"here","type":"boolean"},"e":{"$id":"sub/e.json","type":"null"}},"properties":{"x":{"$ref":"#/$defs/a~1b"},"y":{"$ref":"#here"},"z":{"$ref":"sub/e.json"}},"additionalProperties":false}'
    rows = [("x", '{"x":"s"}'), ("x", '{"x":1}'), ("y", '{"y":true}'), ("y", '{"y":0}'), ("z", '{"z":null}'), ("z", '{"z":"n"}'), ("w", '{"w":1}')]
    df = spark.createDataFrame(rows, "field string, text string").withColumn("v", api.from_json("text"))
    return api.check(df, api.compile_schema(schema), "v", "ok").select("field", "text", "ok")


EXTREMES = ("1e30", "-1e30", "1e-9", "0", "5", "12345678901234567890123", "9007199254740993")


def route_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of numbers far from 1, without the exact evaluator."""
    compiled = api.compile_schema('{"anyOf":[{"minimum":9007199254740993},{"maximum":1e-6}],"type":"number"}')
    df = spark.createDataFrame([(x,) for x in EXTREMES], "text string").withColumn("v", api.from_json("text"))
    return api.routed(df, compiled, "v").select("text", "branch")


def function_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    api.register(spark, "accepts_extremes", api.compile_schema('{"type":"integer","exclusiveMinimum":0}'))
    df = spark.createDataFrame([(x,) for x in EXTREMES], "text string").withColumn("v", api.from_json("text"))
    return df.select("text", F.expr("accepts_extremes(v)").alias("ok"))


def recursive_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 500 objects, their ends checked by the exact evaluator."""
    chain = "concat(repeat('{\"next\":', 500), to_json(named_struct('rank', n_nationkey)), repeat('}', 500))"
    compiled = api.compile_schema('{"$defs":{"N":{"type":"object","properties":{"rank":{"maximum":12},"next":{"$ref":"#/$defs/N"}}}},"$ref":"#/$defs/N"}')
    df = read(spark, sf_dir, "nation").withColumn("text", F.expr(chain)).withColumn("v", api.from_json("text"))
    return api.check(df, compiled, "v", "ok", "text").select("n_nationkey", "ok")


def format_never_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format is reported as not enforced and rejects nothing."""
    compiled = api.compile_schema('{"type":"string","format":"email"}')
    df = read(spark, sf_dir, "nation").withColumn("t", F.expr("if(n_regionkey = 0, to_json(array(n_name)), concat('\"', n_name, '\"'))")).withColumn("r", api.evaluate(compiled, "t"))
    return df.groupBy("n_regionkey").agg(F.count_if("r.accepted").alias("n_valid"), F.count_if(F.size("r.approximated") > 0).alias("n_approximated"))


def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the typed storage in date functions."""
    compiled = api.compile_schema('{"type":"object","properties":{"day":{"type":"string","format":"date"},"total":{"type":"number"}},"required":["day"]}')
    df = read(spark, sf_dir, "orders").withColumn("v", F.expr("try_parse_json(to_json(named_struct('day', date_format(o_orderdate, 'yyyy-MM-dd'), 'total', o_totalprice)))")).withColumn("p", api.project(compiled, "v"))
    return df.groupBy(F.year("p.day").alias("y"), F.month("p.day").alias("m")).agg(F.count("*").alias("n"), F.max("p.total").alias("top"))


def top_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest rejected orders of each status: window, sort and limit by the host over a validated column."""
    compiled = api.compile_schema('{"type":"object","properties":{"total":{"maximum":300000}}}')
    df = read(spark, sf_dir, "orders").withColumn("v", F.expr(obj(total="o_totalprice")))
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return api.quarantine(df, compiled, "v").withColumn("place", place).where("place <= 5").select("o_orderstatus", "place", "o_orderkey")


def nullable_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nullable` of OpenAPI 3.0 beside a type lets null through."""
    compiled = api.compile_schema('{"type":"object","properties":{"brand":{"type":"string","nullable":true,"maxLength":7},"size":{"type":"integer"}},"required":["brand"]}')
    df = read(spark, sf_dir, "part").select("p_brand", F.expr(obj(brand="if(p_size > 25, NULL, p_brand)", size="p_size")).alias("v"))
    return api.check(df, compiled, "v", "ok").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a schema says about a field (title, xml, extensions), as the storage's metadata."""
    compiled = api.compile_schema('{"type":"object","properties":{"a":{"type":"string","title":"Name","xml":{"attribute":true},"x-unit":"m"},"b":{"type":"boolean","default":false,"deprecated":true}}}')
    rows = [(f.name, k, v) for f in api.storage_schema(compiled).fields for k, v in sorted(f.metadata.items())]
    return spark.createDataFrame(rows, "field string, name string, value string")


TAGS = {
    "inferred": TAGGED,
    "declared": '{"$defs":{"A":{"type":"object","required":["t"],"properties":{"t":{"const":"a"}}},"B":{"type":"object","required":["t"],"properties":{"t":{"const":"b"}}}},"oneOf":[{"$ref":"#/$defs/A"},{"$ref":"#/$defs/B"}],"discriminator":{"propertyName":"t","mapping":{"a":"A","b":"B"}}}',
    "asserted": '{"$defs":{"A":{"type":"object","required":["t"],"properties":{"t":{"const":"a"}}},"B":{"type":"object","required":["t"],"properties":{"t":{"type":"string"}}}},"oneOf":[{"$ref":"#/$defs/A"},{"$ref":"#/$defs/B"}],"discriminator":{"propertyName":"t","mapping":{"a":"A","b":"#/$defs/B"}}}',
}


def tag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the property that tells a union's branches apart comes from, and how exact that is."""
    found = {n: api.compile_schema(x) for n, x in TAGS.items()}
    return spark.createDataFrame([(n, c.plan.route.source, c.plan.route.name, c.exactness.name) for n, c in found.items()], "schema_id string, source string, property string, exactness string")


SIMPLER = {
    "flattened": ('{"allOf":[{"allOf":[{"minimum":1}]},{"maximum":5}]}', '{"minimum":1,"maximum":5}'),
    "covered": ('{"allOf":[{"minimum":1},{"minimum":3}]}', '{"minimum":3}'),
    "contradiction": ('{"type":"string","allOf":[{"type":"number"}]}', "false"),
    "twice not": ('{"not":{"not":{"type":"string"}}}', '{"type":"string"}'),
    "unit any": ('{"anyOf":[{"type":"null"},true]}', "true"),
    "disjoint one": ('{"oneOf":[{"type":"string"},{"type":"number"}]}', '{"anyOf":[{"type":"string"},{"type":"number"}]}'),
    "same twice": ('{"oneOf":[{"minLength":2},{"minLength":2}]}', "false"),
    "distributed": ('{"type":"string","oneOf":[{"pattern":"a"},{"pattern":"b"}]}', '{"oneOf":[{"type":"string","pattern":"a"},{"type":"string","pattern":"b"}]}'),
    "other": ('{"minimum":1}', '{"exclusiveMinimum":1}'),
}


def simplified_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of schemas that the optimizer makes into one plan, and one pair that it must not."""
    rows = [(n, api.compile_schema(a).plan == api.compile_schema(b).plan) for n, (a, b) in SIMPLER.items()]
    return spark.createDataFrame(rows, "rule string, same boolean")


def plan_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plans inside a plan, by a fold over it."""
    return api.plan_rows(spark, {"list": api.compile_schema('{"type":"array","items":{"type":"object","required":["t"],"properties":{"t":{"enum":["a","b"]}}},"maxItems":3}')}).select(F.col("at").alias("place"), "shape", "route", "tests", "residual")


def reached_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that each plan reaches, through others and through itself."""
    schemas = {"tree": CORPUS["list"], "chain": '{"$defs":{"a":{"$ref":"#/$defs/b"},"b":{"type":"array","items":{"$ref":"#/$defs/c"}},"c":{"type":"null"},"d":{}},"$ref":"#/$defs/a"}'}
    rows = [(n, k) for n, x in schemas.items() for k in api.compile_schema(x).definitions]
    return spark.createDataFrame(rows, "schema_id string, definition string")


def inhabitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive schemas that no finite value satisfies, and some that look alike."""
    node = '{"$defs":{"N":%s},"$ref":"#/$defs/N"}'
    schemas = {
        "needs itself": node % '{"type":"object","required":["n"],"properties":{"n":{"$ref":"#/$defs/N"}}}',
        "may have itself": node % '{"type":"object","properties":{"n":{"$ref":"#/$defs/N"}}}',
        "empty list ends it": node % '{"type":"array","items":{"$ref":"#/$defs/N"}}',
        "either ends it": node % '{"anyOf":[{"type":"null"},{"type":"object","required":["n"],"properties":{"n":{"$ref":"#/$defs/N"}}}]}',
    }
    rows = [(n, any("uninhabited" in d.message for d in api.compile_schema(x).diagnostics)) for n, x in schemas.items()]
    return spark.createDataFrame(rows, "schema_id string, uninhabited boolean")


def refused_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which schemas are refused instead of being run unsoundly."""

    def refused(text: str) -> bool:
        try:
            api.check(spark.range(0).selectExpr("CAST(id AS VARIANT) AS v"), api.compile_schema(text), "v")
        except api.Refused:
            return True
        return False

    return spark.createDataFrame([(n, refused(x)) for n, x in CORPUS.items()], "schema_id string, refused boolean")


def pattern_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECMA-262 patterns on letters that other dialects see otherwise."""
    rows = [("space", r"^\s$", "\u00a0", True), ("space", r"^\s$", "\ufeff", True), ("space", r"^\s$", "\x01", False), ("digit", r"^\d$", "٣", False), ("word", r"^\w$", "é", False), ("dot", "^.$", "\u2028", False), ("dot", "^.$", "\x85", True), ("end", "a$", "a\n", False), ("unicode", r"^\u0041$", "A", True)]
    df = None
    for name, pattern, text, _ in rows:
        one = spark.createDataFrame([(name, text)], "name string, text string").withColumn("ok", F.lit(None).cast("boolean"))
        one = api.check(one, api.compile_schema({"type": "string", "pattern": pattern}), "text", "ok").select("name", F.hex("text").alias("text"), "ok")
        df = one if df is None else df.unionByName(one)
    return df


def plan_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a plan, line by line."""
    text = dump.plan_text(api.compile_schema('{"type":"object","required":["t"],"properties":{"t":{"type":"string","maxLength":3}},"additionalProperties":false}').plan)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def term_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a schema's term as it was read, line by line."""
    library = Library()
    node = library.add_document("", parse('{"anyOf":[{"type":"string","minLength":2},{"not":{"const":3}}]}'))
    library.resolve()
    return spark.createDataFrame(list(enumerate(dump.term_text(library.term(node.key)).split("\n"))), "line int, text string")


def stream_valid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship test over a stream of events, by day; all that is there, then it ends."""
    compiled = api.compile_schema(COUNTS["events_valid"].schema)
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rates = validate.valid_rate(stream, compiled, "props", "ts", "1 day")
    return validate.run_available(spark, rates, f"{shared_dir(spark)}/tessera-stream/{uuid.uuid4().hex}")


QUERIES: dict[str, Query] = {n: c.query for n, c in COUNTS.items()} | {
    f.__name__: f
    for f in (
        unique_items, array_bounds, enum_broadcast, quarantine, project_typed, route_property, route_count, evaluate_reasons, invalid_values, sql_function,
        recursive_ref, catalog_capability, catalog_diagnostics, reference_graph, document_components, one_component, loaded_documents, finding_places, requirements, plan_graph,
        storage_types, decoded_references, route_extremes, function_extremes, recursive_deep, format_never_rejects, typed_dates, top_rejected, nullable_keyword, annotations, tag_sources, simplified_terms,
        plan_walk, reached_definitions, inhabitation, refused_plans, pattern_dialects, plan_dump, term_dump, stream_valid_rate,
    )
}

LISTS = "SELECT l_orderkey, list(l_returnflag) AS flags, list(l_suppkey) AS suppliers FROM lineitem GROUP BY 1"
SQL: dict[str, str] = {n: c.sql() for n, c in COUNTS.items()} | {
    "unique_items": f"SELECT count(*) FILTER (WHERE len(flags) >= 2 AND len(list_distinct(flags)) = len(flags)) AS n_flags, count(*) FILTER (WHERE len(flags) >= 2 AND len(list_distinct(suppliers)) = len(suppliers)) AS n_suppliers FROM ({LISTS})",
    "array_bounds": f"SELECT l_orderkey, len(flags) BETWEEN 3 AND 5 AND NOT list_contains(flags, 'R') AS ok FROM ({LISTS})",
    "enum_broadcast": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1",
    "quarantine": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE NOT (o_totalprice <= 400000 AND regexp_matches(o_orderpriority, '^[1-4]'))",
    "project_typed": f"SELECT event_type, CAST(sum({K}) AS BIGINT) AS sum_k, CAST(max({K}) AS INT) AS max_k FROM events GROUP BY 1",
    "route_property": "SELECT CASE WHEN event_type IN ('click', 'view') THEN '\"' || event_type || '\"' END AS branch, count(*) AS n FROM events GROUP BY 1",
    "route_count": "SELECT CASE WHEN l_quantity > 30 THEN '0' WHEN l_quantity < 10 THEN '1' ELSE '0,1' END AS branch, count(*) AS n FROM lineitem GROUP BY 1",
    "evaluate_reasons": f"SELECT 'evaluated' AS status, {K} BETWEEN 20 AND 80 AS accepted, CASE WHEN {K} NOT BETWEEN 20 AND 80 THEN '/k' END AS path, CASE WHEN {K} < 20 THEN 'minimum' WHEN {K} > 80 THEN 'maximum' END AS rule, count(*) AS n FROM events GROUP BY 1, 2, 3, 4",
    "invalid_values": "SELECT CASE event_id % 4 WHEN 1 THEN 'invalid_value' WHEN 2 THEN 'no_instance' ELSE 'evaluated' END AS status, CASE WHEN event_id % 4 IN (0, 3) THEN true END AS accepted, count(*) AS n FROM events GROUP BY 1, 2",
    "sql_function": "SELECT l_linestatus, count(*) FILTER (WHERE l_discount >= 0.05::DOUBLE) AS n_valid FROM lineitem GROUP BY 1",
    "recursive_ref": "SELECT conv_id, CAST(count(*) AS INT) AS turns, bool_and(role IN ('user', 'assistant')) AS ok FROM conversations GROUP BY 1",
    "catalog_capability": """SELECT * FROM (VALUES
  ('any', 'DIRECT_TYPE', 'EXACT_REPRESENTATION', 'Straight'), ('never', 'DIRECT_TYPE', 'EXACT_REPRESENTATION', 'Straight'), ('switch', 'DIRECT_TYPE', 'EXACT_REPRESENTATION', 'Straight'),
  ('hours', 'TYPE_WITH_VALIDATION', 'EXACT_WITH_VALIDATION', 'Straight'), ('row', 'DIRECT_TYPE', 'EXACT_REPRESENTATION', 'Straight'), ('level', 'STATIC_DISPATCH', 'EXACT_WITH_VALIDATION', 'ByLiteral'),
  ('either', 'STATIC_DISPATCH', 'EXACT_WITH_VALIDATION', 'ByKind'), ('tagged', 'STATIC_DISPATCH', 'EXACT_WITH_VALIDATION', 'ByProperty'), ('fizz', 'PREDICATE_DISPATCH', 'EXACT_WITH_VALIDATION', 'ByCount'),
  ('guest', 'PREDICATE_DISPATCH', 'EXACT_WITH_VALIDATION', 'Straight'), ('rest', 'EVALUATION_STATE', 'UNSUPPORTED', 'Straight'), ('dynamic', 'DYNAMIC_RESOLUTION', 'UNSUPPORTED', 'Straight'),
  ('dangling', 'UNSUPPORTED', 'UNSUPPORTED', 'Straight'), ('cycle', 'UNSUPPORTED', 'UNSUPPORTED', 'Straight'), ('list', 'DIRECT_TYPE', 'EXACT_REPRESENTATION', 'Straight')
) t(schema_id, capability, exactness, route)""",
    "catalog_diagnostics": """SELECT schema_id, severity, CAST(n AS BIGINT) AS n FROM (VALUES
  ('fizz', 'warning', 1), ('guest', 'warning', 1), ('rest', 'error', 1), ('dynamic', 'error', 1), ('dangling', 'error', 2), ('cycle', 'error', 3)) t(schema_id, severity, n)""",
    "reference_graph": """SELECT * FROM (VALUES
  ('#', '#/$defs/tree', false, 'none'), ('#', '#/$defs/tree', false, 'none'), ('#/$defs/tree', '#/$defs/tree/properties/sub', true, 'guarded'),
  ('#/$defs/tree/properties/sub', '#/$defs/tree/properties/sub/items', true, 'guarded'), ('#/$defs/tree/properties/sub/items', '#/$defs/tree', false, 'guarded')) t(src, dst, descent, recursion)""",
    "document_components": """SELECT schema_id, capability, exactness, CAST(definitions AS INT) AS definitions, CAST(diagnostics AS INT) AS diagnostics FROM (VALUES
  ('Bad', 'DIRECT_TYPE', 'DECLARED_INCOMPLETE', 1, 1), ('Line', 'TYPE_WITH_VALIDATION', 'EXACT_WITH_VALIDATION', 2, 1), ('Order', 'TYPE_WITH_VALIDATION', 'EXACT_WITH_VALIDATION', 2, 1),
  ('Status', 'STATIC_DISPATCH', 'EXACT_WITH_VALIDATION', 1, 1)) t(schema_id, capability, exactness, definitions, diagnostics)""",
    "one_component": "SELECT * FROM (VALUES ('Line', 'UNSUPPORTED', 'UNSUPPORTED'), ('Status', 'STATIC_DISPATCH', 'EXACT_WITH_VALIDATION')) t(schema_id, capability, exactness)",
    "loaded_documents": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount BETWEEN 0.01::DOUBLE AND 0.07::DOUBLE AND l_tax BETWEEN 0.01::DOUBLE AND 0.07::DOUBLE) AS n_valid FROM lineitem GROUP BY 1",
    "finding_places": "SELECT severity, pointer, CAST(line AS INT) AS line FROM (VALUES ('error', '', 1), ('error', '/properties/a', 3), ('warning', '/properties/b', 4), ('error', '/properties/c', 5)) t(severity, pointer, line)",
    "requirements": "SELECT * FROM (VALUES ('free', 'evaluation_tracking', ''), ('space', 'regex_dialect', '/properties/p'), ('unique', 'json_equality', '')) t(schema_id, slot, pointer)",
    "plan_graph": """SELECT * FROM (VALUES
  ('root', 'root/property u', 'property u'), ('root', 'root/additional', 'additional'), ('root/property u', 'root/property u/kind string', 'kind string'), ('root/property u', 'root/property u/kind array', 'kind array'),
  ('root/property u/kind array', 'ref #/$defs/L', 'refers to'), ('root/additional', 'ref #/$defs/L', 'refers to'), ('ref #/$defs/L', 'ref #/$defs/L/item 0', 'item 0'), ('ref #/$defs/L', 'ref #/$defs/L/contains', 'contains')) t(src, dst, label)""",
    "storage_types": """SELECT * FROM (VALUES ('hours', 'double'), ('row', 'struct<_0:decimal(38,0),_rest:array<boolean>>'), ('switch', 'struct<on:boolean>'), ('list', 'variant'), ('int', 'bigint'), ('day', 'date'), ('map', 'map<string,double>')) t(schema_id, type)""",
    "decoded_references": """SELECT * FROM (VALUES ('x', '{"x":"s"}', true), ('x', '{"x":1}', false), ('y', '{"y":true}', true), ('y', '{"y":0}', false), ('z', '{"z":null}', true), ('z', '{"z":"n"}', false), ('w', '{"w":1}', false)) t(field, text, ok)""",
    "route_extremes": """SELECT * FROM (VALUES ('1e30', '0'), ('-1e30', '1'), ('1e-9', '1'), ('0', '1'), ('5', NULL), ('12345678901234567890123', '0'), ('9007199254740993', '0')) t(text, branch)""",
    "function_extremes": """SELECT * FROM (VALUES ('1e30', true), ('-1e30', false), ('1e-9', false), ('0', false), ('5', true), ('12345678901234567890123', true), ('9007199254740993', true)) t(text, ok)""",
    "recursive_deep": "SELECT n_nationkey, n_nationkey <= 12 AS ok FROM nation",
    "format_never_rejects": "SELECT n_regionkey, count(*) FILTER (WHERE n_regionkey <> 0) AS n_valid, count(*) FILTER (WHERE n_regionkey <> 0) AS n_approximated FROM nation GROUP BY 1",
    "typed_dates": "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2",
    "top_rejected": """SELECT * FROM (SELECT o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place, o_orderkey
  FROM orders WHERE o_totalprice > 300000) WHERE place <= 5""",
    "nullable_keyword": "SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25 OR length(p_brand) <= 7) AS n_valid FROM part GROUP BY 1",
    "annotations": """SELECT * FROM (VALUES ('a', 'title', '"Name"'), ('a', 'xml', '{"attribute":true}'), ('a', 'x-unit', '"m"'), ('b', 'default', 'false'), ('b', 'deprecated', 'true')) t(field, name, value)""",
    "tag_sources": "SELECT * FROM (VALUES ('inferred', 'inferred', 't', 'EXACT_WITH_VALIDATION'), ('declared', 'declared', 't', 'EXACT_WITH_VALIDATION'), ('asserted', 'asserted', 't', 'OVER_APPROXIMATION')) t(schema_id, source, property, exactness)",
    "simplified_terms": """SELECT rule, rule <> 'other' AS same FROM (VALUES ('flattened'), ('covered'), ('contradiction'), ('twice not'), ('unit any'), ('disjoint one'), ('same twice'), ('distributed'), ('other')) t(rule)""",
    "plan_walk": """SELECT place, shape, route, CAST(tests AS INT) AS tests, CAST(residual AS INT) AS residual FROM (VALUES
  ('', 'Sequence', 'Straight', 3, 1), ('/items', 'Record', 'Straight', 3, 1), ('/items/property t', 'Scalar', 'ByLiteral', 0, 0),
  ('/items/property t/value "a"', 'Scalar', 'ByLiteral', 1, 0), ('/items/property t/value "a"/value "a"', 'AnyShape', 'Straight', 0, 0),
  ('/items/property t/value "b"', 'Scalar', 'ByLiteral', 1, 0), ('/items/property t/value "b"/value "b"', 'AnyShape', 'Straight', 0, 0),
  ('/items/additional', 'AnyShape', 'Straight', 0, 0)) t(place, shape, route, tests, residual)""",
    "reached_definitions": "SELECT * FROM (VALUES ('tree', '#'), ('tree', '#/$defs/tree'), ('chain', '#'), ('chain', '#/$defs/a'), ('chain', '#/$defs/b'), ('chain', '#/$defs/c')) t(schema_id, definition)",
    "inhabitation": "SELECT * FROM (VALUES ('needs itself', true), ('may have itself', false), ('empty list ends it', false), ('either ends it', false)) t(schema_id, uninhabited)",
    "refused_plans": f"SELECT schema_id, schema_id IN ('rest', 'dynamic', 'dangling', 'cycle') AS refused FROM (VALUES {', '.join(f"('{n}')" for n in CORPUS)}) t(schema_id)",
    "pattern_dialects": """SELECT * FROM (VALUES ('space', 'C2A0', true), ('space', 'EFBBBF', true), ('space', '01', false), ('digit', 'D9A3', false), ('word', 'C3A9', false), ('dot', 'E280A8', false), ('dot', 'C285', true),
  ('end', '610A', false), ('unicode', '41', true)) t(name, text, ok)""",
    "plan_dump": """SELECT CAST(line AS INT) AS line, text FROM (VALUES (0, '{t} [TYPE_WITH_VALIDATION]'), (1, '  - is object'), (2, '  - properties [object]'), (3, '    property t: string [TYPE_WITH_VALIDATION]'), (4, '      - is string'),
  (5, '      - maxLength 3 [string]'), (6, '    additional: nothing [DIRECT_TYPE]'), (7, '      - is none'), (8, '  - required (''t'',) [object]')) t(line, text)""",
    "term_dump": "SELECT CAST(line AS INT) AS line, text FROM (VALUES (0, 'any of'), (1, '  all'), (2, '    kind string'), (3, '    minLength 2 [string]'), (4, '  not'), (5, '    equals 3')) t(line, text)",
    "stream_valid_rate": f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (WHERE {K} BETWEEN 0 AND 50) AS n_valid FROM events GROUP BY 1",
}
