"""JSON Schema on Spark: compile a schema, then validate, explain, route and store whole columns of JSON.

Instances are VARIANT columns, from JSON text or from typed columns. Three states are kept apart: a
JSON null is evaluated, text that isn't JSON is `invalid_value`, and a SQL NULL is `no_instance`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import lower
from .operators.instance import Refused
from .plans import interp
from .plans.compiler import Options, compile_component, compile_document, compile_schema, table_loader
from .plans.model import Capability, Compiled, Exactness, Named, Plan, Record, walk
from .plans.source import BadSchema, Library, parse
from .plans.values import InvalidValue, decode
from .ship import ship

__all__ = [
    "BadSchema", "Capability", "Compiled", "Exactness", "Options", "Refused", "accepts", "branches", "catalog", "check", "compile_component", "compile_document",
    "compile_schema", "diagnostics", "evaluate", "from_columns", "from_json", "literal_filter", "needs", "plan_rows", "project", "quarantine", "reference_edges", "register", "route", "routed", "storage_schema", "table_loader",
]

#: Numbers whose digits or exponents VARIANT does not keep, and text after the value: only the exact evaluator reads those.
HAZARD = r"[0-9.]{38}|[0-9.]{17}[eE]|[eE][+-]?[0-9]{3}"


def from_json(text: str) -> Column:
    """A VARIANT column from a column of JSON text; NULL where the text is not one value."""
    return F.expr(f"try_parse_json(`{text}`)")


def from_columns(**columns: str) -> Column:
    """A VARIANT object from SQL expressions; a NULL becomes a JSON null."""
    return F.expr("to_variant_object(named_struct(" + ", ".join(f"{lower.quoted(n)}, {e}" for n, e in columns.items()) + "))")


def _exact(compiled: Compiled):
    """The exact evaluator as a UDF on JSON text; it skips NULLs, so rows that are decided natively cost no evaluation."""
    blob = pickle.dumps(compiled)

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        plan = pickle.loads(blob)

        def one(text: str | None) -> bool | None:
            if text is None:
                return None
            try:
                return interp.interpret(plan, decode(text)).accepted
            except InvalidValue:
                return None

        for part in parts:
            yield part.map(one, na_action="ignore").astype("object")

    return run


def _exact_branch(compiled: Compiled):
    """The exact evaluator's branch as a UDF on JSON text."""
    blob = pickle.dumps(compiled)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        plan = pickle.loads(blob)
        for part in parts:
            yield part.map(lambda text: None if text is None else interp.branch(plan, decode(text)), na_action="ignore").astype("object")

    return run


def _hazard(text: str, given: Column) -> Column:
    """Text that VARIANT does not keep as it is: a huge number, more digits than a DOUBLE has, a duplicate name."""
    return F.col(f"`{text}`").rlike(HAZARD) | (F.col(f"`{text}`").isNotNull() & ~given)


def accepts(compiled: Compiled, variant: str, text: str | None = None, exact: bool = True) -> Column:
    """Whether each value of a VARIANT column is accepted; NULL where there is no value.

    The plan runs as one native expression. Rows that it leaves undecided (see operators.lower) go to
    the exact evaluator, as JSON text: that of the column `text` if given, else printed from the VARIANT.
    With exact=False they stay NULL. Plans that cannot be run soundly raise Refused. Where the frame is
    at hand, check() is faster, and takes typed columns too.
    """
    ship()
    low = lower.lowered(compiled, f"`{variant}`")
    if low.unsure and exact:
        low = lower.lowered(compiled, f"`{variant}`", flat=True)
    given = F.col(f"`{variant}`").isNotNull()
    native = F.expr(f"CASE WHEN `{variant}` IS NOT NULL THEN {low.closed()} END")
    if text is None:
        if not low.unsure or not exact:
            return native
        return F.coalesce(native, _exact(compiled)(F.when(given & native.isNull(), F.expr(f"to_json(`{variant}`)"))))
    hazard = _hazard(text, given)
    if not exact:
        return F.when(~hazard, native)
    undecided = hazard | native.isNull() if low.unsure else hazard
    return F.coalesce(F.when(~hazard, native), _exact(compiled)(F.when(undecided, F.col(f"`{text}`"))))


def _text_of(column: str, kind: T.DataType) -> str:
    """SQL for the JSON text of a VARIANT or typed column."""
    if isinstance(kind, T.VariantType):
        return f"to_json(`{column}`)"
    return f"to_json(to_variant_object(`{column}`))" if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else f"to_json(CAST(`{column}` AS VARIANT))"


def _stepped(df: DataFrame, low: lower.Lowered) -> DataFrame:
    for level in low.steps:
        df = df.withColumns({name: F.expr(text) for name, text in level})
    return df


def _prefix(df: DataFrame) -> str:
    """A prefix that no column's name has."""
    n = 0
    while any(c.lower().startswith(f"_t{n}_") for c in df.columns):
        n += 1
    return f"_t{n}_"


def check(df: DataFrame, compiled: Compiled, column: str, into: str = "accepted", text: str | None = None, exact: bool = True) -> DataFrame:
    """df with a column that tells whether the value of `column` is accepted; NULL where there is no value.

    A VARIANT is tested as JSON. A struct, array, map or plain column is tested by its own type, without
    making JSON of it: a NULL inside is a JSON null, a NULL at the root no value. What the plan needs of
    a value is computed once, in columns below the test. Only if the plan cannot be decided natively for
    all values does the frame have a Python operator; it gets the undecided rows' text and NULL for the
    others. `text`, `exact` and refusals are as for accepts().
    """
    ship()
    kind, prefix = df.schema[column].dataType, _prefix(df)
    low = lower.lowered(compiled, f"`{column}`", kind, prefix=f"{prefix}s")
    names = [c for c in df.columns if c != into]
    given, unsure = F.col(f"`{column}`").isNotNull(), low.unsure
    native = F.when(given, F.expr(low.accept))
    if text is not None:
        native, unsure = F.when(~_hazard(text, given), native), True
    out = _stepped(df, low)
    if not unsure or not exact:
        return out.select(*(F.col(f"`{c}`") for c in names), native.alias(into))
    given = given if text is None else F.col(f"`{text}`").isNotNull()
    source = F.expr(_text_of(column, kind)) if text is None else F.col(f"`{text}`")
    out = out.select(*(F.col(f"`{c}`") for c in names), native.alias(f"{prefix}native"), given.alias(f"{prefix}given"))
    decided = F.col(f"{prefix}native")
    rest = _exact(compiled)(F.when(F.col(f"{prefix}given") & decided.isNull(), source))
    return out.select(*(F.col(f"`{c}`") for c in names), F.coalesce(decided, rest).alias(into))


VERDICT = "status string, accepted boolean, reasons array<struct<path: string, constraint: string, detail: string>>, approximated array<string>"


def evaluate(compiled: Compiled, text: str) -> Column:
    """A verdict for each JSON text: struct(status, accepted, reasons innermost first, approximated constraints).

    The exact evaluator runs on every row here; use accepts() where the answer alone is asked for.
    """
    if compiled.capability >= Capability.EVALUATION_STATE:
        raise Refused(f"{compiled.capability.name}: " + "; ".join(d.message for d in compiled.diagnostics if d.severity == "error"))
    ship()
    blob = pickle.dumps(compiled)

    @F.pandas_udf(VERDICT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plan = pickle.loads(blob)
        for part in parts:
            rows = []
            for x in part:
                if x is None:
                    rows.append(("no_instance", None, [], []))
                    continue
                try:
                    v = interp.interpret(plan, decode(x))
                except InvalidValue:
                    rows.append(("invalid_value", None, [], []))
                    continue
                rows.append(("evaluated", v.accepted, [{"path": r.path, "constraint": r.constraint, "detail": r.detail} for r in v.reasons], v.approximated))
            yield pd.DataFrame(rows, columns=["status", "accepted", "reasons", "approximated"])

    return run(F.col(f"`{text}`"))


def route(compiled: Compiled, variant: str) -> Column:
    """The name of the root's branch that each value of a VARIANT column takes; NULL if it takes none, or there is no value."""
    ship()
    low = lower.branch(compiled, f"`{variant}`")
    if low.unsure:
        low = lower.branch(compiled, f"`{variant}`", flat=True)
    native = F.expr(f"CASE WHEN `{variant}` IS NOT NULL THEN {low.closed()} END")
    if not low.unsure:
        return native
    unknown = native == lower.UNKNOWN_BRANCH
    return F.when(unknown, _exact_branch(compiled)(F.when(unknown, F.expr(f"to_json(`{variant}`)")))).otherwise(native)


def routed(df: DataFrame, compiled: Compiled, column: str, into: str = "branch") -> DataFrame:
    """df with the name of the root's branch that each value takes, of a VARIANT or typed column as in check()."""
    ship()
    kind, prefix = df.schema[column].dataType, _prefix(df)
    low = lower.branch(compiled, f"`{column}`", kind, prefix=f"{prefix}s")
    names = [F.col(f"`{c}`") for c in df.columns if c != into]
    out = _stepped(df, low).select(*names, F.when(F.col(f"`{column}`").isNotNull(), F.expr(low.accept)).alias(into if not low.unsure else f"{prefix}native"))
    if not low.unsure:
        return out
    native = F.col(f"{prefix}native")
    rest = _exact_branch(compiled)(F.when(native == lower.UNKNOWN_BRANCH, F.expr(_text_of(column, kind))))
    return out.select(*names, F.when(native == lower.UNKNOWN_BRANCH, rest).otherwise(native).alias(into))


def project(compiled: Compiled, variant: str) -> Column:
    """Each value in its storage type; parts that do not fit are NULL. Storage never decides acceptance."""
    return F.expr(lower.stored(compiled, compiled.plan, f"`{variant}`"))


def storage_schema(compiled: Compiled) -> T.DataType:
    """The storage type, with titles, descriptions, defaults, x- extensions and the like as the fields' metadata (JSON text by name)."""

    def described(kind: T.DataType, plan: Plan) -> T.DataType:
        shape = plan.shape
        while isinstance(shape, Named) and shape.name in compiled.definitions and not shape.recursive:
            shape = compiled.definitions[shape.name].shape
        if not isinstance(kind, T.StructType) or not isinstance(shape, Record):
            return kind
        own = {f.name: f for f in shape.fields}
        return T.StructType([T.StructField(f.name, described(f.dataType, own[f.name].plan), True, dict(own[f.name].meta.items)) if f.name in own else f for f in kind.fields])

    return described(T._parse_datatype_string(lower.storage_type(compiled, compiled.plan.shape, compiled.plan.tests)), compiled.plan)


def quarantine(df: DataFrame, compiled: Compiled, column: str, text: str | None = None) -> DataFrame:
    """Rows whose value is not accepted, or is not a value at all; VARIANT or typed column as in check()."""
    into = f"{_prefix(df)}accepted"
    if isinstance(df.schema[column].dataType, T.VariantType):  # a filter moves below columns and would repeat them
        return df.where(~F.coalesce(accepts(compiled, column, text), F.lit(False)))
    return check(df, compiled, column, into, text).where(~F.coalesce(F.col(into), F.lit(False))).drop(into)


def literal_filter(df: DataFrame, column: str, literals: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose value is (keep=False: isn't) one of a table's: an enum too large for an expression. Spark broadcasts the table if it is small."""
    one = literals.select(F.col(key).alias("_literal")).distinct()
    return df.join(one, F.col(f"`{column}`") == F.col("_literal"), "left_semi" if keep else "left_anti")


def register(spark: SparkSession, name: str, compiled: Compiled, partial: bool = False) -> None:
    """A temporary SQL function name(VARIANT) that tells whether the value is accepted; NULL where there is none.

    A SQL function cannot call the exact evaluator, so a plan that may leave values undecided is refused,
    unless partial: then it gives NULL for those.
    """
    if not name.isidentifier():
        raise ValueError(f"{name} is no function name")
    low = lower.lowered(compiled, "v")
    if low.unsure and not partial:
        raise Refused(f"{name} could not decide all values natively; use check(), or partial=True")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v VARIANT) RETURNS BOOLEAN RETURN CASE WHEN v IS NOT NULL THEN {low.closed()} END")


# --- what compiling found, as tables ---


def catalog(spark: SparkSession, compiled: dict[str, Compiled]) -> DataFrame:
    """A row for each schema: capability, exactness, and how much there is to say about it."""
    rows = [(n, c.capability.name, c.exactness.name, type(c.plan.route).__name__, len(c.definitions), len(c.diagnostics), len(c.needs)) for n, c in sorted(compiled.items())]
    return spark.createDataFrame(rows, "schema_id string, capability string, exactness string, route string, definitions int, diagnostics int, needs int")


def diagnostics(spark: SparkSession, compiled: dict[str, Compiled]) -> DataFrame:
    rows = [(n, d.severity, d.pointer, d.line, d.column, d.message) for n, c in sorted(compiled.items()) for d in c.diagnostics]
    return spark.createDataFrame(rows, "schema_id string, severity string, pointer string, line int, column int, message string")


def needs(spark: SparkSession, compiled: dict[str, Compiled]) -> DataFrame:
    rows = [(n, x.slot, x.pointer, x.detail) for n, c in sorted(compiled.items()) for x in c.needs]
    return spark.createDataFrame(rows, "schema_id string, slot string, pointer string, detail string")


def plan_rows(spark: SparkSession, compiled: dict[str, Compiled]) -> DataFrame:
    """A row for each plan inside each schema, by the edges that lead to it."""
    rows = [(n, at, type(p.shape).__name__, type(p.route).__name__, len(p.tests), len(p.residual()), p.capability.name) for n, c in sorted(compiled.items()) for at, p in walk(c.plan)]
    return spark.createDataFrame(rows, "schema_id string, at string, shape string, route string, tests int, residual int, capability string")


def branches(spark: SparkSession, compiled: Compiled) -> DataFrame:
    from .plans.model import route_plans

    return spark.createDataFrame([(n, p.capability.name) for n, p in route_plans(compiled.plan.route)], "branch string, capability string")


def reference_edges(spark: SparkSession, text: str | bytes | dict) -> DataFrame:
    """The reference graph: from, to, whether the edge descends into the instance, and the recursion of its start."""
    library = Library()
    library.add_document("", parse(text) if isinstance(text, str | bytes) else text)
    library.resolve()
    kinds = library.recursion()
    return spark.createDataFrame([(a, b, d, kinds.get(a, "none")) for a, b, d in library.edges], "src string, dst string, descent boolean, recursion string")
