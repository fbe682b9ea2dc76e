"""Schemas and instances as tables, read with Spark's own readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import Options, compile_schema
from ..plans.model import Compiled


def schema_files(spark: SparkSession, path: str) -> DataFrame:
    """schema_id (the file's name), text of every schema file under a path."""
    found = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return found.select(F.element_at(F.split("path", "/"), -1).alias("schema_id"), F.col("value").alias("text"))


def compile_files(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, Compiled]:
    """Every schema file compiled; schemas are documents that people write, and more than `most` is an error."""
    rows = schema_files(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} schema files under {path}")
    load = spark_loader(spark, path)
    return {r.schema_id: compile_schema(r.text, Options(base_uri=r.schema_id, loader=load)) for r in rows}


def spark_loader(spark: SparkSession, path: str) -> Callable[[str], bytes]:
    """A loader that reads <path>/<uri> through Spark, from wherever Spark can read; never from a network address."""

    def load(uri: str) -> bytes:
        if ":" in uri or ".." in uri.split("/"):
            raise ValueError(f"{uri} is not under {path}")
        return bytes(spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{uri}").select("content").first().content)

    return load


def instances(spark: SparkSession, path: str) -> DataFrame:
    """text, v of JSON lines; v is NULL where a line is not a value."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.expr("try_parse_json(value)").alias("v"))
