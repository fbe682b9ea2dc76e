"""Validation of streams. It keeps no state, so the batch expressions run as they are; rates are windowed aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api
from ..plans.model import Compiled


def validated(stream: DataFrame, compiled: Compiled, text: str) -> DataFrame:
    """The stream with `accepted`, from a column of JSON text."""
    return api.check(stream.withColumn("_v", api.from_json(text)), compiled, "_v", "accepted", text).drop("_v")


def valid_rate(stream: DataFrame, compiled: Compiled, text: str, time: str, window: str, late: str = "1 hour") -> DataFrame:
    """start, n, n_valid for each window of event time; rows later than the watermark are left out, as streams do."""
    timed = validated(stream, compiled, text).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window)).agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_valid")).select(F.col("window.start").alias("start"), "n", "n_valid")


def run_available(spark: SparkSession, frame: DataFrame, path: str) -> DataFrame:
    """The windows of what is there now, as a table under the path, beside its checkpoint.

    Each batch's last state of a window is written as a part of its own; the latest part of a window counts.
    A batch that is run again writes over its own part.
    """
    keys = [c for c in frame.columns if c not in ("n", "n_valid")]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    frame.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frame.schema)}, batch bigint").parquet(f"{path}/parts")
    latest = F.max_by(F.struct(*(c for c in frame.columns if c not in keys)), "batch")
    return parts.groupBy(*keys).agg(latest.alias("r")).select(*keys, "r.*")


def split(stream: DataFrame, compiled: Compiled, text: str, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Accepted rows to one Parquet table, the others to another. A batch that is run again writes over its own part, so restarts repeat no rows."""

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        batch.where("accepted").write.mode("overwrite").parquet(f"{good}/{part}")
        batch.where("accepted is null or not accepted").write.mode("overwrite").parquet(f"{bad}/{part}")

    return validated(stream, compiled, text).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
