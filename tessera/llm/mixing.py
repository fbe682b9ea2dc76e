"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source takes each document so many times as its target
holds all of the source, and once more the documents whose hash is below a threshold, chosen so that
the words below it come as near under the remaining budget as whole documents allow. Thresholds come
from histograms: words summed by source and the leading 10 bits of the hash; the bucket in which the
budget ends is split by the next 10 bits, and so on, six times. Only bucket sums move: no sort, and
thresholds of a smaller budget lie below those of a larger one, so that mixes are nested.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunked, released, table, words

# Weights repeat over the sources in order; a source is taken at most so many times.
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BITS, LEVELS = 10, 6


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words in the text, null: 0) and hash of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            n = pa.array([len(words(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, batch.column("hash")], names=["doc_id", "source", "size", "hash"])

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), hashed().alias("hash"))
    return kept.mapInArrow(released(count), "doc_id bigint, source string, size bigint, hash bigint")


def hashed() -> Column:
    """60 bits of the MD5 of doc_id as text; of source and text where there is no doc_id."""
    own = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "text")))
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), own)
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def running(df: DataFrame, spark: SparkSession, order: list[Column], *names: str) -> tuple[DataFrame, list[int]]:
    """(df with `place`, a row's number from 0 in the order, and `before_x` for each name x, its sum over the rows before; the whole sums).

    Rows are dealt by ranges of the order. Only the counts and sums of each range come to the driver: as many as there are partitions.
    """
    parts = table(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), spark)
    sums = parts.groupBy("range").agg(F.count("*"), *(F.sum(n) for n in names)).collect()
    starts, so_far = [], [0] * (1 + len(names))
    for r in sorted(sums):
        starts.append((r[0], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:])]
    fields = ", ".join(["of int", "rows0 bigint", *(f"{n}0 bigint" for n in names)])
    out = parts.join(F.broadcast(spark.createDataFrame(starts, fields)), F.col("range") == F.col("of"))
    inside = Window.partitionBy("range").orderBy(*order)
    before = {f"before_{n}": F.col(f"{n}0") + F.coalesce(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in names}
    out = out.withColumns({"place": F.col("rows0") + F.row_number().over(inside) - 1} | before)
    return out.drop("range", "of", "rows0", *(f"{n}0" for n in names)), so_far[1:]


def targets(sized: DataFrame, spark: SparkSession) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 over the sources by code point, null last; caps reshared by weight.

    Sources are ordered by cap over weight; the first whose share of what the ones before leave stays
    under its cap sets the level for it and all that follow. The frame has a row for each source; there may
    be as many as sites.
    """
    name = [F.col("source").isNull(), F.col("source")]
    by, _ = running(sized.groupBy("source").agg(F.sum("size").alias("source_size")), spark, name)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight")).drop("place")
    by, (cap, weights) = running(by, spark, [F.col("ratio"), *name], "cap", "weight")
    by = table(by.withColumn("level", (F.lit(cap // MOST_REPEATS) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight"))), spark)
    open_ = by.where("level <= ratio").agg(F.min(F.struct("place", "level")).alias("r")).first()
    level = open_.r.level if open_.r else float("inf")
    target = F.when(F.col("ratio") <= F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return by.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, spark: SparkSession) -> DataFrame:
    """source, source_size, target, full (times all of it), below (hashes under it count once more).

    At each level the budget's bucket is found among 2^BITS sums a source and only it is split on.
    """
    size = F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    full = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / size)).cast("bigint")
    state = wanted.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("bigint"))
    for level in range(LEVELS):
        high, low = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        top = F.shiftright(F.col("hash"), high) if level else F.lit(0).cast("bigint")
        some = sized.where("size > 0").select(F.col("source").alias("s"), top.alias("p"), F.shiftright(F.col("hash"), low).alias("bucket"), "size")
        sums = some.join(state.select("source", "prefix"), F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix"))) if level else some.withColumn("source", F.col("s"))
        sums = sums.groupBy(F.col("s"), "bucket").agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", run)
        hit = sums.join(state.select("source", "left"), F.col("s").eqNullSafe(F.col("source")))
        hit = hit.where(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("bucket", F.col("upto") - F.col("n"))).alias("hit"))
        hit = hit.select("s", F.col("hit.bucket").alias("b"), F.col("hit.col2").alias("used"))
        state = table(state.join(hit, F.col("s").eqNullSafe(F.col("source")), "left").select(
            "source", "source_size", "target", "full",
            (F.col("left") - F.coalesce(F.col("used"), F.lit(0))).alias("left"),
            # Without such a bucket all that is in reach fits: the next level searches past it and finds nothing.
            F.coalesce(F.col("b"), F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
        ), spark)
    return state.select("source", "source_size", "target", "full", F.col("prefix").alias("below"))


def mix(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source).

    A null text has size 0 and is taken 0 times over; a null source is a source of its own, ordered
    last; rows of one doc_id share a hash and are taken alike; rows without one are hashed by source and text,
    so that they are taken one by one.
    An empty table gives an empty table. Columns besides the three are not read. The rows are cut to a
    table of ids, sources, sizes and hashes once; thresholds (one row for each source) are found by six
    aggregations over it, each of at most 1024 sums a source.
    """
    sized = table(sizes(docs), spark)
    out = taking(sized, sized, spark)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def taking(rows: DataFrame, sized: DataFrame, spark: SparkSession) -> DataFrame:
    """rows (source, hash and whatever else) with source_size, target and times, from the thresholds that sized gives."""
    found = thresholds(sized, table(targets(sized, spark), spark), spark)
    found = found.select(F.col("source").alias("s"), "source_size", "target", "full", "below")
    out = rows.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    times = F.col("full") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return out.withColumn("times", F.least(times, F.lit(MOST_REPEATS)))


def repeated(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    names = docs.columns
    out = taking(docs.withColumn("hash", hashed()), table(sizes(docs), spark), spark)
    return out.where("times > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*names)
