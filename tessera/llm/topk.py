"""Exact top-k inner products over a bit-sliced index.

Every component of a vector is an integer attribute; a block of rows stores it as bit slices, one
bitmap for each binary digit of its distance from the block's least value. A query's score is a sum
of shifted slices: each component of the query in signed binary digits picks the attribute's slices,
complemented for negative digits, and carry-save adders (XOR, AND, OR of bitmaps) reduce all of them
to one slice for each digit of the score. The best rows are then selected from the most significant
slice downward; among rows equal to the last digit, those with smaller ids are taken.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 16384
#: Integers below this in size have sums of products that fit 64 bits, for up to 2^14 components.
MODERATE = 2.0**24
MOST = 2**63 - 1
#: Tasks that the blocks are dealt to, at most; a task then has several blocks, one after the other.
MOST_TASKS = 20_000


def pack_rows(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitmaps of 64-bit words, first row in the lowest bit."""
    out = np.packbits(bits, axis=-1, bitorder="little")
    short = -out.shape[-1] % 8
    return np.ascontiguousarray(np.pad(out, [(0, 0)] * (out.ndim - 1) + [(0, short)])).view("<u8")


def integers(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: int64 where sums of products surely fit, else Python's integers."""
    if not x.size or np.abs(x).max() < MODERATE / scale:
        return np.floor(scale * x).astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(Fraction(v) * scale)
    return np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slices[attribute, digit, word], least value of each attribute) of values[row, attribute]."""
    low = values.min(0)
    up = values - low
    digits = max(1, int(up.max()).bit_length())
    return np.stack([pack_rows((up >> b & 1).T.astype(bool)) for b in range(digits)], 1), low


def signed_digits(q: np.ndarray) -> np.ndarray:
    """digits[attribute, place] in -1, 0, 1 with few of them not 0 (non-adjacent form)."""
    out = []
    while q.any():
        d = np.where((q & 1).astype(bool), 2 - (q & 3), 0)
        out.append(d.astype(np.int64))
        q = (q - d) >> 1
    return np.stack(out, 1) if out else np.zeros((len(q), 1), np.int64)


def add_columns(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One slice for each place of the sum; columns[i] holds the slices of weight 2^i."""
    out, carries, i = [], [], 0
    while i < len(columns) or carries:
        parts = ([columns[i]] if i < len(columns) and len(columns[i]) else []) + carries
        col, carries = (np.concatenate(parts) if parts else None), []
        while col is not None and len(col) > 1:
            n = len(col) // 3 * 3
            if n:
                a, b, c = col[:n:3], col[1:n:3], col[2:n:3]
                x = a ^ b
                carries.append(a & b | c & x)
                col = np.concatenate([x ^ c, col[n:]])
            else:
                carries.append((col[:1] & col[1:]))
                col = col[:1] ^ col[1:]
        out.append(col[0] if col is not None else None)
        i += 1
    return out


def best(score: list[np.ndarray | None], among: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores among a bitmap's rows; equal scores: the first rows."""
    sure, equal = np.zeros_like(among), among
    need = min(k, int(np.bitwise_count(among).sum()))
    for s in reversed(score):
        one = equal & s if s is not None else np.zeros_like(among)
        n = int(np.bitwise_count(sure | one).sum())
        if n > need:
            equal = one
        else:
            sure = sure | one
            equal = equal & ~s if s is not None else equal
            if n == need:
                equal = np.zeros_like(among)
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    ties = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[: need - len(rows)]
    return np.concatenate([rows, ties])


def search_block(ids: np.ndarray, slices: np.ndarray, low: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best rows of the block, without those of the query's own id."""
    d, digits, width = slices.shape
    both = np.stack([slices, ~slices]).reshape(2 * d * digits, width)
    every = pack_rows(np.ones(len(ids), bool))
    full, place = (1 << digits) - 1, np.arange(digits)
    out = []
    for qid, q in zip(query_ids.tolist(), queries):
        sd = signed_digits(q)
        dim, shift = np.nonzero(sd)
        sign = sd[dim, shift]
        rows = ((sign < 0) * d * digits + dim * digits)[:, None] + place
        column = (shift[:, None] + place).ravel()
        rows, order = rows.ravel(), np.argsort(column, kind="stable")
        cuts = np.searchsorted(column[order], np.arange(sd.shape[1] + digits))
        columns = [both[rows[order[a:b]]] for a, b in zip(cuts[:-1], cuts[1:])]
        score = add_columns(columns)
        own, after = np.searchsorted(ids, [qid, qid + 1])
        among = every if own == after else every & ~pack_rows((np.arange(len(ids)) >= own) & (np.arange(len(ids)) < after))
        negative = sum(1 << k for k in shift[sign < 0].tolist())
        constant = sum(int(x) * int(y) for x, y in zip(q, low)) - full * negative
        for r in best(score, among, k).tolist():
            total = sum((int(s[r // 64]) >> (r % 64) & 1) << i for i, s in enumerate(score) if s is not None)
            out.append((qid, int(ids[r]), total + constant))
    return out


def usable(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    """row (a number of its own), vec_id, e (array of double), dims: a table without vectors that are null, empty or have null or non-finite components."""
    v = vectors.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) e")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & ~bad)
    return table(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "e", F.size("e").alias("dims")), spark)


INDEX = "dims int, block bigint, ids binary, low binary, digits int, slices binary"


def build_index(vectors: DataFrame, spark: SparkSession, block: int = BLOCK, scale: int = 256) -> tuple[DataFrame, DataFrame]:
    """(index, blocks of each number of components): a row of bitmaps for about so many vectors, dealt by their row numbers.

    Rows of one vec_id are dealt like others, so that an id that many rows share fills no block alone.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        slices, low = slices_of(integers(np.stack(pdf.e.to_numpy()), scale))
        return pd.DataFrame({"dims": [pdf.dims.iloc[0]], "block": [pdf.block.iloc[0]], "ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "low": [pickle.dumps(low)], "digits": [slices.shape[1]], "slices": [slices.tobytes()]})

    counts = table(vectors.groupBy("dims").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("blocks")).withColumnRenamed("dims", "of"), spark)
    placed = vectors.join(counts, F.col("dims") == F.col("of")).select("dims", "vec_id", "e", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
    index = placed.groupBy("dims", "block").applyInPandas(build, INDEX)
    return table(index, spark), counts


def top_k(vectors: DataFrame, is_query: F.Column, spark: SparkSession, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors of as many components (all, if fewer).

    is_query is a condition on vec_id. Ties go to the smaller vec_id. Vectors that are null, empty or have a
    null or non-finite component, and those without an id, take no part. Of rows that share a vec_id each is
    a candidate of its own (and may come twice); none is one for a query of that id, and if the id is a
    query's, the best over its rows count. A score that is no long is given as the nearest long; ranks
    are by the true one. An empty table gives an empty table; columns besides vec_id and embedding are not
    read. Queries go to the blocks of the index (about 16,384 rows each), which stay where they are: a task
    holds one block and reads its queries in batches.
    """
    names = ["query_id", "vec_id", "score", "over", "true"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows: list[tuple] = []
            kinds = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            cuts = sorted({0, *kinds, *(i + 1 for i in kinds), batch.num_rows})
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if a in kinds:
                    r = {c: part.column(c)[0].as_py() for c in ("dims", "ids", "low", "digits", "slices")}
                    held = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["slices"], "<u8").reshape(r["dims"], r["digits"], -1), pickle.loads(r["low"]))
                    continue
                queries = integers(np.stack(part.column("e").to_numpy(zero_copy_only=False)), scale)
                rows += search_block(*held, part.column("vec_id").to_numpy(), queries, k)
            if rows:
                over = [(s > MOST) - (s < -MOST) for _, _, s in rows]
                true = [(s + (1 << 2200)).to_bytes(300, "big") if o else None for (_, _, s), o in zip(rows, over)]
                score = [min(max(s, -MOST), MOST) for _, _, s in rows]
                cols = [[r[0] for r in rows], [r[1] for r in rows], score, over, true]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)

    vectors = usable(vectors, spark)
    index, counts = build_index(vectors, spark, scale=scale)
    blocks = counts.agg(F.sum("blocks")).first()[0] or 0
    queries = vectors.where(is_query).join(counts, F.col("dims") == F.col("of")).select("dims", "vec_id", "e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    both = index.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(min(max(int(blocks), 1), MOST_TASKS), "dims", "block").sortWithinPartitions("dims", "block", "kind")
    found = both.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint, over int, true binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("true"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
