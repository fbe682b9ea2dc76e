"""N-gram Jaccard join with Bayesian candidate pruning.

1. Documents with the same set of shingles (five words) form a class; one signature of 200 MinHash
   values stands for it.
2. Banding (40 bands of 5 values at a threshold of 0.8) proposes groups. Bands whose groups are equal are looked at once.
   Large groups are dealt out in pairs of blocks. Within a group MinHash values are compared 20 at a
   time; a pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold is below the tolerance. Each block pair returns a spanning forest of what is left.
3. The forest's components are sets within which every link must lie. Each is verified exactly, again
   in pairs of blocks: survivors of the same pruning are compared by their sets of shingles. Per class
   the number of linked documents, and a spanning forest of the links, come out; no list of pairs is
   ever made.
4. The components of the links are the groups.

A pair at a similarity of exactly 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.3e-7; the ten
steps of pruning lose it with a probability of 8.5e-6. At 0.9 both are below 1e-15. With other thresholds
the bands are as large as keeps the first below 2e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, carried, chunked, grams, mix, packed, released, signed, table, words
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
VALUES, STEP = 200, 20
#: What banding may miss of pairs at the threshold, and what a step of pruning may.
MISSED, TOLERANCE = 2e-7, 1e-6
BLOCK = 512

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest of n equal MinHash values with which P(similarity >= threshold) is not below the tolerance (uniform prior)."""
    # With m matches the posterior is Beta(m + 1, n - m + 1); P(X >= t) = P(Binomial(n + 1, t) <= m).
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def shingles(text: str | None, hashes: WordHash, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of all words together if there are fewer; none for a text without words."""
    return shingle_sets([words(text)], hashes, k)[0]


def shingle_sets(docs: list[list[bytes]], hashes: WordHash, k: int = SHINGLE) -> list[np.ndarray]:
    flat, starts = hashes.flat(docs)
    every, out = grams(flat, k), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = b - a
        if n >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(grams(flat[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of 16 bits (the low bits of minima of 32 bits)."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _A
        part += _B
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(0), out=out)
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def band_size(threshold: float = THRESHOLD) -> int:
    """The most values a band may have so that pairs at the threshold share one, but for a chance of MISSED."""
    sizes = [k for k in range(8, 0, -1) if (1 - threshold**k) ** (VALUES // k) <= MISSED]
    if not sizes:
        raise ValueError(f"{VALUES} values cannot find pairs at a similarity of {threshold}")
    return sizes[0]


def band_keys(sig: np.ndarray, size: int) -> np.ndarray:
    """signed[row, band] keys of signatures[row, value]; values that fill no band are left out."""
    bands = VALUES // size
    v = sig[:, : bands * size].reshape(len(sig), bands, size).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, j] + np.uint64(1))
    return signed(h)


class Pruner:
    def __init__(self, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> None:
        self.least = [least_matches(threshold, tolerance, n) for n in range(STEP, VALUES + 1, STEP)]

    def survivors(self, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (left[i], right[j]) that no step drops."""
        equal = np.zeros(len(i), np.int32)
        for step, least in enumerate(self.least):
            if not len(i):
                break
            at = slice(step * STEP, (step + 1) * STEP)
            equal += (left[i, at] == right[j, at]).sum(1, dtype=np.int32)
            keep = equal >= least
            if not keep.all():
                i, j, equal = i[keep], j[keep], equal[keep]
        return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes 0 to n - 1 linked by (i, j): the nodes that aren't the first of their component, and that first node."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|sets[i] & sets[j]| of each pair, exactly."""
    if len(i) <= 8:
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)), np.int64, len(i))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out[i, j].astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows whose first columns are equal; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(k[a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def dealt(members: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Rows of members once for each pair of blocks that its block is in: columns x <= y, and mine, the row's block.

    A group of more than BLOCK rows has ceil(size / BLOCK) blocks by a hash of the node.
    """
    blocks = F.ceil(F.col(size) / F.lit(float(BLOCK))).cast("int")
    mine = F.pmod(F.xxhash64(node, F.lit(3)), blocks).cast("int")
    out = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))


def block_pairs(mine: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of block x with rows of block y; within one block, each once."""
    if x == y:
        return np.triu_indices(len(mine), 1)
    a, b = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def named(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles, as two longs."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def classes(docs: DataFrame, spark: SparkSession, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, h1, h2 of every row, and what to keep of it; cls, h1, h2, doc_id (least), copies, sig of every class).

    Texts without words have null h1 and h2. A class is told by 128 bits of a hash of its set of shingles, and numbered by one of its rows.
    """
    rest, schema = carried(docs, tuple(c for c in keep if c != "doc_id"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in chunked(batches):
            sets = shingle_sets([words(t) for t in batch.column("text").to_pylist()], hashes)
            names = [named(s) if len(s) else (None, None) for s in sets]
            sig = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column("doc_id"), *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)), sig], names=[*rest, "doc_id", "h1", "h2", "sig"])

    read = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *(c for c in rest if c != "text"))
    rows = read.mapInArrow(released(sign), schema + "doc_id bigint, h1 bigint, h2 bigint, sig binary")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), spark)
    known = rows.where("h1 is not null and doc_id is not null")
    # The signature comes back by a join with one row of the class: sums without binary values form before the shuffle.
    found = known.groupBy("h1", "h2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return rows.drop("sig"), found.join(known.select("row", "sig"), F.col("cls") == F.col("row")).drop("row")


def candidate_edges(reps: DataFrame, spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: forests of the pairs that banding proposes and pruning leaves."""
    size = band_size(threshold)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "sig"):
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            keys = band_keys(sig, size)
            cls = np.repeat(batch.column("cls").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cls)], names=["key", "cls"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner, a, b = Pruner(threshold), [], []
        for group in grouped(batches, 3):
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            mine, cls = group.column("mine").to_numpy(), group.column("cls").to_numpy()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            i, j = pruner.survivors(sig, sig, *block_pairs(mine, x, y))
            node, root = forest(len(cls), i, j)
            a.append(cls[node])
            b.append(cls[root])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    keys = table(reps.select("cls", "sig").mapInArrow(released(bands), "key bigint, cls bigint"), spark)
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2"))
    groups = groups.where("n > 1").groupBy("n", "m", "h1", "h2").agg(F.min("key").alias("k"))
    members = keys.join(groups.select("k", "n"), F.col("key") == F.col("k")).select("key", "cls", "n")
    members = members.join(reps.select(F.col("cls").alias("c"), "sig"), F.col("cls") == F.col("c"))
    members = dealt(members, "key", "n", "cls").select("key", "x", "y", "mine", "cls", "sig")
    return members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(released(prune), "a bigint, b bigint").distinct()


def verified(reps: DataFrame, docs: DataFrame, edges: DataFrame, spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """cls, links, to: partial sums of linked documents, and (where `to` isn't null) edges of forests of the links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner = Pruner(threshold)
        for group in grouped(batches, 3):
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)  # repeated rows of one document
            group = group.take(pa.array(first))
            mine, copies = group.column("mine").to_numpy(), group.column("copies").to_numpy()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            i, j = pruner.survivors(sig, sig, *block_pairs(mine, x, y))
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            both = intersections(sets, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            links = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
            node, root = forest(len(cls), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cls[some], cls[node]])), pa.array(np.concatenate([links[some], np.zeros(len(node))]).astype(np.int64)), pa.array([None] * len(some) + cls[root].tolist(), pa.int64())],
                names=["cls", "links", "to"],
            )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in chunked(batches):
            sets = shingle_sets([words(t) for t in batch.column("text").to_pylist()], hashes)
            names = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist())
            same = pa.array([named(s) == n for s, n in zip(sets, names)], pa.bool_())  # another text may have the same doc_id
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "n", "cls", "copies", "sig")), packed(sets)], names=["component", "n", "cls", "copies", "sig", "shingles"])
            yield out.filter(same)

    found = table(components(edges, spark), spark)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "o")
    found = found.join(sizes, F.col("component") == F.col("o")).select("node", "component", "n")
    found = found.join(reps, F.col("node") == F.col("cls")).select("component", "n", "cls", "h1", "h2", F.col("doc_id").alias("d"), "copies", "sig")
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    rows = texts.join(found, F.col("doc_id") == F.col("d")).drop("d", "doc_id")
    rows = rows.mapInArrow(released(fetch), "component bigint, n bigint, cls bigint, copies bigint, sig binary, shingles binary")
    rows = dealt(rows, "component", "n", "cls").select("component", "x", "y", "mine", "cls", "copies", "sig", "shingles")
    return rows.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(released(verify), "cls bigint, links bigint, to bigint")


def linked(docs: DataFrame, spark: SparkSession, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with a number, and what to keep of them; row, part, doc_id, class_id, n_links, copy_of for each): see jaccard_join().

    part numbers the group, as groups of one least doc_id may be several where rows share ids; null without words or id.
    """
    rows, reps = classes(docs, spark, keep)
    reps = table(reps, spark)
    edges = table(candidate_edges(reps, spark, threshold), spark)
    found = table(verified(reps, docs, edges, spark, threshold), spark)
    links = found.groupBy("cls").agg(F.sum("links").alias("near")).withColumnRenamed("cls", "l")
    groups = table(components(found.where("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b")), spark), spark)
    of = groups.join(reps.select("cls", "doc_id"), F.col("node") == F.col("cls"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("group")).withColumnRenamed("component", "g")
    of = of.join(least, F.col("component") == F.col("g")).select("node", "group", "component")
    every = reps.select("cls", "h1", "h2", "doc_id", "copies").join(links, F.col("cls") == F.col("l"), "left").join(of, F.col("cls") == F.col("node"), "left")
    every = every.select(F.col("h1").alias("u"), F.col("h2").alias("v"), F.col("doc_id").alias("copy_of"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("group", "doc_id").alias("group"), F.coalesce("component", "cls").alias("part"))
    narrow = rows.select("row", "doc_id", "h1", "h2")
    out = narrow.join(every, (F.col("h1") == F.col("u")) & (F.col("h2") == F.col("v")) & F.col("doc_id").isNotNull(), "left")
    return rows, out.select("row", "part", "doc_id", F.coalesce("group", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def jaccard_join(docs: DataFrame, spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, copy_of for each row of docs (doc_id, text).

    n_links is the number of other rows whose similarity (Jaccard, of sets of five words) is the
    threshold or more, exact copies among them; class_id is the least doc_id of those that links
    connect; copy_of the least doc_id with the same shingles. Texts of one to four words have one shingle,
    all of them. A null or empty text has no links and is a class and a group of its own. A row with a
    null doc_id has no links and null ids. Repeated rows count as copies. An empty table gives an empty
    table; other columns are not read.
    """
    return linked(docs, spark, threshold)[1].select("doc_id", "class_id", "n_links", "copy_of")


def one_of_each(docs: DataFrame, spark: SparkSession, keep: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (its columns in keep), one of each group: that with the least doc_id.

    Of several rows with that doc_id in the group one stays, whichever they are; rows that share a doc_id and are
    no copies are of different groups and all stay. Rows without words or without doc_id stay. An empty table
    gives an empty table.
    """
    rows, found = linked(docs, spark, threshold, keep)
    found = table(found.where("part is not null").select("row", "part", "doc_id", "class_id"), spark)
    least = found.where("doc_id = class_id")
    stay = least.groupBy("part").agg(F.min("row").alias("r"))
    gone = found.where("doc_id <> class_id").select("row").union(least.join(stay, F.col("row") == F.col("r"), "left_anti").select("row"))
    return rows.join(table(gone.select(F.col("row").alias("r")), spark), F.col("row") == F.col("r"), "left_anti").select(*keep)
