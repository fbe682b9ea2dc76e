"""Substring dedup by suffix automata of reference shards.

A window (13 words in a row) is a duplicate if a document with a smaller id has it too. As the corpus
is its own reference, no automaton over all of it could be broadcast within a size bound; instead each
shard's automaton is built where the text that can match it arrives:

1. A window's anchor is the least hash of its 11 runs of three words. Equal windows have equal anchors,
   so only anchors that several documents have can hold duplicates. Each chunk of texts gives its anchors,
   with the least and greatest document of each, to the buckets of their leading bits, and gets back
   those that several documents have.
2. Documents cut out the segments (runs of windows with one anchor) whose anchors are shared; equal
   segments become one, with the least document.
3. The segments of an anchor are a reference shard. A suffix automaton over them in order of documents
   has in every state the first document of its substrings; every segment streams through it, and the
   matching statistics, cut at the window's length, give each window's first document.
4. A shard of more than SHARD_WORDS words is split first: equal windows have the second and third least
   hash of their runs as well, then the next three, then all. With all eleven a shard holds one window, so
   every shard comes below the bound, and all go through automata. A part that is there once and alone in
   its shard has no equal.
5. Each document gets back the windows whose first document is smaller, and drops the words they cover.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, chunked, drop, grams, released, signed, table
from .near import grouped

WINDOW, ANCHOR = 13, 3
#: Words in one automaton at most; it takes 300 to 600 bytes of Python's memory a word.
SHARD_WORDS = 16_384
#: The leading bits of an anchor that tell its bucket; the anchors of a bucket are looked at together.
BUCKET_BITS = 10
#: The ranks of hashes by which shards are split, level by level.
RANKS = ((1, 3), (3, 6), (6, None))
#: Windows in one segment at most; longer runs of one anchor (periodic texts) are cut.
PIECE = 512


class SuffixAutomaton:
    """Over several sequences of words, added in order of their documents; state 0 is the empty string."""

    def __init__(self) -> None:
        self.to: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, sequence: list[bytes], doc: int) -> None:
        to, link, length, first = self.to, self.link, self.length, self.first
        last = 0
        for w in sequence:
            have = to[last].get(w)
            if have is not None and length[have] == length[last] + 1:
                last = have
                continue
            if have is None:
                now = len(to)
                to.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(doc)
                p = last
                while p >= 0 and w not in to[p]:
                    to[p][w] = now
                    p = link[p]
                if p < 0:
                    last = now
                    continue
                have = to[p][w]
                if length[have] == length[p] + 1:
                    link[now], last = have, now
                    continue
            else:
                now, p = -1, last
            clone = len(to)
            to.append(to[have].copy())
            link.append(link[have])
            length.append(length[p] + 1)
            first.append(first[have])
            while p >= 0 and to[p].get(w) == have:
                to[p][w] = clone
                p = link[p]
            link[have] = clone
            if now < 0:
                last = clone
            else:
                link[now], last = clone, now

    def matching(self, sequence: list[bytes], most: int) -> list[tuple[int, int]]:
        """(length, first document) of the longest match, `most` words at most, that ends at each word."""
        to, link, length = self.to, self.link, self.length
        out, state, n = [], 0, 0
        for w in sequence:
            while state and w not in to[state]:
                state = link[state]
                n = length[state]
            state = to[state].get(w, 0)
            n = n + 1 if state else 0
            if n > most:
                n = most
            while state and length[link[state]] >= n:
                state = link[state]
            out.append((n, self.first[state]))
        return out


def anchors(flat: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents whose word hashes lie one after another: (anchor, document, first window, windows)."""
    g = grams(flat, ANCHOR)
    width = window - ANCHOR + 1
    if len(g) < width:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    least, have = g, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + window <= starts[doc + 1]
    at = np.flatnonzero(inside)
    least, doc = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    return least[cut], doc[cut], at[cut] - starts[doc[cut]], np.diff(np.append(cut, len(at)))


def texts_and_anchors(docs: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds for each chunk of docs: its texts (ids, sizes in bytes, z: the texts compressed), and for each bucket of hashes the distinct anchors (h) with their least and greatest document in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, c = WordHash(), zstandard.ZstdCompressor(level=3)
        for batch in chunked(batches):
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            sizes = pa.array([list(map(len, texts))], pa.list_(pa.int64()))
            ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            yield made([chunk], [None], ids, sizes, [c.compress(b"".join(texts))], [None], [None], [None])
            known = np.flatnonzero(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)).tolist()
            h, doc, _, _ = anchors(*hashes.flat([texts[i].split() for i in known]), window)
            if not len(h):
                continue
            ids = batch.column("doc_id").drop_null().to_numpy().astype(np.int64)[doc]
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, low, high = h[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)  # ascending, as h is
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(h)).tolist()
            parts = [[x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for x in (h, low, high)]
            n = len(cuts) - 1
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield made([chunk] * n, bucket[cuts[:-1]], none, none, [None] * n, *parts)

    def made(chunk: list, bucket: list, ids: pa.Array, sizes: pa.Array, *binary: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), ids, sizes, *(pa.array(x, pa.binary()) for x in binary)], names=["chunk", "bucket", "ids", "sizes", "z", "h", "low", "high"])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(released(find), "chunk bigint, bucket int, ids array<bigint>, sizes array<bigint>, z binary, h binary, low binary, high binary")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """chunk, anchors: for (bucket, chunk, h, low, high) those anchors of a chunk that several documents of the corpus have."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 1):
            parts = group.column("h").to_pylist()
            h, low, high = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("low", np.int64), ("high", np.int64)))
            order = np.argsort(h)
            new = np.concatenate([[True], np.diff(h[order]) != 0])
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
            mark = np.zeros(len(h), bool)
            mark[order] = several[np.cumsum(new) - 1]
            cuts = np.cumsum([0, *(len(x) // 8 for x in parts)])
            found = [h[i:j][mark[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            out = pa.RecordBatch.from_arrays([group.column("chunk").combine_chunks(), pa.array(found, pa.binary())], names=["chunk", "anchors"])
            yield out.filter(pc.greater(pc.binary_length(out.column("anchors")), 0))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(share), "chunk bigint, anchors binary")


def _unzip(sizes: list[int], z: bytes) -> list[list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(z) if sum(sizes) else b""
    ends = list(accumulate(sizes, initial=0))
    return [raw[a:b].split() for a, b in zip(ends, ends[1:])]


def pieces(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments (anchor, document, first window, windows) cut into pieces of at most PIECE windows."""
    k = -(-n // PIECE)
    i = np.repeat(np.arange(len(n)), k)
    skip = PIECE * (np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k))
    return h[i], doc[i], start[i] + skip, np.minimum(n[i] - skip, PIECE)


def named(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def segments(wanted: DataFrame, window: int) -> DataFrame:
    """h, s, chunk, row, doc_id, start, words of the segments of (chunk, ids, sizes, z, anchors) whose anchors are among those; row counts a chunk's documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in chunked(batches, "z", 1):
            chunk, ids = batch.column("chunk")[0].as_py(), np.array([-1 if i is None else i for i in batch.column("ids")[0].as_py()], np.int64)
            rows = [i for i, d in enumerate(batch.column("ids")[0].as_py()) if d is not None]
            docs = _unzip(batch.column("sizes")[0].as_py(), batch.column("z")[0].as_py())
            docs = [docs[i] for i in rows]
            flat, starts = hashes.flat(docs)
            h, doc, start, n = anchors(flat, starts, window)
            at = np.flatnonzero(np.isin(h, np.frombuffer(b"".join(batch.column("anchors")[0].as_py()), np.uint64)))
            h, doc, start, n = pieces(h[at], doc[at], start[at], n[at])
            text = b" ".join(chain.from_iterable(docs))
            ends = np.cumsum(np.fromiter(map(len, chain.from_iterable(docs)), np.int64, len(flat)) + 1)  # of words, with the space
            first = starts[doc] + start
            low, high = np.where(first > 0, ends[first - 1], 0), ends[first + n + window - 2] - 1
            row = np.array(rows, np.int32)[doc]
            for i in range(0, len(h), 50_000):
                part = slice(i, i + 50_000)
                found = [text[x:y] for x, y in zip(low[part].tolist(), high[part].tolist())]
                s = list(map(named, found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[part])), pa.array(s, pa.int64()), pa.array([chunk] * len(s), pa.int64()), pa.array(row[part]), pa.array(ids[row[part]]), pa.array(start[part], pa.int32()), pa.array(found, pa.binary())],
                    names=["h", "s", "chunk", "row", "doc_id", "start", "words"],
                )

    return wanted.mapInArrow(released(cut), "h bigint, s bigint, chunk bigint, row int, doc_id bigint, start int, words binary")


def first_documents(shards: DataFrame, window: int) -> DataFrame:
    """h, s, firsts (the first document of each window) for segments (h, s, doc, words, times), by automata; none for a segment that is there once and alone in its shard."""

    def shard(rows: list[tuple[int, int, int, bytes, int]]) -> Iterator[tuple[int, int, list[int]]]:
        if len(rows) == 1:  # what is in one segment only starts in its document
            h, s, doc, text, times = rows[0]
            if times > 1:
                yield h, s, [doc] * (text.count(b" ") + 2 - window)
            return
        split = [t.split(b" ") for *_, t, _ in rows]
        automaton = SuffixAutomaton()
        for (_, _, doc, *_), t in zip(rows, split):
            automaton.add(t, doc)
        for (h, s, *_), t in zip(rows, split):
            yield h, s, [first for n, first in automaton.matching(t, window) if n == window]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, int]] = []
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "doc", "words", "times"))):
                if held and row[0] != held[0][0]:
                    out += shard(held)
                    held = []
                held.append(row)
            if out:
                yield found(out)
        if held and (out := list(shard(held))):
            yield found(out)

    def found(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["h", "s", "firsts"])

    ordered = shards.select("h", "s", "doc", "words", "times").repartition("h").sortWithinPartitions("h", "doc", "s")
    return ordered.mapInArrow(released(match), "h bigint, s bigint, firsts array<bigint>")


def split(shards: DataFrame, window: int, level: int) -> DataFrame:
    """h, s, doc, words of the parts of segments whose windows share the hashes of the level's ranks too; h0 and s0 of the segment, and the window `at` which the part starts."""
    width, ranks = window - ANCHOR + 1, slice(*RANKS[level])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in chunked(batches, "words", 1 << 20):
            rows: list[tuple] = []
            for h, s, doc, text in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "doc", "words"))):
                t = text.split(b" ")
                g = grams(hashes.flat([t])[0], ANCHOR)
                key = np.sort(np.lib.stride_tricks.sliding_window_view(g, width), 1)[:, ranks]
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
                for a, b in zip(cuts, cuts[1:]):
                    part = b" ".join(t[a : b + window - 1])
                    below = named(h.to_bytes(8, "little", signed=True) + key[a].tobytes())
                    rows.append((below, named(part), doc, part, h, s, a))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h", "s", "doc", "words", "h0", "s0", "at"])

    return shards.select("h", "s", "doc", "words").mapInArrow(released(cut), "h bigint, s bigint, doc bigint, words binary, h0 bigint, s0 bigint, at int")


def filled(large: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """h, s, firsts of the segments (h, s, doc, words): what `found` (h0, s0, at, firsts) has of their parts; windows of other parts are in no other segment, so they start in its document."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "words", "f"))):
                firsts = [doc] * (text.count(b" ") + 2 - window)
                for p in parts or ():
                    firsts[p["at"] : p["at"] + len(p["firsts"])] = p["firsts"]
                out.append(firsts)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("s"), pa.array(out, pa.list_(pa.int64()))], names=["h", "s", "firsts"])

    found = found.groupBy("h0", "s0").agg(F.collect_list(F.struct("at", "firsts")).alias("f"))
    rows = large.join(found, (F.col("h") == F.col("h0")) & (F.col("s") == F.col("s0")), "left").select("h", "s", "doc", "words", "f")
    return rows.mapInArrow(released(fill), "h bigint, s bigint, firsts array<bigint>")


def resolved(cut: DataFrame, spark: SparkSession, window: int, level: int = 0) -> DataFrame:
    """h, s, firsts (the first document of each window) of the segments in (h, s, doc, words); a table. Segments that are there once and alone in their shards are left out."""
    size = F.size(F.split(F.col("words").cast("string"), " "))
    shards = table(cut.groupBy("h", "s").agg(F.min("doc").alias("doc"), F.first("words").alias("words"), F.count("*").alias("times")), spark)
    large = shards.groupBy("h").agg(F.sum(size).alias("n"), F.count("*").alias("m")).where((F.col("n") > SHARD_WORDS) & (F.col("m") > 1)).select(F.col("h").alias("k"))
    large = table(large, spark)
    if level == len(RANKS) or large.isEmpty():
        out = table(first_documents(shards, window), spark)
    else:
        usual = table(first_documents(shards.join(large, F.col("h") == F.col("k"), "left_anti"), window), spark)
        among = shards.join(large, F.col("h") == F.col("k"), "left_semi")
        parts = table(split(among, window, level), spark)
        below = resolved(parts.select("h", "s", "doc", "words"), spark, window, level + 1).select(F.col("h").alias("k"), F.col("s").alias("t"), "firsts")
        found = parts.select("h", "s", "h0", "s0", "at").join(below, (F.col("h") == F.col("k")) & (F.col("s") == F.col("t"))).select("h0", "s0", "at", "firsts")
        out = table(usual.unionByName(filled(among, found, window)), spark)
        drop(parts, spark)
        drop(usual, spark)
    drop(shards, spark)
    return out


def drop_repeats(docs: DataFrame, spark: SparkSession, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for each row of docs (doc_id, text).

    Words of a window that starts in a document with a smaller doc_id too are removed; kept joins the
    others by one space. A null or empty text has no words. Texts shorter than a window lose nothing. A
    row with a null doc_id has no place in the order: it loses nothing and removes nothing. Repeated rows
    have one doc_id and do not remove each other's words. An empty table gives an empty table; other
    columns are not read. with_text=False leaves `kept` null.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "z", 1):
            rows = []
            docs, ids = _unzip(batch.column("sizes")[0].as_py(), batch.column("z")[0].as_py()), batch.column("ids")[0].as_py()
            places_of: dict[int, list] = {}
            for x in batch.column("at")[0].as_py() or ():
                places_of.setdefault(x["row"], []).append(x["places"])
            for i, ws in enumerate(docs):
                removed = 0
                if at := places_of.get(i):
                    gone = np.zeros(len(ws) + 1, np.int32)
                    places = np.unique(np.concatenate([np.asarray(a, np.int64) for a in at]))
                    gone[places] += 1
                    np.add.at(gone, np.minimum(places + window, len(ws)), -1)
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                    removed, kept = len(ws) - len(left), b" ".join([ws[j] for j in left])
                else:
                    kept = b" ".join(ws)
                rows.append((ids[i], len(ws), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    both = table(texts_and_anchors(docs, window), spark)
    texts = table(both.where("bucket is null").select("chunk", "ids", "sizes", "z"), spark)
    lists = shared_anchors(both.where("bucket is not null").select("bucket", "chunk", "h", "low", "high"))
    lists = table(lists.groupBy(F.col("chunk").alias("c")).agg(F.collect_list("anchors").alias("anchors")), spark)
    drop(both, spark)
    wanted = texts.join(lists, F.col("chunk") == F.col("c")).select("chunk", "ids", "sizes", "z", "anchors")
    cut = table(segments(wanted, window), spark)
    drop(lists, spark)

    firsts = resolved(cut.select("h", "s", F.col("doc_id").alias("doc"), "words"), spark, window).select(F.col("h").alias("k"), F.col("s").alias("t"), "firsts")
    places = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = cut.select("h", "s", "chunk", "row", "doc_id", "start").join(firsts, (F.col("h") == F.col("k")) & (F.col("s") == F.col("t"))).select(F.col("chunk").alias("c"), "row", places.alias("places"))
    hits = hits.where(F.size("places") > 0).groupBy("c").agg(F.collect_list(F.struct("row", "places")).alias("at"))
    hits = table(hits, spark)
    drop(cut, spark)
    joined = texts.join(hits, F.col("chunk") == F.col("c"), "left").select("ids", "sizes", "z", "at")
    return joined.mapInArrow(released(keep), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
