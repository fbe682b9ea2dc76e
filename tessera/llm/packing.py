"""Harmonic packing of token sequences.

Lengths are cut to reciprocal fractions of the capacity C: a piece of the class k has floor(C / k)
tokens, and a bin of the class k takes exactly k such pieces, whatever the other classes or workers
do. A document gives its full sequences first, then the largest fraction that fits its rest, and so
on; as the rest after a piece of class k is less than C / k^2, three or four pieces hold most
documents. A full bin of the class k wastes C - k * floor(C / k) tokens, less than k and less than
the piece's length. What is left in unfilled bins at the end of a worker's partition is chained and
cut at C, and the last rest into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunked, released

CAPACITY = 4096
#: Parts of texts after which a worker's cache of ids starts anew.
CACHE_PARTS = 1_500_000
#: Printable characters below U+0130, but < and >, which may start the name of a special token.
SIMPLE = re.compile(r"[\n!-;=?-~\u00a1-\u012f]*")
#: A stop at the end of a part, after a letter or a digit that isn't decimal.
STOP = re.compile(r"(?<=[^\W\d_])[.,;:!?]$", re.MULTILINE)
#: Sequence numbers of one partition start here times its number.
PER_PARTITION = 1 << 40


def fractions(capacity: int, most_waste: int) -> list[tuple[int, int]]:
    """(length, pieces in a bin) of each class whose full bin wastes most_waste tokens at most, longest first."""
    sizes = {capacity // k: k for k in range(capacity, 0, -1)}
    return sorted(((s, capacity // s) for s in sizes if capacity - s * (capacity // s) <= most_waste), reverse=True)


def cuts(n: int, capacity: int, classes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, pieces in a bin) of the pieces of a document of n tokens."""
    out, at = [], 0
    for size, k in classes:
        while n - at >= size:
            out.append((at, size, k))
            at += size
    return out


def powers(n: int) -> list[int]:
    """n as a sum of different powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Fills bins; pieces are numbers of rows of a list that the caller keeps."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.open = capacity, first, defaultdict(list)

    def put(self, piece: tuple, size: int, k: int) -> list[tuple]:
        """Add a piece (doc, start, length, ...) to its class; when that fills a bin, the bin's placed pieces."""
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        out = [(*p, self.next, i * size) for i, p in enumerate(held)]
        self.next += 1
        return out

    def rest(self) -> Iterator[tuple]:
        """Chain what is left: full sequences, then sequences of powers of two. Pieces are cut where a sequence ends; yields (piece, from, length, sequence, offset)."""
        left = [(p, p[2]) for k in sorted(self.open) for p in self.open[k]]
        total = sum(n for _, n in left)
        room = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        at, i = 0, 0
        for piece, n in left:
            start = 0
            while start < n:
                take = min(n - start, room[i] - at)
                yield piece, start, take, self.next, at
                start, at = start + take, at + take
                if at == room[i]:
                    self.next, i, at = self.next + 1, i + 1, 0


class Encoder:
    """Little-endian 32-bit ids of the parts of a text between spaces, tabs and line ends, which no token crosses.

    Ids of parts are kept. New parts of simple letters (below U+0130, where lower-casing a letter gives
    one letter and nothing composes) are lower-cased, a final stop or comma after a letter is looked up by itself, as
    the tokenizer splits there, and the rest go to the tokenizer many at a time, told apart by offsets.
    """

    JOINED = 2000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.seen = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True

    def _alone(self, part: str) -> bytes:
        return np.asarray(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, parts: list[str]) -> None:
        letters = [p for p in parts if p.isalpha()]
        for some, single in ((letters, self.last.any()), ([p for p in parts if not p.isalpha()], False)):
            for i in range(0, len(some), self.JOINED):
                group = some[i : i + self.JOINED]
                found = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
                ids = np.asarray(found.ids, "<u4")
                if single:  # a run of letters is one word, whose last token is marked
                    ends = (np.flatnonzero(self.last[ids]) + 1) * 4
                else:
                    start = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
                    ends = np.searchsorted(start, np.cumsum([len(p) + 1 for p in group])) * 4
                raw, ends = ids.tobytes(), ends.tolist()
                self.seen.update(zip(group, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))

    def _learn(self, new: list[str]) -> None:
        seen = self.seen
        whole = "\n".join(new)
        if not SIMPLE.fullmatch(whole):
            seen.update((p, self._alone(p)) for p in new if not SIMPLE.fullmatch(p))
            new = [p for p in new if SIMPLE.fullmatch(p)]
            whole = "\n".join(new)
        stems = STOP.sub("", whole.lower()).split("\n")
        self._together(list(set(stems).difference(seen)))
        stop = {c: self._alone(c) for c in ".,;:!?"}
        seen.update((p, seen[s] if len(p) == len(s) else seen[s] + stop[p[-1]]) for p, s in zip(new, stems))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > CACHE_PARTS:
            self.seen.clear()
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if new := set().union(*parts).difference(self.seen):
            self._learn(list(new))
        return [b"".join(map(self.seen.__getitem__, p)) for p in parts]


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, most_waste: int = 8, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text), with its place in a sequence.

    tokenizer is the path of a tokenizers file on the workers. A null text counts as empty; an empty
    text has the end token alone. Repeated rows and null ids are packed like others, each row as a
    document of its own. An empty table gives an empty table. Other columns are not read. There is no
    shuffle: every partition fills its own bins, and sequence ids start at 2^40 times the partition's
    number. A text is tokenized whole, one at a time; unfilled bins hold at most one sequence a class.
    ids (little-endian unsigned 32-bit) is null if with_ids is False.
    """
    classes = fractions(capacity, most_waste)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept_encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() * PER_PARTITION)

        def placed(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, length, ids, total, seq, offset = zip(*rows)
            crc = [zlib.crc32(b) for b in ids]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc, start, length, crc, total, seq, offset, ids if with_ids else [None] * len(ids)), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in chunked(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                for at, size, k in cuts(n, capacity, classes):
                    rows += packer.put((doc, at, size, ids[4 * at : 4 * (at + size)], n), size, k)
            if rows:
                yield placed(rows)
        rows = [(doc, start + a, n, ids[4 * a : 4 * (a + n)], total, seq, offset) for (doc, start, _, ids, total), a, n, seq, offset in packer.rest()]
        if rows:
            yield placed(rows)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(released(run), SCHEMA)
