"""Language spans of mixed-language text.

Words are runs of letters of one script, long runs cut into pieces, so that all letters are read. Each
word's script narrows the candidate languages to those whose training texts use it. A word's score in
a language is the log-likelihood of its character bigrams and trigrams under hashed counts; Viterbi
over the words, with a penalty for every switch, labels spans. A document's language is the one with
the most letters, its score their share.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, chunked, released

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: Log-likelihood that a switch of language costs.
SWITCH = 12.0
#: Labelled documents of each language that the model is fitted on, chosen by a hash of their ids.
SAMPLE = 2000
CHUNK = 8 << 20
CACHE = 300_000
#: Letters of a word; longer runs, as of unspaced scripts, are words of so many letters one after another.
LONGEST = 60
WORD = re.compile(r"[^\W\d_]+")

# Where a script's letters start (Unicode blocks); letters before the first are Latin.
SCRIPTS = (
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x3040, "Japanese"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Japanese"), (0x3200, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Japanese"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x1B000, "Japanese"), (0x1B300, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = [a for a, _ in SCRIPTS]


def script(letter: str) -> str:
    i = bisect_right(_STARTS, ord(letter))
    return SCRIPTS[i - 1][1] if i else "Latin"


def split_words(text: str) -> list[str]:
    """Lower-case runs of letters of one script, long ones in consecutive pieces of at most LONGEST."""
    out: list[str] = []
    for w in WORD.findall(text.lower()):
        if len(w) > LONGEST:
            out += _pieces(w)
        elif w.isascii():
            out.append(w)
        else:
            out += _short_pieces(w)
    return out


def _pieces(run: str) -> list[str]:
    parts = ("".join(p) for _, p in groupby(run, script)) if not run.isascii() else (run,)
    cut = (p[i : i + LONGEST] for p in parts for i in range(0, len(p), LONGEST))
    return [p for p in cut if p.isalpha() or any(map(str.isalpha, p))]


_short_pieces = lru_cache(100_000)(_pieces)


def features(word: str) -> list[int]:
    """Buckets of the word's bigrams and trigrams, with its ends marked."""
    w = f"^{word}$"
    raw = w.encode("utf-8", "surrogatepass")
    if len(raw) == len(w):  # each byte a letter
        return [zlib.crc32(raw[i : i + n]) % BUCKETS for n in (2, 3) for i in range(len(raw) - n + 1)]
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in (2, 3) for i in range(len(w) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # bucket x language
    scripts: dict[str, list[bool]]  # script -> whether each language uses it


def sample(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most so many rows of each language, those with the smallest hashes of doc_id.

    A threshold on the hash, from the languages' counts, lets through a little more than that; only
    those rows are ranked.
    """
    rows = labelled.where("text is not null and lang is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pylist()}  # a row for each language, as the model has
    if not counts:
        return rows.select("lang", "text")
    part = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (1.2 * most + 50) / n) * (1 << 40)))))
    near = rows.where(F.col("h") < F.element_at(part, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def fit(labelled: DataFrame, most: int = SAMPLE) -> Model:
    """Count features and scripts of a bounded sample; the driver gets BUCKETS counts a language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        letters: Counter = Counter()
        for batch in chunked(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for word, n in Counter(split_words(text)).items():
                    np.add.at(into, features(word), n)
                    letters[lang, script(word[0])] += n * len(word)
        out = [(lang, str(b), int(a[b])) for lang, a in sums.items() for b in np.flatnonzero(a)]
        out += [(lang, name, n) for (lang, name), n in letters.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["lang", "key", "n"])

    counted = sample(labelled, most).mapInArrow(released(count), "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in counted})
    counts, letters = np.zeros((BUCKETS, len(langs))), defaultdict(Counter)
    for r in counted:
        if r["key"].isdigit():
            counts[int(r["key"]), langs.index(r["lang"])] = r["n"]
        else:
            letters[r["lang"]][r["key"]] = r["n"]
    smooth = counts + 0.5
    names = {s for c in letters.values() for s in c}
    return Model(langs, np.log(smooth / smooth.sum(0)).astype(np.float32), {s: [letters[x][s] >= 0.01 * letters[x].total() for x in langs] for s in names})


class Scorer:
    """Rows of scores for words, kept for words seen before."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.start()

    def start(self) -> None:
        """Forget the words if there are too many; row numbers given before are void then."""
        if not hasattr(self, "rows") or len(self.rows) > CACHE:
            self.rows: dict[str, int] = {}
            self.scores = np.zeros((4096, len(self.model.langs)), np.float32)
            self.letters = np.zeros(4096, np.int32)

    def look_up(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        except KeyError:
            self._learn([w for w in dict.fromkeys(words) if w not in self.rows])
            return np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))

    def _learn(self, new: list[str]) -> None:
        feats = list(map(features, new))
        sizes = np.fromiter(map(len, feats), np.int64, len(feats))
        at = np.zeros(len(feats), np.int64)
        np.cumsum(sizes[:-1], out=at[1:])
        score = np.add.reduceat(self.model.logp[np.fromiter(chain.from_iterable(feats), np.int64, int(sizes.sum()))], at, axis=0)
        score -= score.max(1, keepdims=True)
        for i, w in enumerate(new):
            uses = self.model.scripts.get(script(w[0]))
            if not uses or not any(uses):
                score[i] = 0  # a script of no learned language tells nothing
            elif not all(uses):
                score[i] -= np.where(uses, np.float32(0), np.float32(1e3))
        first, end = len(self.rows), len(self.rows) + len(new)
        while end > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.scores[first:end] = score
        self.letters[first:end] = list(map(len, new))
        self.rows.update(zip(new, range(first, end)))


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of all words; sequences i are scores[starts[i]:starts[i + 1]], taken in lockstep, longest first."""
    n, k = scores.shape
    out = np.zeros(n, np.int32)
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    # active[t]: how many sequences have a word t
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    best, came, v = np.zeros(n, np.int32), np.zeros((n, k), bool), np.zeros((len(size), k), np.float32)
    if steps:
        v[: active[0]] = scores[first[: active[0]]]
    for t in range(1, steps):
        a = active[t]
        at, w = first[:a] + t, v[:a]
        top = w.argmax(1)
        switched = w[np.arange(a), top][:, None] - np.float32(penalty)
        move = switched > w
        best[at], came[at] = top, move
        np.maximum(w, switched, out=w)
        w += scores[at]
    label = v.argmax(1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at, now = first[:a] + t, label[:a]
        out[at] = now
        if t:
            label[:a] = np.where(came[at, now], best[at], now)
    return out


SCHEMA = "doc_id bigint, lang_pred string, score double, spans string"


def label(docs: DataFrame, spark: SparkSession, model: Model, penalty: float = SWITCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, spans for each row of docs (doc_id, text); spans are lang:words, comma-joined.

    Null texts, and texts without letters, are `und` with score 0, and so is all text if no language
    was learned. If no word is in a script that a language uses, the first language by name is
    reported with score 0. Ties go to the first language by name. Repeated rows give repeated rows; a
    null doc_id stays null; other columns are not read, but those that keep names are carried along.
    Texts are labelled whole.
    """
    rest, schema = carried(docs, tuple(c for c in keep if c != "doc_id"))
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in chunked(batches, most=CHUNK):
            if model.langs:
                scorer.start()
                docs = [scorer.look_up(split_words(t.as_py() or "")) for t in batch.column("text")]
            else:
                docs = [np.zeros(0, np.int32)] * batch.num_rows
            starts = np.zeros(len(docs) + 1, np.int64)
            np.cumsum(list(map(len, docs)), out=starts[1:])
            pred, share, spans = [UNDETERMINED] * len(docs), [0.0] * len(docs), [""] * len(docs)
            if starts[-1]:
                rows = np.concatenate(docs)
                scores, letters = scorer.scores[rows], scorer.letters[rows]
                labels = viterbi(scores, starts, penalty)
                known = scores.any(1)
                of = np.repeat(np.arange(len(docs)), np.diff(starts))
                k = len(model.langs)
                told = np.bincount(of * k + labels, np.where(known, letters, 0), len(docs) * k).reshape(len(docs), k)
                total = np.bincount(of, letters, len(docs))
                runs = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])]))
                ends = np.append(runs[1:], len(labels))
                parts: list[list[str]] = [[] for _ in docs]
                for a, b in zip(runs.tolist(), ends.tolist()):
                    parts[of[a]].append(f"{model.langs[labels[a]]}:{b - a}")
                for i in range(len(docs)):
                    if total[i]:
                        j = int(told[i].argmax())
                        pred[i], share[i], spans[i] = model.langs[j], float(told[i, j] / total[i]), ",".join(parts[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, pa.string())], names=[*rest, "doc_id", "lang_pred", "score", "spans"])

    kept = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *(c for c in rest if c != "text"))
    return kept.mapInArrow(released(run), schema + SCHEMA)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learned(docs: DataFrame, most: int = SAMPLE) -> Model:
    """The model from the documents that are not held out."""
    kept = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    return fit(kept.where(~held_out(F.col("doc_id"))), most)
