"""URL filters by association rules.

FP-growth, a token's conditional base at a time, mines combinations of URL tokens that go with a label.
URLs are tokenised whole; the support and MOST_NEEDS bound the rules. Rules below the support or
confidence asked for are dropped, and so are rules whose tokens include those of a rule of the same
label that is no less confident. URLs are matched by an inverted index from tokens to rules; the most
confident rule that has all its tokens in the URL decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: Pages that a rule needs at least, however few there are.
LEAST_PAGES = 5
#: A rule has at most so many tokens; a URL may have any number.
MOST_NEEDS = 10
CACHE = 200_000

# The rules that come before the method's verdicts.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LABELS = ("allow", "block")

#: What follows the first :// of a url.
REST = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.DOTALL)
WORD = re.compile(r"\d+|[^\W\d_]+")
FOUND = pa.schema([("needs", pa.list_(pa.int32())), ("label", pa.string()), ("n", pa.int64()), ("confidence", pa.float64())])


def tokens(url: str | None) -> list[str]:
    """Tokens of scheme, every host label, every path segment and every query key, and of their words, without repeats.

    A segment that starts with digits also counts by its first digit and their number.
    """
    before, found, after = (url or "").partition("://")
    if not found:
        return ["no-url"]
    scheme = before[max(map(before.rfind, ":/?#")) + 1 :]
    host, path, query = REST.match(after).groups()
    labels = host.lower().split(".")
    out = [f"top={labels[-1]}", f"host={host.lower()}"]
    out += [f"sub={labels[0]}"] if len(labels) > 2 else []
    for w in labels[:-1]:
        out += [f"part={w}", *([f"words={w}", *_words(w)] if "-" in w else [])]
    parts = [p for p in path.lower().split("/") if p]
    for i, p in enumerate(parts):
        n = re.match(r"\d+", p)
        out += [f"path{i}={n[0][0]}x{len(n[0])}"] if n else []
        out += [f"path{i}={p}", *_words(p)]
    out += ["ext=" + parts[-1].rpartition(".")[2]] if parts and "." in parts[-1] else []
    out += [f"key={k.partition('=')[0].lower()}" for k in (query or "").split("&") if k]
    out.append(f"scheme={scheme.lower()}")
    return list(dict.fromkeys(out))


def _words(text: str) -> list[str]:
    """Tokens of the words in a host label or path segment; digits before letters are a word of their own."""
    return [f"word={w}" for w in WORD.findall(text)]


@dataclass
class Rule:
    needs: frozenset[str]
    label: str
    confidence: float
    support: float


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_pages: int = 1) -> list[Rule]:
    """Rules of at most MOST_NEEDS tokens from labelled (url, label), best first. Rows with a null label are left out; without rows there are no rules."""
    rows = labelled.where("label is not null").select(F.col("url").cast("string").alias("url"), F.col("label").cast("string").alias("label"))
    total = rows.count()
    if not total:
        return []
    least = max(math.ceil(min_support * total), least_pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((t, v) for u, v in _pairs(batches) for t in tokens(u))
        yield from _counted(found, ("token", "label"), (pa.string(), pa.string()))

    counts = rows.mapInArrow(count, "token string, label string, n bigint").groupBy("token", "label").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow().to_pylist()
    sums: Counter = Counter()
    for r in counts:
        sums[r["token"]] += r["n"]
    names = sorted(sums, key=lambda t: (-sums[t], t))  # at most tokens a URL / min_support
    shared = labelled.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        baskets = ((sorted(rank[t] for t in tokens(u) if t in rank), v) for u, v in _pairs(batches))
        found = ((ids[i], tuple(ids[:i]), v) for ids, v in baskets for i in range(len(ids)))
        yield from _counted(found, ("tail", "prefix", "label"), (pa.int32(), pa.list_(pa.int32()), pa.string()))

    def grow(base: pa.Table) -> pa.Table:
        rows: dict[tuple[int, ...], Counter] = defaultdict(Counter)
        for prefix, label, n in zip(*(base.column(c).to_pylist() for c in ("prefix", "label", "n"))):
            rows[tuple(prefix)][label] += n
        return pa.Table.from_pylist([{"needs": sorted(r.needs), "label": r.label, "n": int(r.support), "confidence": r.confidence} for r in pruned(grown(base.column("tail")[0].as_py(), rows, least, min_confidence))], FOUND)

    found = rows.mapInArrow(bases, "tail int, prefix array<int>, label string, n bigint").groupBy("tail").applyInArrow(grow, "needs array<int>, label string, n bigint, confidence double")
    return pruned([Rule(frozenset(names[i] for i in r["needs"]), r["label"], r["confidence"], r["n"] / total) for r in found.toArrow().to_pylist()])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str]]:
    for batch in batches:
        yield from zip(batch.column("url").to_pylist(), batch.column("label").to_pylist())


def _counted(found: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of keys and their counts; a key comes again where there were over CACHE others."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*counts), kinds)), pa.array(counts.values(), pa.int64())], names=[*names, "n"])

    counts: Counter = Counter()
    for key in found:
        counts[key] += 1
        if len(counts) > CACHE:
            yield batch(counts)
            counts = Counter()
    if counts:
        yield batch(counts)


def grown(tail: int, rows: dict[tuple[int, ...], Counter], least: int, min_confidence: float) -> list[Rule]:
    """FP-growth of the rules whose last token by rank is tail, from its prefixes and their labels; `support` counts rows.

    Left out are only rules that pruned() drops: those with a token that all rows of the others have, and
    those that extend a rule without exceptions.
    """
    out: list[Rule] = []

    def extend(needs: tuple[int, ...], base: dict[tuple[int, ...], Counter], labels: Counter) -> None:
        n = labels.total()
        out.extend(Rule(frozenset(needs), v, k / n, k) for v, k in labels.items() if k >= least and k / n >= min_confidence)
        if len(needs) == MOST_NEEDS or len(labels) == 1:
            return
        by: dict[int, Counter] = defaultdict(Counter)
        for prefix, c in base.items():
            for i in prefix:
                by[i].update(c)
        good = {i for i, c in by.items() if max(c.values()) >= least and c.total() < n}
        below: dict[int, dict[tuple[int, ...], Counter]] = {i: defaultdict(Counter) for i in good}
        for prefix, c in base.items():
            kept = tuple(i for i in prefix if i in good)
            for at, i in enumerate(kept):
                below[i][kept[:at]].update(c)
        for i in sorted(good):
            extend((i, *needs), below.pop(i), by[i])

    extend((tail,), rows, sum(rows.values(), Counter()))
    return out


def pruned(rules: list[Rule]) -> list[Rule]:
    """The rules, most confident first, without those that a shorter and no less confident rule of the label covers."""
    order = sorted(rules, key=lambda r: (-r.confidence, len(r.needs), -r.support, sorted(r.needs), r.label))
    kept: list[Rule] = []
    index: dict[tuple[str, str], list[Rule]] = defaultdict(list)
    for r in order:
        # A covering rule has its own least token among this rule's tokens.
        if not any(k.needs <= r.needs for t in r.needs for k in index[r.label, t]):
            kept.append(r)
            index[r.label, min(r.needs)].append(r)
    return kept


class Matcher:
    """An inverted index from tokens to rules, and verdicts kept for token sets seen before."""

    def __init__(self, rules: list[Rule], default: str) -> None:
        self.rules, self.default, self.index, self.seen = rules, default, defaultdict(list), {}
        for i, r in enumerate(rules):
            for t in r.needs:
                self.index[t].append(i)

    def match(self, url: str | None) -> tuple[str, str | None, float]:
        """(label, the rule's tokens or None, its confidence)."""
        have = tuple(t for t in tokens(url) if t in self.index)
        out = self.seen.get(have)
        if out is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            hits: dict[int, int] = defaultdict(int)
            for t in have:
                for i in self.index.get(t, ()):
                    hits[i] += 1
            i = min((i for i, n in hits.items() if n == len(self.rules[i].needs)), default=None)
            r = self.rules[i] if i is not None else None
            out = self.seen[have] = (r.label, " ".join(sorted(r.needs)), r.confidence) if r else (self.default, None, 0.0)
        return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruling: the longest rule that fits, or null."""
    host, path = host_path(F.col("url"))
    out = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url").withColumns({"host": host, "path": path})
    rule = ruling = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, ruling = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumns({"rule": rule, "ruling": ruling})


def judge(pages: DataFrame, spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, matched, confidence for each row of pages (page_id, url).

    labelled (url, label: allow or block) is what rules are mined from; without it, the pages that the
    fixed rules decide are. The fixed rules decide first, then the best mined rule, then `allow`. A null
    url, or one without ://, has an empty host and path and a token of its own. Repeated rows give
    repeated rows, a null page_id stays null, an empty table gives an empty table, and other columns are
    not read.
    """
    given = ruled(pages, rules)
    if labelled is None:
        labelled = given.select("url", F.col("ruling").alias("label"))
    mined = spark.sparkContext.broadcast(mine(labelled, least_pages=LEAST_PAGES))  # bounded by MIN_SUPPORT and MOST_NEEDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(mined.value, LABELS[0])
        for batch in batches:
            got = [matcher.match(u) for u in batch.column("url").to_pylist()]
            label, by, confidence = zip(*got) if got else ((), (), ())
            verdict = [r or v for r, v in zip(batch.column("ruling").to_pylist(), label)]
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(verdict, pa.string()), pa.array(by, pa.string()), pa.array(confidence, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "matched", "confidence"])

    return given.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, matched string, confidence double")
