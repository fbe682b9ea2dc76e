"""The pipeline against its parts, stage by stage, on a small corpus of awkward rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tessera.llm import mixing, secrets

from .test_documents import brute_links

public_tokenizers = pytest.importorskip("public_tokenizers")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def sf_dir(make, documents, tmp_path_factory):
    rows = [*documents, (700, "a password = 'abcdefghijklmnop' among some words of the text that is there with them and more", "en", "s1")]
    rows += [(701, documents[0][1] + " tail", "en", "s1"), (701, "another text altogether with the same number as the one before it has", "en", "s1")]
    path = tmp_path_factory.mktemp("sf")
    make(rows).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["language", "near copies", "secrets", "mix", "pack"]
    seen = [docs.select(*p.COLUMNS)]
    for _, stage in p.STAGES:
        docs = p.table(stage(spark, docs, sf_dir), spark)
        seen.append(docs)
    assert all(d.columns == list(p.COLUMNS) for d in seen[:-1])
    start, lang, near, clean, mix, packs = (d.collect() for d in seen)

    # language: what has letters mostly of one language stays, every row of it
    has = lambda t: any(c.isalpha() for c in t or "")
    assert all(has(r.text) for r in lang)
    kept, all_ = Counter(r.doc_id for r in lang), Counter(r.doc_id for r in start if has(r.text))
    assert sum(kept.values()) >= 0.95 * sum(all_.values()) and all(kept[d] <= n for d, n in all_.items())

    # near copies: one of each group, that with the least id
    rows = [(r.doc_id, r.text) for r in lang]
    root = brute_links([((d, i), t, None, None) for i, (d, t) in enumerate(rows) if d is not None])
    assert Counter((r.doc_id, r.text) for r in near if r.doc_id is not None) == Counter(rows[i] for _, i in set(root.values()))
    assert any(r.doc_id == 701 and r.text.startswith("another") for r in near)  # its number is not its own
    assert sum(r.doc_id is None for r in near) == sum(r.doc_id is None for r in lang)

    # secrets: marks take their place, nothing else changes
    text = {r.doc_id: r.text for r in near if r.doc_id is not None}
    for r in clean:
        if r.doc_id is not None and r.doc_id != 701:
            spans = secrets.base_spans(text[r.doc_id]) + secrets.confirmed_spans(text[r.doc_id])
            assert r.text == secrets.redact(text[r.doc_id], spans, "[REDACTED]") and r.n_chars == len(r.text)
    assert "[REDACTED]" in next(r.text for r in clean if r.doc_id == 700) and len(clean) == len(near)

    # mix: as often as the operator says
    times = {r.doc_id: r.times for r in mixing.mix(seen[3], spark).collect()}
    got = Counter(r.doc_id for r in mix)
    assert all(got[d] == n for d, n in times.items() if d not in (None, 701))

    # packing: every token of every row, once
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in packs:
        pieces[r.doc_id].append(r)
    for d, n in got.items():
        if d in (None, 701):
            continue
        ids = [*tokenizer.encode(next(r.text for r in mix if r.doc_id == d), add_special_tokens=False).ids, 2]
        assert sum(r.length for r in pieces[d]) == n * len(ids)
        for r in pieces[d]:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]


def test_run(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert p.run(spark, sf_dir).agg(F.sum("length"), F.count("*")).first() == out.agg(F.sum("length"), F.count("*")).first()


def test_empty_corpus(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_workers_give_memory_back():
    """What a task took in small blocks goes back to the system when it ends, even below a block that stays."""
    from tessera.llm.common import released

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    stays = []

    def task(batches):
        held = [b"x" * 60_000 for _ in range(4000)]
        stays.append(b"x" * 60_000)
        yield resident() + 0 * len(held)

    most = list(released(task)(iter(())))[0]
    assert resident() < most - 180_000_000


def test_batches_are_bounded(spark):
    from tessera import ship

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(ship.BATCH_SETTING)
    try:
        spark.conf.unset(ship.BATCH_SETTING)
        ship.shipped(lambda spark: None)(spark)
        large = spark.range(0, 10_000, 1, 1).selectExpr("repeat('x', 4000) t").mapInArrow(sizes, "n bigint")
        assert max(r["n"] for r in large.collect()) < 20_000_000
        spark.conf.set(ship.BATCH_SETTING, "1000000")  # one's own setting stays
        ship.shipped(lambda spark: None)(spark)
        assert spark.conf.get(ship.BATCH_SETTING) == "1000000"
    finally:
        spark.conf.set(ship.BATCH_SETTING, before)
