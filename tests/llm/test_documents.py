"""Operators on documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import language, mixing, mpeg, near, packing, secrets, substring
from tessera.llm.common import WordHash

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").encode().split()


def brute_links(rows, threshold=0.8):
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    known = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in known}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in known}


def test_jaccard_join(spark, make, documents):
    got = rows_of(near.jaccard_join(make(documents), spark))
    assert len(got) == len(documents)
    root = brute_links(documents)
    assert all(r["class_id"] == (root[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)
    copies = [r for r in got if r["doc_id"] in range(200, 205)]
    assert {r["copy_of"] for r in copies} == {200} and len({r["n_links"] for r in copies}) == 1
    assert all(r["n_links"] == 2 for r in got if r["doc_id"] == 500)
    assert {r["n_links"] for r in got if r["doc_id"] in (400, 401, None)} == {0}


def test_jaccard_join_counts_every_link(spark, make):
    """A large group of near copies is dealt out in blocks; every link counts once."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(w), None, None))
    got = {r["doc_id"]: r["n_links"] for r in rows_of(near.jaccard_join(make(rows), spark))}
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t, *_ in rows]
    for i in range(0, 700, 23):
        assert got[i] == sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for j, s in enumerate(sets) if j != i)


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 400).astype(np.uint64)
    pairs = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 45).astype(np.uint64)])) for _ in range(40)]
    sig = np.stack([near.signature(s) for s in pairs])
    i, j = np.triu_indices(40, 1)
    assert len(near.Pruner().survivors(sig, sig, i, j)[0]) == len(i)
    other = np.stack([near.signature(np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))) for _ in range(40)])
    assert not len(near.Pruner().survivors(other, other, i, j)[0])


def test_intersections_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    assert near.intersections(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_secrets(spark, make, documents):
    import base64
    import json

    b = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = f"{b(json.dumps({'alg': 'HS256'}).encode())}.{b(b'{}')}.{b(b'signature')}"
    fake = f"{b(b'not a header at all')}.{b(b'{}')}.{b(b'x')}"
    numbers = b"\x02\x01\x00" + b"\x02\x20" + bytes(range(1, 33)) + b"\x02\x03\x01\x00\x01"
    der = b"\x30" + bytes([len(numbers)]) + numbers
    text64 = base64.b64encode(der).decode()
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = secrets.OPENSSH + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"q" * 30)
    texts = [
        "password = 'abcdefghijkl' and Token:short API-KEY=abcdefghijklmnop api_key: zzzzzzzzzzzz",
        "password: token: abcdefghijklmn", f"AKIA{'A' * 13} AKIA{'B' * 14}", "deadbeef" * 2 + " DEADBEEFDEADBEEF " + "0" * 15,
        f"x {jwt} y {fake}", f"-----BEGIN RSA PRIVATE KEY-----\n{text64[:40]}\n{text64[40:]}\n-----END RSA PRIVATE KEY-----",
        f"key {text64} broken {base64.b64encode(der[:-1]).decode()}", base64.b64encode(ssh).decode(), der.hex(), "pa\u017f\u017fword=abcdefghijklmn",
    ]
    rows = [*documents, *((1000 + i, t, None, None) for i, t in enumerate(texts))]
    got = rows_of(secrets.scan_secrets(make(rows)))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    text = {d: t or "" for d, t, *_ in rows}
    for d, r in by.items():
        if d is None:
            continue
        base = []
        for order, (name, pattern, least) in enumerate((("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))):
            for m in re.finditer(pattern, text[d]):
                if len(m[2] if order == 0 else m[0]) >= least:
                    base.append((m.start(), order, f"{name}:{m.start()}:{m.end()}"))
        assert r["base_sha256"] == hashlib.sha256(",".join(x for *_, x in sorted(base)).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(o == k for _, o, _ in base) for k in range(3)]
    kinds = lambda i: [s.split(":")[0] for s in by[1000 + i]["spans"].split(",") if s]
    assert kinds(0) == ["assign", "assign"] and kinds(1) == [] and kinds(2) == ["access"] and kinds(3) == ["hex"]
    assert kinds(4) == ["jwt"] and kinds(5) == ["pem"] and kinds(6).count("der") == 1 and "openssh" in kinds(7) and "der" in kinds(8) and kinds(9) == []
    assert jwt not in by[1004]["redacted"] and fake in by[1004]["redacted"]
    assert by[400]["spans"] == "" and by[400]["redacted"] == ""


def test_secrets_in_encoded_runs():
    """Escaped, encoded, line-wrapped and hex keys and tokens are found; broken ones aren't."""
    import base64
    import json

    numbers = b"\x02\x01\x00" + b"\x02\x50" + bytes(range(1, 81)) + b"\x02\x03\x01\x00\x01"
    der = b"\x30" + bytes([len(numbers)]) + numbers
    key = base64.b64encode(der).decode()
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = secrets.OPENSSH + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"q" * 30)
    pem = f"-----BEGIN PRIVATE KEY-----\n{key[:64]}\n{key[64:]}\n-----END PRIVATE KEY-----\n"
    b = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = f"{b(json.dumps({'alg': 'HS256'}).encode())}.{b(b'{}')}.{b(b'signature')}"
    for text, kind, secret in [
        (json.dumps({"type": "service_account", "private_key": pem}), "pem", None),
        (json.dumps(json.dumps({"private_key": pem})), "pem", None),
        ("tls.key: " + base64.b64encode(pem.encode()).decode() + " x", "pem", None),
        ("x " + base64.b64encode(f"user: a\n{pem}".encode()).decode(), "pem", None),
        (f"the key\n{key[:40]}\n{key[40:80]}\n{key[80:]}\nends", "der", f"{key[:40]}\n{key[40:80]}\n{key[80:]}"),
        (f'"\\n{key[:64]}\\n{key[64:]}\\n"', "der", f"{key[:64]}\\n{key[64:]}"),
        ("x " + ssh.hex() + " y", "openssh", ssh.hex()), ("x " + pem.encode().hex(), "pem", None), (f"a {jwt.encode().hex()} b", "jwt", jwt.encode().hex()),
        (der.hex()[:90] + "\n" + der.hex()[90:], "der", der.hex()[:90] + "\n" + der.hex()[90:]), (base64.b64encode(jwt.encode()).decode(), "jwt", None),
    ]:
        spans = secrets.confirmed_spans(text)
        assert [k for k, *_ in spans] == [kind], (text, spans)
        assert secret is None or text[spans[0][1] : spans[0][2]] == secret
        assert key[8:30] not in secrets.redact(text, spans, "*")
    for text in (base64.b64encode(der[:-1]).decode(), der.hex()[:-2], base64.b64encode(ssh + b"x").decode(), "word\nword-of_more/letters\n" * 30, key[:40] + "\n" + key[48:]):
        assert secrets.confirmed_spans(text) == []


def test_language(spark, make, documents):
    docs = make(documents)
    model = language.learned(docs)
    got = rows_of(language.label(docs, spark, model))
    assert len(got) == len(documents) and model.langs == ["en", "fr"]
    truth = {d: lang for d, t, lang, _ in documents if lang and t and len(t.split()) > 20 and d is not None}
    pred = {r["doc_id"]: r for r in got}
    assert np.mean([pred[d]["lang_pred"] == lang for d, lang in truth.items()]) > 0.95
    assert all(pred[d]["lang_pred"] == "und" and pred[d]["score"] == 0 for d in (400, 401, 402, 407))
    assert all(0 <= r["score"] <= 1 for r in got)
    mixed = " ".join(["the of and to in that was with for have"] * 3 + ["les des une dans que qui pour sur avec est"] * 3)
    r = rows_of(language.label(make([(1, mixed, None, None), (2, "привет мир", None, None)]), spark, model))
    spans = {x["doc_id"]: x for x in r}
    assert [s.split(":")[0] for s in spans[1]["spans"].split(",")] == ["en", "fr"] and abs(spans[1]["score"] - 0.5) < 0.1
    assert spans[2]["lang_pred"] in model.langs and spans[2]["score"] == 0


def test_language_reads_runs_whole(spark, make):
    """Letters after the first 60 of a run count, in training too, and a run changes word where its script changes."""
    assert language.split_words("A" * 130 + " a漢字bc é²") == ["a" * 60, "a" * 60, "a" * 10, "a", "漢字", "bc", "é²"]
    rows = [(i, "ab" * 30 + ("cdce" if i % 2 else "fgfh") * 50, "xx" if i % 2 else "yy", None) for i in range(40)]
    rows += [(100 + i, "漢字仮名" * 20, "zh", None) for i in range(20)]
    model = language.learned(make(rows))
    texts = ["cdce" * 60 + "fgfh" * 60, "A" + "漢字仮名" * 40, "ab" * 30 + "fgfh" * 200]
    got = {r["doc_id"]: r for r in rows_of(language.label(make([(i, t, None, None) for i, t in enumerate(texts)]), spark, model))}
    assert got[0]["spans"] == "xx:4,yy:4" and got[1]["lang_pred"] == "zh" and got[1]["score"] > 0.98 and got[2]["lang_pred"] == "yy"


def test_viterbi_against_dynamic_programming():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 7, 30, 3, 0, 12]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(starts[-1], 3)).astype(np.float32)
    got = language.viterbi(scores, starts, 1.5)
    for a, b in zip(starts, starts[1:]):
        value = lambda y: sum(scores[a + t, k] for t, k in enumerate(y)) - 1.5 * sum(p != q for p, q in zip(y, y[1:]))  # noqa: B023, E731
        v = scores[a:b].astype(float)
        if b == a:
            continue
        table = [v[0]]
        for row in v[1:]:
            table.append(np.maximum(table[-1], table[-1].max() - 1.5) + row)
        best = table[-1].max()
        assert abs(value(got[a:b]) - best) < 1e-3


def test_viterbi_with_many_languages():
    scores = np.full((400, 200), -50, np.float32)
    best = np.repeat([3, 199, 127, 128], 100)
    scores[np.arange(400), best] = 0
    assert language.viterbi(scores, np.array([0, 400]), 12.0).tolist() == best.tolist()


def test_held_out(spark, make):
    got = make([(i, "x", None, None) for i in range(50)]).select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_mpeg(spark, make, documents):
    got = rows_of(mpeg.store(make(documents)))
    assert len(got) == len(documents)
    text = {d: t or "" for d, t, *_ in documents if d is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = text[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert r["frames"] == -(-len(payload) // 384) and r["duration_samples"] == 384 * r["frames"]


def test_mpeg_reader():
    media = mpeg.write(bytes(range(255)) * 9)
    assert mpeg.read(media).payload == bytes(range(255)) * 9
    tag_end = len(media) - 7 * 448
    junk = media[:tag_end] + b"\xff\xfb junk \xff" + media[tag_end:] + b"TAG" + bytes(125)
    a = mpeg.read(junk)
    assert a.payload == bytes(range(255)) * 9 and a.skipped > 0 and len(a.offsets) == 6 and a.bad == 0
    bad = bytearray(media)
    bad[-448 + 8] ^= 1  # in the last frame's allocation
    assert mpeg.read(bytes(bad)).bad == 1
    layer3 = bytes((0xFF, 0xFB, 0x90, 0xC4)) + bytes(413)
    xing = bytearray(layer3)
    xing[21:33] = b"Xing" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    a = mpeg.read(bytes(xing) + layer3 * 2)
    assert (a.table, a.table_frames, len(a.offsets), a.samples, a.rate) == ("Xing", 2, 2, 2304, 44100)
    with pytest.raises(ValueError):
        mpeg.write(b"\xff")


def test_mpeg_offsets_checksums_and_seek_tables(spark, make):
    r = rows_of(mpeg.store(make([(1, "x" * 1000, None, None)])))[0]
    assert len(r["frame_offsets"]) == r["frames"] == 3 and all(r["media"][a : a + 4] == mpeg.HEADER for a in r["frame_offsets"])
    assert len(r["seek_points"]) == 100 and r["seek_points"] == sorted(r["seek_points"])

    def bit(bits):  # the checksum, bit by bit
        c = 0xFFFF
        for b in bits:
            c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) != b else 0)
        return c.to_bytes(2, "big")

    unpacked = lambda x: np.unpackbits(np.frombuffer(x, np.uint8)).tolist()
    # Layer III stereo: 32 bytes of side information. Layer II, 44.1 kHz mono, 96 kbit/s (30 subbands, 94 bits of codes), two in use: 4 bits of scfsi.
    for head, body, covered in (((0xFF, 0xFA, 0x90, 0x04), bytes(range(32)) + bytes(379), 32 * 8), ((0xFF, 0xFC, 0x70, 0xC0), b"\x11" + bytes(306), 94 + 4)):
        head = bytes(head)
        size = mpeg.header(head, 0).size
        body = body[: size - 6].ljust(size - 6, b"\0")
        frame = head + bit(unpacked(head[2:]) + unpacked(body)[:covered]) + body
        a = mpeg.read(frame * 3)
        assert (len(a.offsets), a.checked, a.bad) == (3, 3, 0)
        broken = bytearray(frame)
        broken[7] ^= 1
        assert mpeg.read(frame + bytes(broken) + frame).bad == 1
    layer3 = bytes((0xFF, 0xFB, 0x90, 0xC4)) + bytes(413)
    vbri = bytearray(layer3)
    toc = b"".join(x.to_bytes(2, "big") for x in (417, 417, 5))
    vbri[36 : 62 + len(toc)] = b"VBRI" + bytes(6) + (1251).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 1, 2, 1)) + toc
    a = mpeg.read(bytes(vbri) + layer3 * 2)
    assert (a.table, a.table_frames, a.table_bytes, a.seek) == ("VBRI", 3, 1251, [0, 417, 834])


def test_packing(spark, make, documents):
    got = rows_of(packing.pack(make(documents), PATH))
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in documents if d is not None}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None and r["doc_id"] != 500:
            pieces[r["doc_id"]].append(r)
            part = np.asarray(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    assert set(pieces) == set(ids) - {500}
    padded = used = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
        assert at <= 4096
    assert padded <= 0.01 * used


def test_encoder_equals_tokenizer():
    import random

    tokenizer, encoder, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(1)
    letters = "aAzZéÉßİıΣσς'’.,!?;:- \n\t\r\x0b\x85\u00a0\u0301\u00ad<|>0123½²ªºǅĲĳŉ\U0001f600\u200dend한ﬁÅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a", "x<|startoftext|>y", "Don't. I'LL, we'Re!", "á e \u0301", "", "  \n"]
    for t, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_substring(spark, make, documents, monkeypatch):
    expected, seen = {}, {}
    for d, t in sorted((d, t) for d, t, *_ in documents if d is not None and t):
        w = words(t)
        gone, new = set(), []
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if seen.get(k, d) < d:
                gone |= set(range(i, i + 13))
            new.append(k)
        for k in new:
            seen.setdefault(k, d)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    for shard, piece in ((16_384, 512), (60, 5)):  # small shards are split again and again
        monkeypatch.setattr(substring, "SHARD_WORDS", shard)
        monkeypatch.setattr(substring, "PIECE", piece)
        got = rows_of(substring.drop_repeats(make(documents), spark))
        assert len(got) == len(documents)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected.get(r["doc_id"], (0, 0, hashlib.sha256(b"").hexdigest()))
            else:
                assert r["n_removed"] == 0


def test_substring_of_long_periodic_texts(spark, make):
    """Two texts of a million words with a period of seven: pieces of them are equal, so no automaton is long."""
    rows = [(1, "a b c d e f g " * 150_000, "en", "s"), (2, "x y z " + "a b c d e f g " * 150_000 + "end of it", "en", "s"), (3, "q " * 1_000_000, "en", "s"), (4, "q " * 20, "en", "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows_of(substring.drop_repeats(make(rows), spark, with_text=False))}
    assert got == {1: (1_050_000, 0), 2: (1_050_006, 1_050_000), 3: (1_000_000, 0), 4: (20, 20)}


def test_substring_of_large_shards_joins_what_is_shared(spark):
    """A segment that is there once and alone in its shard gives no row to join; one that several have does, and so do different ones of a shard."""
    text = [" ".join(f"{x}{i}" for i in range(13)).encode() for x in "abcd"]
    shards = spark.createDataFrame([(1, 1, 7, text[0], 1), (2, 2, 8, text[1], 2), (3, 3, 4, text[2], 1), (3, 4, 5, text[3] + b" " + text[2], 1)], "h long, s long, doc long, words binary, times long")
    got = {(r["h"], r["s"]): r["firsts"] for r in substring.first_documents(shards, 13).collect()}
    assert got == {(2, 2): [8], (3, 3): [4], (3, 4): [5] * 13 + [4]}


def test_anchors_of_several_documents(spark, make):
    """Chunks get back those of their anchors that several documents have, in whichever chunks those are."""
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(30))} {common}" if i < 4 else " ".join(f"u{i}x{j}" for j in range(30)), "en", "s") for i in range(8)] + [(None, common, "en", "s")]
    both = substring.texts_and_anchors(make(rows), 13)
    both = spark.createDataFrame(both.collect(), both.schema)
    got = set()
    for r in substring.shared_anchors(both.where("bucket is not null").select("bucket", "chunk", "h", "low", "high")).collect():
        got |= set(np.frombuffer(r["anchors"], np.uint64).tolist())
    one = lambda text: set(substring.anchors(*WordHash().flat([words(text)]))[0].tolist())
    assert one(common) <= got
    assert not any(one(" ".join(f"u{i}x{j}" for j in range(30))) & got for i in range(4, 8))


def test_pieces():
    h, doc, start, n = substring.pieces(np.array([5, 6], np.uint64), np.array([0, 1]), np.array([10, 3]), np.array([1030, 4]))
    assert h.tolist() == [5, 5, 5, 6] and doc.tolist() == [0, 0, 0, 1] and start.tolist() == [10, 522, 1034, 3] and n.tolist() == [512, 512, 6, 4]


def test_suffix_automaton_against_search():
    import random

    rng = random.Random(9)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    automaton = substring.SuffixAutomaton()
    for d, t in enumerate(texts):
        automaton.add(t, d)
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    query = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
    for end, (n, first) in enumerate(automaton.matching(query, 5)):
        best = max(k for k in range(min(5, end + 1) + 1) if k == 0 or any(inside(query[end + 1 - k : end + 1], t) for t in texts))
        assert n == best
        if n:
            assert first == min(d for d, t in enumerate(texts) if inside(query[end + 1 - n : end + 1], t))


def test_mixing(spark, make, documents):
    got = rows_of(mixing.mix(make(documents), spark))
    assert len(got) == len(documents)
    size = Counter()
    for d, t, _, s in documents:
        size[s] += len(words(t))
    order = sorted((s for s in size), key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:  # as stated: cap, reshare the excess by weight, until none is above
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ -= over or set(open_)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    most = {s: max(len(words(t)) for _, t, _, q in documents if q == s) for s in order}
    assert all(target[s] - 3 * most[s] <= taken[s] <= target[s] + 1e-6 for s in order)
    again = {(r["doc_id"], r["size"], r["taken"]) for r in rows_of(mixing.mix(make(documents), spark))}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in got}


def test_empty_tables(spark, make):
    docs = make([])
    assert near.jaccard_join(docs, spark).count() == 0
    assert secrets.scan_secrets(docs).count() == 0
    assert language.label(docs, spark, language.learned(docs)).count() == 0
    assert mpeg.store(docs).count() == 0
    assert packing.pack(docs, PATH).count() == 0
    assert substring.drop_repeats(docs, spark).count() == 0
    assert mixing.mix(docs, spark).count() == 0


def test_shingles():
    h = WordHash()
    assert len(near.shingles("a b c d e f", h)) == 2 and len(near.shingles("a b", h)) == 1 and len(near.shingles(None, h)) == 0
    assert near.shingles("a b", h).tolist() == near.shingles(" a\tb\n", h).tolist()


def test_jaccard_join_at_other_thresholds(spark, make):
    """Links between the threshold and 0.8 are found too."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(220)]
    rows = [(0, " ".join(base), "en", "s0")]
    for i in range(1, 60):
        w = list(base)
        for at in rng.choice(220, rng.integers(1, 14), replace=False):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s0"))
    root = brute_links(rows, 0.6)
    assert 1 < len({root[d] for d in root}) < 60
    for r in rows_of(near.jaccard_join(make(rows), spark, threshold=0.6)):
        assert r["class_id"] == root[r["doc_id"]]
    assert near.band_size(0.8) == 5 and near.band_size(0.6) < 5
    with pytest.raises(ValueError):
        near.band_size(0.01)


def test_components_of_stars_and_chains(spark):
    from tessera.llm.components import components

    star = [(i, 1000) for i in range(2000, 5000)] + [(i, 1500) for i in range(6000, 8000)] + [(1500, 1000)]
    chain = [(100_000 + i, 100_001 + i) for i in range(70)]
    found = {r.node: r.component for r in components(spark.createDataFrame(star + chain, "a long, b long"), spark).collect()}
    assert all(found[n] == 1000 for e in star for n in e) and all(found[n] == 100_000 for e in chain for n in e) and len(found) == 5002 + 71


def test_mixing_takes_rows_without_ids_one_by_one(spark):
    rows = [(None, f"{'w ' * 50}{i}", "en", "a") for i in range(400)] + [(i, "v " * 100, "en", "b") for i in range(30)]
    out = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark))
    a = [r for r in out if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 102


def test_mixing_of_very_many_sources(spark):
    """As many sources as rows: running sums over ranges equal those over one list."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 9, 700)
    rows = [(i, "w " * int(n), "en", f"s{i:04}") for i, n in enumerate(sizes)] + [(1000, "w " * 5, "en", None)]
    got = {r["source"]: r["target"] for r in rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark))}
    size = {s: len(words(t)) for _, t, _, s in rows}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(size.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in order)


def test_secrets_nested_and_long(spark):
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body

    inner = der(2, b"\x01" * 40)
    for _ in range(5000):
        inner = der(0x30, inner)
    assert secrets.der_items(inner) == 5001 and secrets.der_items(inner[:-1]) is None
    assert secrets.der_items(der(0x30, der(2, b"ab") + der(4, b"c"))) == 3 and secrets.der_items(b"\x30\x05\x02\x01") is None
    key = der(0x30, der(2, b"\0") + der(2, b"\x05" * 60) + der(0x30, der(6, b"\x2a\x03")))
    import base64

    label = "VERY " * 20 + "LONG KEY"
    text = f"-----BEGIN {label}-----\n{base64.b64encode(key).decode()}\n-----END {label}-----"
    assert [s[0] for s in secrets.plain_spans(text)] == ["pem"]
    field = lambda b: len(b).to_bytes(4, "big") + b
    many = secrets.OPENSSH + field(b"none") * 2 + field(b"") + (90).to_bytes(4, "big") + field(b"public") * 90 + field(b"private")
    assert secrets.is_openssh_key(many) and not secrets.is_openssh_key(many[:-1])
    assert secrets.openssh_size(secrets.OPENSSH + field(b"none") * 2 + field(b"") + b"\xff\xff\xff\xff" + bytes(400)) == 0


def test_mpeg_reader_of_alternating_headers():
    """Frames that differ in padding one by one: time grows with the stream."""
    import time

    frame = lambda padded: bytes([0xFF, 0xFB, 0x90 | 2 * padded, 0]) + bytes(413 + padded)
    took = []
    for n in (2000, 16_000):
        began = time.process_time()
        audio = mpeg.read(b"".join(frame(i % 2) for i in range(n)))
        took.append(time.process_time() - began)
        assert len(audio.offsets) == n and audio.samples == 1152 * n
    assert took[1] < 30 * max(took[0], 0.02)


def test_language_of_held_out_documents(spark):
    """All languages of the table, those documents only that the model has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.label(docs, spark, language.learned(docs)).join(docs.selectExpr("doc_id d", "lang"), F.col("doc_id") == F.col("d"))
    found = [(r.lang, r.lang_pred) for r in got.where(language.held_out(F.col("doc_id"))).where("lang is not null and lang_pred <> 'und'").collect()]
    assert len({a for a, _ in found}) == 4 and sum(a == b for a, b in found) > 0.95 * len(found)
