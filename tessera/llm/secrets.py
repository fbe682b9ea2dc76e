"""Secret scans with structural confirmation.

Three base patterns report what looks like an assigned secret, an access key id or a long hex run.
Besides, all long runs of base64, URL-safe base64 and hex are decoded, also over line breaks and their
escapes, and keys, PEM armour and tokens, encoded or plain, are reported only if what they hold parses: DER with nested lengths that add up, an OpenSSH private key
whose fields end where the data ends, or a signed token whose header is JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, chunked, released

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the run with its 4 letters has 18 or more
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")

JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", re.ASCII)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----((?:[A-Za-z0-9+/=\s]|\\+[nr])++)-----END \1-----", re.ASCII)
#: A line break, or its escape, inside an encoded run.
_BREAK = r"(?:[ \t]*+(?:(?:\r?\n|\r|\\+[nr])[ \t]*+)++)"
BREAK = re.compile(_BREAK, re.ASCII)
#: Runs of base64 of 32 letters, or of hex of 48, or shorter ones that go on after a break.
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nr]))[A-Za-z0-9+/_-]++(?:(?:" + _BREAK + r"[A-Za-z0-9+/_-]++)++|(?<=[A-Za-z0-9+/_-]{32}))={0,2}", re.ASCII)
HEX_RUN = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]++(?:(?:" + _BREAK + r"[0-9a-fA-F]++)++|(?<=[0-9a-fA-F]{48}))(?![0-9a-fA-F])", re.ASCII)
OPENSSH = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """The bytes of a standard or URL-safe base64 text, padded or not; None if it isn't one."""
    body = "".join(text.split()).rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> int | None:
    """The number of DER items in data, nested to any depth, if all their lengths add up, else None."""
    at, n, ends = 0, 0, [len(data)]
    while True:
        while ends and at == ends[-1]:
            ends.pop()
        if not ends:
            return n
        if at + 2 > ends[-1]:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if tag & 31 == 31 or tag == 0:
            return None
        if size & 128:
            k = size & 127
            if not 1 <= k <= 4 or at + k > ends[-1]:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + size > ends[-1]:
            return None
        n += 1
        if tag & 32:
            ends.append(at + size)
        else:
            at += size


def is_der_key(data: bytes) -> bool:
    """One outer sequence over all of data, with three items or more inside, an integer or identifier among the first."""
    if len(data) < 24 or data[0] != 0x30 or (der_items(data) or 0) < 4:
        return False
    at = 2 + (data[1] & 127 if data[1] & 128 else 0)
    whole = at + (int.from_bytes(data[2:at], "big") if data[1] & 128 else data[1])
    return whole == len(data) and data[at] in (0x02, 0x30)


def der_size(data: bytes) -> int:
    """The size of the sequence that data starts with, by its header; 0 if there is none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    at = 2 + (data[1] & 127 if data[1] & 128 else 0)
    return at + (int.from_bytes(data[2:at], "big") if data[1] & 128 else data[1]) if at <= 6 else 0


def openssh_size(data: bytes) -> int:
    """The size of the key that data starts with: the magic, three strings, a count of keys and that many public keys and a private block; 0 if there is none."""
    if not data.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def field() -> bool:
        nonlocal at
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not all(field() for _ in range(3)) or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if keys and all(field() for _ in range(keys + 1)) else 0  # ends where the data does, however many they claim


def is_openssh_key(data: bytes) -> bool:
    """One key, to the last byte."""
    return 0 < openssh_size(data) == len(data)


def is_signed_token(text: str) -> bool:
    head, body, sign = text.split(".")
    try:
        header = json.loads(unbase64(head) or b"")
    except ValueError:
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return False
    return unbase64(body) is not None and (unbase64(sign) is not None if sign else header["alg"].lower() == "none")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns; an assigned value has 12 characters or more."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens and of PEM armour whose contents parse."""
    out = []
    if "ey" in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64(BREAK.sub("", m[2]))
            if data and (is_der_key(data) or is_openssh_key(data)):
                out.append(("pem", m.start(), m.end()))
    return out


def encoded_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of keys, armour and tokens in what base64 and hex runs hold, line breaks left out.

    A key starts where a line of the run does and ends where one ends, so that other words may precede
    or follow it on lines of their own; armour and tokens may be anywhere in the bytes.
    """
    out = []
    # so many letters hold so many bytes
    for pattern, least, letters, size, decode in ((BASE64, 32, 4, 3, unbase64), (HEX_RUN, 48, 2, 1, bytes.fromhex)):
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            lines, at = [], m.start()
            for br in BREAK.finditer(text, m.start(), m.end()):
                lines.append((at, br.start()))
                at = br.end()
            lines.append((at, m.start() + len(m[0].rstrip("="))))
            joined = "".join(text[a:b] for a, b in lines)
            if len(joined) < least:
                continue
            starts = [0, *accumulate(b - a for a, b in lines)]
            ends = set(starts[1:])

            def span(kind: str, a: int, b: int) -> tuple[str, int, int]:
                i, j = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1  # noqa: B023
                end = lines[j][0] + b - starts[j]  # noqa: B023
                return kind, lines[i][0] + a - starts[i], m.end() if b == len(joined) else end  # noqa: B023

            # All letters at one distance modulo `letters` are read by one decoding.
            for first in {s % letters: s for s in reversed(starts[:-1])}.values():
                body = joined[first:]
                data = decode(body[: len(body) - (len(body) % letters == 1)]) or b""
                for s in starts[:-1]:
                    if s < first or (s - first) % letters:
                        continue
                    at = (s - first) // letters * size
                    for kind, magic, sized, holds in (("der", b"0", der_size, is_der_key), ("openssh", OPENSSH, openssh_size, is_openssh_key)):
                        if data.startswith(magic, at) and (n := sized(data[at : at + 8] if kind == "der" else data[at:])):
                            end = s - (-n * letters // size)
                            if end in ends and holds(data[at : at + n]):
                                out.append(span(kind, s, end))
                if b"ey" in data or b"-----BEGIN " in data:
                    for kind, a, b in plain_spans(data.decode("latin-1")):
                        out.append(span(kind, first + a * letters // size, min(first - (-b * letters // size), len(joined))))
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of encoded keys and tokens whose structure parses."""
    out = plain_spans(text)
    pems = [(a, b) for kind, a, b in out if kind == "pem"]
    out += [s for s in encoded_spans(text) if not any(a <= s[1] < b for a, b in pems)]
    return list(dict.fromkeys(out))


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string, n_spans bigint"


def scan_secrets(docs: DataFrame, mark: str = "[REDACTED]", with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, spans, and the text with the spans replaced.

    A null text counts as empty: no spans. Empty texts have no spans; repeated rows give repeated
    rows; a null doc_id stays null; an empty table gives an empty table; other columns of docs are
    not read, so their names cannot clash. Texts are scanned whole, one at a time. Positions are code
    points, ends exclusive. with_text=False leaves `redacted` null. keep names columns of docs to carry
    along, besides doc_id.
    """
    rest, schema = carried(docs, tuple(c for c in keep if c != "doc_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + confirmed_spans(text)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), redact(text, spans, mark) if with_text else None, len(spans)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()]))],
                names=[*rest, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted", "n_spans"],
            )

    kept = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *(c for c in rest if c != "text"))
    return kept.mapInArrow(released(scan), schema + SCHEMA)
