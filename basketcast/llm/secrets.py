"""Secrets in text, confirmed by their structure before they are reported.

Three plain kinds are found by pattern: ``assign`` (a credential name with a value), ``access``
(an access key id) and ``hex`` (a long hexadecimal run). Four more are reported only when the
candidate decodes and its inner structure holds together:

* ``pem``: an armoured private key whose body is a private-key encoding,
* ``signed_token``: three base64url parts, the first a JSON header that names an algorithm, the
  second a JSON object,
* ``key_base64`` / ``key_hex``: a bare base64 or hexadecimal run that is a private-key encoding; base64 may
  be wrapped in full lines of 64 or 76 signs.

A private-key encoding is DER whose nested lengths fill their parents exactly and whose outer
sequence has the shape of PKCS#1, PKCS#8, SEC 1 or DSA keys, or the binary OpenSSH form whose
length-prefixed fields fill it.

A vectorised test sends only rows that can hold a kind to the exact patterns. Positions are code
points, ends exclusive. Defined cases: a null text is empty and has no findings; findings are
ordered by start, then by kind as listed in ``KINDS``; repeated rows and null ids are scanned row by row;
an empty table gives an empty result; every search is linear in a very long text; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.common import blocks, small_batches, strings

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "signed_token", "key_base64", "key_hex")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
# Full lines of 64 or 76 signs and a last one.
WRAPPED = [re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{%d}\r?\n)+[A-Za-z0-9+/_-]{1,%d}={0,2}(?![A-Za-z0-9+/_-])" % (n, n)) for n in (64, 76)]
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

# Tests that a whole column passes through; a superset of what the patterns above accept.
MAYBE = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "signed_token": r"[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2}[A-Za-z0-9_-]*\.",
    "key_base64": r"[A-Za-z0-9+/_-]{40}",
    "key_hex": r"[0-9A-Fa-f]{48}",
}
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the elements that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size == 0x80:
            return None
        if size > 0x80:
            digits = size & 0x7F
            if digits > 4 or at + digits > len(data):
                return None
            size, at = int.from_bytes(data[at:at + digits], "big"), at + digits
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = der_items(outer[0][1])
    if not inner or inner[0][0] != INTEGER or inner[0][1] not in (b"\x00", b"\x01"):
        return False
    tags = [tag for tag, _ in inner]
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8: algorithm, then the key in an octet string
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(inner[2][1]) >= 16
    if tags[:2] == [INTEGER, OCTETS]:  # SEC 1: version 1, scalar, optional curve and point
        return inner[0][1] == b"\x01" and 16 <= len(inner[1][1]) <= 80 and all(t in (0xA0, 0xA1) for t in tags[2:])
    # PKCS#1 has nine integers (or more primes behind them), DSA six.
    return (tags[:9] == [INTEGER] * 9 and all(t in (INTEGER, SEQUENCE) for t in tags)) or tags == [INTEGER] * 6


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []

    def take(at: int) -> tuple[bytes | None, int]:
        size = int.from_bytes(data[at:at + 4], "big")
        return (data[at + 4:at + 4 + size], at + 4 + size) if at + 4 + size <= len(data) and at + 4 <= len(data) else (None, at)

    for _ in range(3):  # cipher, derivation, its options
        field, at = take(at)
        if field is None:
            return False
        fields.append(field)
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        field, at = take(at)
        if field is None:
            return False
    return at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, padded or not; None if it is neither."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(text: str) -> dict | None:
    try:
        value = json.loads((decoded(text) or b"").decode())
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, body: str, signature: str) -> bool:
    head = json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or json_object(body) is None:
        return False
    return head["alg"].lower() == "none" or len(decoded(signature) or b"") >= 16


def armoured_parts(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``start, end, label, body`` of each END line with the nearest BEGIN line of its label in front of it, in one pass."""
    opened: dict[str, tuple[int, int]] = {}
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            opened[m[2]] = m.span()
        elif m[2] in opened:
            start, inner = opened[m[2]]
            opened.clear()
            yield start, m.end(), m[2], text[inner:m.start()]


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of confirmed tokens; behind a candidate that is none the search goes on at its second part."""
    at = 0
    while m := TOKEN.search(text, at):
        signed = is_signed_token(m[1], m[2], m[3])
        if signed:
            yield m.span()
        at = m.end() if signed else m.start(2)


def findings(text: str, kinds: set[str] | None = None) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` in one text, in order; ``kinds`` limits the search."""
    wanted = set(KINDS) if kinds is None else kinds
    found: list[tuple[int, str, int]] = []
    if "assign" in wanted:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in wanted:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "hex" in wanted:
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    armoured = []
    if "pem" in wanted:
        for start, end, label, body in armoured_parts(text):
            # Bodies in source code carry escaped line ends; legacy headers end with an empty line.
            body = body.replace("\\r", "").replace("\\n", "\n")
            encrypted = "ENCRYPTED" in body[:200] or "ENCRYPTED" in label
            lines = [line.strip(" \t\r\"',+") for line in body.split("\n") if ":" not in line]
            data = decoded("".join(lines))
            if is_key(data) or encrypted and data:
                armoured.append((start, end))
    found += [(s, "pem", e) for s, e in armoured]
    taken = np.zeros(len(text) + 1, bool) if armoured else None
    for s, e in armoured:
        taken[s:e] = True
    outside = lambda m: taken is None or not taken[m.start()]
    if "signed_token" in wanted:
        found += [(s, "signed_token", e) for s, e in signed_tokens(text)]
    if "key_base64" in wanted:
        candidates = [m for pattern in (BASE64, *WRAPPED) for m in pattern.finditer(text) if outside(m)]
        found += [(m.start(), "key_base64", m.end()) for m in candidates if is_key(decoded(m[0].replace("\r", "").replace("\n", "")))]
    if "key_hex" in wanted:
        found += [(m.start(), "key_hex", m.end()) for m in HEX_KEY.finditer(text) if outside(m) and is_key(bytes.fromhex(m[0]))]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1]), f[2]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``findings`` (kind, start, end, in order) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = strings(block.column("text"))
            maybe: dict[int, set[str]] = {}
            for name, pattern in MAYBE.items():
                for row in pc.indices_nonzero(pc.match_substring_regex(texts, pattern)).to_pylist():
                    maybe.setdefault(row, set()).add(name)
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for row, names in maybe.items():
                out[row] = [{"kind": k, "start": s, "end": e} for s, k, e in findings(texts[row].as_py(), names)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(out, kind)], names=["doc_id", "findings"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base kinds and all spans as text."""
    def text(of):
        return F.array_join(F.transform(of, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(name):
        return F.size(F.filter("findings", lambda f: f["kind"] == name)).cast("long")

    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("findings")).alias("spans"),
                        F.size(F.filter("findings", lambda f: ~f["kind"].isin(*BASE_KINDS))).cast("long").alias("n_confirmed"))
