"""Secret scanning with structural confirmation.

Patterns propose; what they propose beyond the base kinds is reported only
when it decodes and the decoded bytes have the nested structure of a key or a
signed token.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

# The base patterns, by kind, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")
# Kinds that the confirmation adds.
ADDED_KINDS = ("token", "pem", "key64", "key16")
KIND_ORDER = {k: n for n, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----([A-Za-z0-9+/=\s]{16,})-----END \1-----", re.A)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
LEAST_DECODED = 24

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base kinds, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def decoded64(run: str) -> bytes | None:
    """Base64 of either alphabet, with or without padding; None if it isn't."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """A DER length at ``at``: the length and where the content begins."""
    if at >= end:
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > end:
        return None
    length = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (length, at + 1 + n) if length >= 0x80 else None


def is_key_structure(data: bytes) -> bool:
    """DER: one sequence of the whole length, its nested lengths exact, with an integer or an object id."""
    if len(data) < LEAST_DECODED or data[0] != 0x30:
        return False
    found = _length(data, 1, len(data))
    if not found or found[0] + found[1] != len(data):
        return False
    todo, marks, seen = [(found[1], len(data), 1)], 0, 0
    while todo:
        at, end, depth = todo.pop()
        if depth > 12:
            return False
        while at < end:
            tag = data[at]
            found = _length(data, at + 1, end)
            if tag in (0x00, 0xFF) or not found or found[0] + found[1] > end:
                return False
            seen += 1
            marks += tag in (0x02, 0x06)
            if tag & 0x20:
                todo.append((found[1], found[0] + found[1], depth + 1))
            at = found[0] + found[1]
    return seen >= 2 and marks >= 1


def is_ssh_structure(data: bytes) -> bool:
    """The private-key container of the secure shell, or a public key's chain of length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        return _fields(data, len(magic), 3)
    return data[:4] in (b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13") and data[4:8] in (b"ssh-", b"ecds") and _fields(data, 0, 2, whole=True)


def _fields(data: bytes, at: int, least: int, whole: bool = False) -> bool:
    n = 0
    while at + 4 <= len(data) and (whole or n < least):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        n += 1
        if at > len(data):
            return False
    return n >= least and (not whole or at == len(data))


def is_token_header(part: str) -> bool:
    """A signed token's header: a JSON object that names its algorithm."""
    data = decoded64(part)
    if not data or data[:1] != b"{":
        return False
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):  # nested beyond what a header may be
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    found = []
    if "ey" in text and text.count(".") >= 2:
        for m in SIGNED.finditer(text):
            body = decoded64(m[2])
            if is_token_header(m[1]) and body and body[:1] == b"{":
                found.append(("token", *m.span()))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decoded64("".join(m[2].split()))
            if data and (is_key_structure(data) or is_ssh_structure(data)):
                found.append(("pem", *m.span()))
    if max(map(len, text.split()), default=0) >= 32:
        for m in BASE64.finditer(text):
            run = m[0]
            data = decoded64(run)
            if data and (is_key_structure(data) or is_ssh_structure(data)):
                found.append(("key64", *m.span()))
        for m in HEX.finditer(text):
            if len(m[0]) % 2 == 0 and m[0].startswith("30") and is_key_structure(bytes.fromhex(m[0])):
                found.append(("key16", *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KIND_ORDER[s[0]], s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        base, spans = [], []
        for text in batch.column(1).to_pylist():
            base.append(base_spans(text or ""))
            spans.append(base[-1] + confirmed_spans(text or ""))
        count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *map(count, BASE_KINDS),
                pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                pa.array([joined(x) for x in spans], pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, counts of the base kinds, base_sha256 and spans.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start
    and then kind, comma-joined; null and empty texts have none. Texts of any
    length are scanned whole. Each row is judged alone, so repeated rows give
    repeated results, a null id stays null and an empty table gives an empty
    result; other columns are not looked at. No exchange is needed.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``secret_spans`` of all documents."""
    return secret_spans(table(spark, sf_dir, "documents"))
