"""Secret scans with structural confirmation.

Three base kinds are found by pattern alone: ``assign`` (a password, token or key
assigned to a value), ``access`` (access key ids) and ``hex`` (hex runs). What looks
like an encoded key or signed token is decoded and parsed before it is reported:

``jwt``    three base64url parts; the first decodes to a JSON object that names its
           algorithm, the second to a JSON object; only algorithm "none" has no signature
``pem``    a private key between BEGIN and END lines whose body decodes to a key
``key64``  a base64 run (either alphabet) that holds a key
``key16``  a hex run that holds a key

A key is a DER sequence whose lengths nest exactly (tag, length, all of its members to
the last byte) in one of the shapes of private keys - nine integers; version, algorithm,
octets; version, octets; algorithm, octets when encrypted - or the OpenSSH form, whose
length-prefixed strings must end at its end. Only the members' heads are decoded to look
at a candidate, so a long run costs time in proportion to its length.

Positions are code points, the end exclusive; matches of a kind never overlap. Whole
texts are read, a document at a time, in Arrow batches of one task; nothing is shuffled.
Defined results: null and empty texts have no spans; rows that repeat or have a null id
are scanned like any other; a column named like the result is replaced by it; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "jwt", "pem", "key64", "key16"]
SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_CHARS)

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
RUN64, RUN16 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}"), re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{60,}")
#: Where a DER sequence of 28 bytes or more can start in base64 (0x30, then a length), and in hex.
START64, START16 = re.compile(r"M[BCDEFGHI]"), re.compile(r"30(?=[1-8])")
SSH_MAGIC = b"openssh-key-v1\0"
SSH64 = base64.b64encode(SSH_MAGIC).decode()

Reader = Callable[[int, int], bytes]


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    return (head["alg"].lower() == "none") == (signature == "")


def reader64(text: str, at: int) -> Reader:
    """Bytes ``[lo, hi)`` of the base64 run that starts at ``at``, decoded on demand."""
    def read(lo: int, hi: int) -> bytes:
        first = lo // 3
        part = text[at + first * 4:at + -(-hi // 3) * 4].rstrip("=").replace("-", "+").replace("_", "/")
        if len(part) % 4 == 1:
            part = part[:-1]
        return binascii.a2b_base64(part + "=" * (-len(part) % 4))[lo - first * 3:hi - first * 3]
    return read


def reader16(text: str, at: int) -> Reader:
    return lambda lo, hi: bytes.fromhex(text[at + 2 * lo:at + 2 * hi])


def _element(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``, if it fits."""
    head = read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    size, skip = head[1], 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size, skip = int.from_bytes(head[2:2 + n], "big"), 2 + n
        if size < 0x80 or head[2] == 0:  # DER lengths are minimal
            return None
    return (head[0], at + skip, at + skip + size) if at + skip + size <= end else None


def der_key(read: Reader, n_bytes: int) -> int | None:
    """Length of the private key that starts the bytes, or None."""
    outer = _element(read, 0, n_bytes)
    if outer is None or outer[0] != 0x30 or outer[2] < 28:
        return None
    members, at = [], outer[1]
    while at < outer[2] and len(members) < 12:
        member = _element(read, at, outer[2])
        if member is None or member[1] == member[2] and member[0] in (0x02, 0x04):
            return None
        members.append(member)
        at = member[2]
    tags = [m[0] for m in members]
    if at != outer[2] or not tags:
        return None
    version = read(members[0][1], members[0][2]) if tags[0] == 0x02 and members[0][2] - members[0][1] == 1 else b""
    algorithm = next((m for m in members[:2] if m[0] == 0x30), None)
    if algorithm is not None:  # its first member names the algorithm
        named = _element(read, algorithm[1], algorithm[2])
        if named is None or named[0] != 0x06:
            return None
    rest_is_tagged = lambda n: all(t & 0xC0 == 0x80 for t in tags[n:])
    if version in (b"\0", b"\1") and tags[:9] == [0x02] * 9 and len(tags) in (9, 10):
        return outer[2]
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04] and rest_is_tagged(3):
        return outer[2]
    if version == b"\1" and tags[1:2] == [0x04] and rest_is_tagged(2):
        return outer[2]
    return outer[2] if tags == [0x30, 0x04] else None


def ssh_key(read: Reader, n_bytes: int) -> int | None:
    """Length of the OpenSSH private key that starts the bytes, or None."""
    at = len(SSH_MAGIC)
    if read(0, at) != SSH_MAGIC:
        return None

    def string(at: int) -> int | None:
        head = read(at, at + 4)
        end = at + 4 + int.from_bytes(head, "big")
        return end if len(head) == 4 and end <= n_bytes else None

    for _ in range(3):  # cipher, key derivation and its options
        at = string(at)
        if at is None:
            return None
    count = int.from_bytes(read(at, at + 4), "big")
    if not 1 <= count <= 64:
        return None
    at += 4
    for _ in range(count + 1):  # public keys, then the private part
        at = string(at)
        if at is None:
            return None
    return at


def _whole_key(data: bytes) -> bool:
    read = lambda lo, hi: data[lo:hi]
    return len(data) in (der_key(read, len(data)), ssh_key(read, len(data)))


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while begin := PEM.search(text, at):
        at = begin.end()
        stop = f"-----END {begin[1]}-----"
        close = text.find("-----", at)
        if close < 0 or not text.startswith(stop, close):
            continue
        body = text[at:close]
        sealed = "DEK-Info:" in body  # an encrypted body has no structure of its own
        lines = [x.strip() for x in body.splitlines()]
        data = "".join(x for x in lines if ":" not in x)
        try:
            raw = base64.b64decode(data, validate=True)
        except ValueError:
            continue
        if len(raw) >= 28 if sealed else _whole_key(raw):
            at = close + len(stop)
            yield begin.start(), at


def key64_spans(text: str) -> Iterator[tuple[int, int]]:
    for run in RUN64.finditer(text):
        body, at = run[0].rstrip("="), 0
        while start := START64.search(body, at):
            lo = start.start()
            n = _found64(body, lo, der_key)
            at = lo + n if n else lo + 1
            if n:
                yield run.start() + lo, min(run.start() + at + (-n % 4), run.end())
        lo = body.find(SSH64[:20])
        if lo >= 0 and (n := _found64(body, lo, ssh_key)):
            yield run.start() + lo, min(run.start() + lo + n + (-n % 4), run.end())


def _found64(body: str, lo: int, shape: Callable[[Reader, int], int | None]) -> int:
    size = shape(reader64(body, lo), (len(body) - lo) * 3 // 4)
    return -(-size * 4 // 3) if size else 0


def key16_spans(text: str) -> Iterator[tuple[int, int]]:
    for run in RUN16.finditer(text):
        body, at = run[0], 0
        while start := START16.search(body, at):
            lo = start.start()
            size = der_key(reader16(body, lo), (len(body) - lo) // 2)
            at = lo + 2 * size if size else lo + 1
            if size:
                yield run.start() + lo, run.start() + at


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """``(start, index of kind, end)`` of every span of a text, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    for kind, spans in ((4, pem_spans), (5, key64_spans), (6, key16_spans)):
        found += [(lo, kind, hi) for lo, hi in spans(text)]
    return sorted(found)


def _scan(name: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": lo, "end": hi} for lo, k, hi in find_secrets(t.as_py() or "")] for t in batch.column(name)]
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spans, _SPAN_ARROW)], names=[*kept, out])
    return run


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """The columns of ``docs`` and its spans: ``out`` array of (kind, start, end), by
    start, then kind in the order of ``KINDS``."""
    rows = docs.withColumn(text, F.col(text).cast("string"))
    fields = [f for f in rows.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T._parse_datatype_string(SPAN))])
    return rows.mapInArrow(_scan(text, out), schema)


def span_list(spans: str, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the spans (of some kinds only), comma-joined."""
    col = F.col(spans)
    if kinds is not None:
        col = F.filter(col, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
