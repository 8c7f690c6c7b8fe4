"""Secret scans with structural confirmation.

Patterns find candidates; a candidate of the added kinds is reported only when its structure holds:
    jwt   three base64url parts, the first two JSON objects, the first with an "alg"; also after "=" or
          "/" and before a full stop
    pem   a PEM block named as a key, whose body decodes to a DER sequence or an SSH key; with the headers
          of RFC 1421 for an encrypted body, whole cipher blocks under a DEK-Info with its IV
    der   base64 or hex that decodes to a DER sequence of integers, object ids and strings, nested
          lengths adding up exactly
    ssh   base64 of the wire format of an SSH key: length-prefixed fields, the first a key type, or of the
          openssh-key-v1 container, whose public keys have that format
The base kinds assign, access and hex follow their patterns alone. Offsets are code points, ends
exclusive. Spans of the added kinds may lie inside those of the base kinds; at one start the kinds follow the order
of KINDS. Null and empty texts have no secrets; very long texts are searched whole, one at a time; rows that share a
doc_id, or are the same, are searched each by itself and returned each; null doc_ids stay null; an empty table gives
no rows. Columns beside the key and the text are not read, whatever their names. The work grows with the length of a text
also where it is one long run of separators and beginnings of keys or tokens, as each of these is told by a few bytes; an SSH key
has FIELDS fields at most.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import text_of

#: The patterns of the base kinds, with the least length of the match or of its value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs of at least 32; the leftmost longest runs are those of HEX that are long enough.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: A line end may be written as an escape; headers are lines of name, colon and value, continued by a blank.
EOL = r"(?:\r?\n|(?:\\r)?\\n)"
PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----((?:[\x20\t]*{EOL}[\x20\t]*[A-Za-z0-9-]+:(?:(?!{EOL}|-----).)*+(?:{EOL}[\x20\t]+(?:(?!{EOL}|-----).)*+)*)*)((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END \1-----")
DEK = re.compile(r"^[\x20\t]*DEK-Info:[\x20\t]*([A-Z0-9-]+),[\x20\t]*([0-9A-Fa-f]+)[\x20\t]*$", re.M)
#: Free to the left by the lookbehind, to the right as the parts are possessive.
PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{40,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(s: str) -> dict | None:
    """The JSON object that a part of a token holds."""
    try:
        found = json.loads(unbase64(s) or b"")
    except (ValueError, RecursionError):  # nesting beyond any token's
        return None
    return found if isinstance(found, dict) else None


#: Base64 characters of a part by whose JSON most false beginnings are told, a multiple of four.
HEAD = 64


def may_be_json(s: str, at: int) -> bool:
    """Whether the part of a token from `at` on can be a JSON object, by its first characters and its last four bytes or so."""
    rest = (len(s) - at) % 4
    if rest == 1:
        return False
    if len(s) - at <= HEAD:
        return True
    head = unbase64(s[at : at + HEAD])
    if head is None:
        return False
    text = head.decode(json.detect_encoding(head), "ignore")
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        # a string that the cut ends is told by its beginning, all else by where it went wrong
        if not e.msg.startswith("Unterminated string") and e.pos < len(text) - 12:
            return False
    tail = (unbase64(s[len(s) - 8 - rest :]) or b"").strip(b" \t\r\n\0")
    return tail.endswith(b"}") or not tail


def der_end(data: bytes, at: int, depth: int = 0) -> int | None:
    """The end of the DER element at `at`, or None if its tags or nested lengths are not sound."""
    if depth > 12 or at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if size < 128:
            return None
    end = at + size
    if end > len(data):
        return None
    if tag in (0x30, 0x31) or 0xA0 <= tag <= 0xA3:
        while at < end:
            at = der_end(data, at, depth + 1)
            if at is None:
                return None
        return end if at == end else None
    if tag == 0x02:
        return end if size else None
    if tag == 0x05:
        return end if size == 0 else None
    if tag == 0x06:
        return end if size and not data[end - 1] & 0x80 else None
    return end if tag in (0x01, 0x03, 0x04, 0x0C, 0x13, 0x17) and size else None


def is_der(data: bytes | None) -> bool:
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    inner = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return inner < len(data) and data[inner] in (0x02, 0x30) and der_end(data, 0) == len(data)


MAGIC = b"openssh-key-v1\0"


def is_openssh(data: bytes) -> bool:
    """The container: names of cipher and derivation, its options, public keys and the private part."""
    at, fields, left = len(MAGIC), [], 3
    while left:
        if at + 4 > len(data):
            return False
        if len(fields) == 3 and left == 3:  # the number of keys stands between
            left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
            if left == 1 or left > len(data):
                return False
            continue
        size = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
        left -= len(fields) > 3
    return at == len(data) and bool(fields[0] and fields[1] and fields[-1]) and all(map(is_ssh, fields[3:-1]))


def is_ssh(data: bytes | None) -> bool:
    if not data or len(data) < 16:
        return False
    if data.startswith(MAGIC):
        return is_openssh(data)
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]


def is_pem(headers: str, body: str) -> bool:
    data = unbase64(re.sub(r"\s|\\[rn]", "", body))
    if is_der(data) or is_ssh(data):
        return True
    lines = re.sub(EOL, "\n", headers)
    info = DEK.search(lines)
    if not data or not info or not re.search(r"Proc-Type:\s*4\s*,\s*ENCRYPTED", lines):
        return False
    block = 16 if info[1].startswith("AES") else 8
    return len(info[2]) == 2 * block and len(data) % block == 0


def jwt_spans(s: str) -> Iterator[tuple[int, int]]:
    """Web tokens in a run, wherever three of its parts are one; what is before "-" or "_" may be a name."""
    for m in PARTS.finditer(s):
        parts = m[0].split(".")
        begin = [m.start()]
        for p in parts:
            begin.append(begin[-1] + len(p) + 1)
        k = 0
        while k + 2 < len(parts):
            at = _token_start(parts[k]) if parts[k + 2] and json_object(parts[k + 1]) is not None else None
            if at is None:
                k += 1
            else:
                yield begin[k] + at, begin[k + 3] - 1
                k += 3


def _token_start(part: str) -> int | None:
    """Where the header of a token begins in a part, at its start or after a separator."""
    for at in [0, *[x.end() for x in re.finditer(r"[-_]+", part)]]:
        # a JSON object begins with a brace, or with blanks before it
        if part[at : at + 1] in ("e", "I", "C", "D") and may_be_json(part, at):
            head = json_object(part[at:])
            if head is not None and isinstance(head.get("alg"), str):
                return at
    return None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the added kinds."""
    out = []
    if "-----BEGIN" in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if is_pem(m[2], m[3])]
    for m in RUN.finditer(text):
        s, begin = m[0], 0
        tokens = list(jwt_spans(s)) if s.count(".") >= 2 else []
        out += [("jwt", m.start() + a, m.start() + e) for a, e in tokens]
        for a, e in [*tokens, (len(s), len(s))]:
            out += _key_spans(s[begin:a], m.start() + begin)
            begin = e
    return out


#: Base64 of the first bytes of a DER sequence and of an SSH key or container, and of hex of the former.
STARTS = re.compile(r"M[A-Za-z]|AAAA|b3Bl|30[0-9a-fA-F]{2}")


#: Fields of a key at most, of which its head is walked through.
FIELDS = 64


def _declares(s: str, at: int, size: int) -> bool:
    """Whether the head of a key at `at` allows it to end with s, which is size characters without padding.

    A look at a few bytes, before all of it is decoded: the length of a DER sequence, or those of the fields of an SSH key or container.
    """
    have = (size - at) * 3 // 4
    if s.startswith(("AAAA", "b3Bl"), at):
        return _fields_end(s, at, have)
    hexed = s[at] in "0123456789abcdefABCDEF" and re.compile(r"[0-9a-fA-F]+").fullmatch(s, at)
    head = bytes.fromhex(s[at : at + 12]) if hexed else unbase64(s[at : at + 8])
    have = (len(s) - at) // 2 if hexed else have
    if not head or head[0] != 0x30:
        return False
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return k <= 4 and (int.from_bytes(head[2 : 2 + k], "big") + 2 + k if k else head[1] + 2) == have


def _fields_end(s: str, begin: int, have: int) -> bool:
    """Whether fields with their lengths before them come to the end of the `have` bytes that base64 from `begin` on holds."""

    def number(at: int) -> int:
        # three bytes are four characters, so the four bytes are in eight at most
        group = at // 3 * 4
        data = unbase64(s[begin + group : begin + group + 8])
        return int.from_bytes(data[at % 3 : at % 3 + 4], "big") if data else -1

    at, left = 0, FIELDS
    if s.startswith("b3Bl", begin):
        data = unbase64(s[begin : begin + 20])
        if data != MAGIC:
            return False
        at = len(MAGIC)
        for _ in range(3):
            if at + 4 > have:
                return False
            at += 4 + number(at)
        left = number(at) + 1 if at + 4 <= have else 0
        if not 1 < left <= FIELDS:
            return False
        at += 4
    while left and at + 4 <= have:
        length = number(at)
        if length < 0 or at == 0 and not 4 <= length <= 64:
            return False
        at, left = at + 4 + length, left - 1
    return at == have


def _key_spans(s: str, at: int) -> list[tuple[str, int, int]]:
    """DER and SSH keys in a run without web tokens that begins at `at`; what is before a separator may be a name."""
    out = []
    lead = len(s) - len(s.lstrip(".=-_/+"))
    at += lead
    for part in re.split(r"([.]|(?<==)(?=[^=]))", s[lead:]):
        if part and len(part) >= 32:
            size = len(part.rstrip("="))
            for cut in [0, *[m.end() for m in re.finditer(r"[-_/+]+", part)]]:
                if len(part) - cut < 32:
                    break
                if cut and not (STARTS.match(part, cut) and _declares(part, cut, size)):
                    continue
                own = part[cut:]
                raw = bytes.fromhex(own) if len(own) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", own) else unbase64(own)
                kind = "der" if is_der(raw) else "ssh" if is_ssh(raw) else None
                if kind:
                    out.append((kind, at + cut, at + len(part)))
                    break
        at += len(part or "")
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each secret: key, kind, start, end, found (its text)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, a, e, t[a:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, a, e in base_spans(t) + confirmed_spans(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[key, "kind", "start", "end", "found"])

    return docs.select(F.col(key).cast("long").alias(key), text_of(text).alias(text)).mapInArrow(find, f"{key} long, kind string, start long, end long, found string")


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by base kind, base_sha256, spans and n_confirmed."""

    def one(i, t):
        base, more = base_spans(t), confirmed_spans(t)
        count = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
        return i, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(one, b.column(0).to_pylist(), b.column(1).to_pylist()))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(find, schema)
