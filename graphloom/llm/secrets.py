"""Secrets: patterns, and structural confirmation of encoded candidates.

What looks like base64, hex or a signed token is decoded and parsed before it is reported: key
encodings by their nested lengths, which must fill the candidate exactly, key files by their magic
and length-prefixed fields, signed tokens by the JSON of their header. A candidate that does not
parse is not reported, nor are public keys; base spans always stay.

Defined cases: null or empty texts hold nothing; a pattern's failing match is dropped; very long
runs of one character take linear time; repeated rows give repeated results; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import workers
from graphloom.llm.spans import Span, apart, digests

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "pem", "der", "ssh"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,8}?PRIVATE KEY-----")
#: What may stand between the lines of an armoured key: header lines, then base64.
HEADERS = re.compile(r"(?:\s|\\[rn])*+(?:[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+(?:\s|\\[rn])++)*+")
BODY = re.compile(r"(?:[A-Za-z0-9+/=]|\s|\\[rn])++")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{38,}+={0,2}+")
#: The same over several lines, without armour; hex with large letters, with a prefix or without.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}+")
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*+")
LARGE_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?+(?=[0-9a-f]*+[A-F])([0-9A-Fa-f]{32,}+)(?![0-9A-Za-z])")
#: A sequence whose length has one, two or three bytes of its own, or none; the magic of key files.
STARTS = (b"\x30", b"openssh-key-v1\0")


def patterns(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def decoded(text: str, urlsafe: bool = False) -> bytes | None:
    try:
        raw = text.encode().translate(bytes.maketrans(b"-_", b"+/")) if urlsafe else text.encode()
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the element at a place, if it stays within end."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + size], "big")
        if n < 0x80:
            return None
        at += size
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly."""
    out = []
    while at < end:
        e = _element(data, at, end)
        if not e:
            return None
        out.append(e)
        at = e[2]
    return out


#: Fixed value: the encoded name space of public-key algorithms and of password-based encryption begins so.
ALGORITHM = b"\x2a\x86\x48\x86\xf7\x0d\x01", b"\x2a\x86\x48\xce\x3d", b"\x2a\x86\x48\xce\x38", b"\x2b\x65", b"\x2b\x81\x04", b"\x2b\x24"


def is_key_encoding(data: bytes) -> bool:
    """Whether a sequence fills the data exactly and nested elements fill it in turn, as in private keys.

    Either a version with the numbers of a key, a version with an algorithm and a key in it, or an
    algorithm with an encrypted key. An algorithm with a bit string is a public key and does not count.
    """
    top = _element(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts:
        return False
    for tag, at, end in parts:
        if tag in (0x30, 0xA0, 0xA1) and _elements(data, at, end) is None:
            return False
    tags = [t for t, _, _ in parts]

    def algorithm(e: tuple[int, int, int]) -> bool:
        first = _element(data, e[1], e[2])
        return e[0] == 0x30 and bool(first) and first[0] == 6 and data[first[1] : first[2]].startswith(ALGORITHM)

    if tags[0] == 2:
        version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
        if version > 1 or parts[0][2] - parts[0][1] != 1:
            return False
        if len(parts) >= 3 and algorithm(parts[1]):
            return tags[2] == 4
        # Numbers of a key, more than the two of a public key or a signature; or a scalar with its curve.
        return len(parts) >= 3 and set(tags) == {2} or tags[1:2] == [4] and len(parts) <= 4 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return len(parts) == 2 and algorithm(parts[0]) and tags[1] == 4


def _fields(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from a place on, count of them or all to the end, and where they end."""
    out = []
    while at < len(data) if count is None else len(out) < count:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return None
        out.append(data[at - n : at])
    return out, at


def ssh_end(data: bytes) -> int:
    """Where a private key file at the start of the data ends, 0 if there is none: cipher, key derivation, count, public keys, and the private part."""
    magic = STARTS[1]
    if not data.startswith(magic) or not (head := _fields(data, len(magic), 3)):
        return 0
    (cipher, derivation, _), at = head
    if not re.fullmatch(rb"[a-z0-9@.-]+", cipher) or derivation not in (b"none", b"bcrypt") or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= 16 or not (rest := _fields(data, at + 4, keys + 1)):
        return 0
    for public in rest[0][:-1]:
        inner = _fields(public, 0)
        if not inner or len(inner[0]) < 2 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", inner[0][0]):
            return 0
    return rest[1] if rest[0][-1] else 0


def is_ssh_key(data: bytes) -> bool:
    """Whether the data is a whole private key file."""
    return bool(data) and ssh_end(data) == len(data)


def wrapped_key(text: str, m: re.Match) -> Span | None:
    """The key that a run of base64 lines begins with, if there is one. Its own lengths say where it ends, which must be a line's end."""
    first = decoded(m[0][:16], urlsafe=True) or b""
    if not first.startswith((STARTS[0], STARTS[1][: len(first)])):
        return None
    lines, places, at = BREAK.split(m[0].rstrip("=")), [], m.start()
    for line, gap in zip(lines, [*BREAK.findall(m[0]), ""], strict=True):
        places += range(at, at + len(line))
        at += len(line) + len(gap)
    data = decoded("".join(lines)[: len(places) - (len(places) % 4 == 1)], urlsafe=True) or b""
    top = _element(data, 0, len(data))
    kind, end = ("der", top[2]) if top and top[0] == 0x30 else ("ssh", ssh_end(data))
    last = -(-end * 8 // 6)
    if not end or last > len(places) or not (is_key_encoding(data[:end]) if kind == "der" else True):
        return None
    stop = places[last - 1] + 1
    while text[stop : stop + 1] == "=":
        stop += 1
    return None if re.match(r"[A-Za-z0-9+/_-]", text[stop : stop + 1]) else (kind, m.start(), stop)


def is_signed_token(token: str) -> bool:
    head, _, rest = token.partition(".")
    body = rest.partition(".")[0]
    for part, must in ((head, "alg"), (body, None)):
        data = decoded(part, urlsafe=True)
        try:
            value = json.loads(data) if data is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (must and not isinstance(value.get(must), str)):
            return False
    return True


def confirmed(text: str, base: list[Span]) -> list[Span]:
    """Candidates that decode and parse."""
    out: list[Span] = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            # The armour as it is, and with what looks like header lines left out.
            body = BODY.match(text, HEADERS.match(text, m.end()).end())
            if body and text.startswith("-----END ", body.end()):
                data = decoded(re.sub(r"\s|\\[rn]", "", body[0]))
                locked = "ENCRYPTED" in text[m.end() : body.start()]
                if data and (is_key_encoding(data) or is_ssh_key(data) or locked and len(data) % 8 == 0):
                    out.append(("pem", m.start(), body.end()))
    for m in BLOB.finditer(text):
        # Standard and url-safe letters; four letters tell whether the whole may be a key.
        head = decoded(m[0][:20], urlsafe=True)
        if head and head.startswith((STARTS[0], STARTS[1])):
            data = decoded(m[0].rstrip("="), urlsafe=True)
            if data and is_ssh_key(data):
                out.append(("ssh", m.start(), m.end()))
            elif data and is_key_encoding(data):
                out.append(("der", m.start(), m.end()))
    out += [x for m in WRAPPED.finditer(text) if (x := wrapped_key(text, m))]
    for m in LARGE_HEX.finditer(text):
        if len(m[1]) % 2 == 0:
            data = bytes.fromhex(m[1])
            if data.startswith(STARTS) and (is_key_encoding(data) or is_ssh_key(data)):
                out.append(("der", m.start(1), m.end(1)))
    for kind, s, e in base:
        # Hex that parses as a key is said again by its kind.
        if kind == "hex" and (e - s) % 2 == 0:
            data = bytes.fromhex(text[s:e])
            if data.startswith(STARTS) and (is_key_encoding(data) or is_ssh_key(data)):
                out.append(("der", s, e))
    whole = [x for x in out if x[0] == "der" and text[x[1] : x[2]].isalnum() and ("hex", x[1], x[2]) in base]
    return apart([x for x in out if x not in whole], []) + whole


def find(text: str) -> tuple[list[Span], list[Span]]:
    base = patterns(text)
    return base, confirmed(text, base)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added)."""
    return digests(docs, lambda texts: map(find, texts), BASE, KINDS, id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns of docs; every span found, overlapping ones as one, gives way to the mark."""

    def without(text: str | None) -> str | None:
        spans = sorted((s, e) for found in find(text or "") for _, s, e in found)
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([without(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, workers.column(each, "string")(F.col(text_col)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["find", "find_secrets", "is_key_encoding", "is_signed_token", "is_ssh_key", "op10", "patterns", "redact"]
