"""Secret scans with structural confirmation.

Plain patterns give the base spans.  Beyond them, candidates of base64, hex or PEM text are decoded and reported only
if the bytes parse as a key: DER with nested lengths that fit, an OpenSSH key blob, or a signed token whose header
and payload are JSON.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import only, scan, texts

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A run that is too short is dropped whole by the base rule; a bounded repeat finds the same runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Line breaks of a body may be written as escapes, as in JSON, where slashes may be escaped too.  Lines of headers may come first.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:\s|\\+[nr])*((?:[A-Za-z][A-Za-z0-9-]{0,40}: [^\r\n\\]{0,200}(?:[\r\n]|\\+[nr])+)*)((?:[A-Za-z0-9+/=\s]|\\+[nr/])+)-----END \1-----")
ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED[\s\S]*DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,64}(?![0-9A-Fa-f])")
PEM_BREAKS = re.compile(r"\s+|\\+[nr]|\\+(?=/)")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
#: DER starts with 0x30 0x8x or 0x30 and a short length; both give "M" as the first letter in base64.
#: It may follow "=" or "-", so a run has further starts at its hyphens.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_])M[A-P][A-Za-z0-9+/_-]{40,}={0,2}")
BLOB_STARTS = re.compile(r"(?<=-)M[A-P]")
#: A key may be broken into lines without a frame around it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_])M[A-P][A-Za-z0-9+/]{30,}(?:\r?\n[ \t]*[A-Za-z0-9+/]+)+={0,2}")
WRAPPED_STARTS = re.compile(r"(?:^|(?<=\n)[ \t]*)(?=M[A-P])")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{80,}(?![0-9A-Fa-f])")
SSH = re.compile(r"(?<![A-Za-z0-9+/])(?:AAAA[A-Za-z0-9+/]{40,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{40,})={0,2}")
#: Name prefixes of public key blobs and the magic of private ones.
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
SSH_MAGIC = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three plain kinds, in code points."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded bytes have the structure of a key or signed token."""
    out: list[tuple[int, int, str]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = decode64(PEM_BREAKS.sub("", m[3]))
            if is_key(body) or (ENCRYPTED.match(m[2]) and body and len(body) % 8 == 0):
                out.append((m.start(), m.end(), "pem_key"))
    for kind, pattern, holds in (("signed_token", TOKEN, is_signed_token), ("der_key", HEX_DER, lambda s: len(s) % 2 == 0 and is_der_key(bytes.fromhex(s))), ("ssh_key", SSH, lambda s: is_ssh(decode64(s)))):
        for m in pattern.finditer(text):
            if not any(a <= m.start() < b for a, b, k in out if k == "pem_key") and holds(m[0]):
                out.append((m.start(), m.end(), kind))
    for m in BLOB.finditer(text):
        if not any(a <= m.start() < b for a, b, k in out if k == "pem_key") and (a := der_start(m[0])) is not None:
            out.append((m.start() + a, m.end(), "der_key"))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        for a, b in wrapped_keys(m[0]):
            if not any(s <= m.start() + a < e for s, e, k in out if k == "pem_key"):
                out.append((m.start() + a, m.start() + b, "der_key"))
    return out


def wrapped_keys(run: str) -> list[tuple[int, int]]:
    """Starts and ends of keys that begin a line of base64 text and go on for more than one; their header tells where they end."""
    out: list[tuple[int, int]] = []
    places = [i for i, c in enumerate(run) if c > " "]
    body = "".join(run[i] for i in places)
    for m in WRAPPED_STARTS.finditer(run):
        a = bisect_left(places, m.end())
        if out and m.end() < out[-1][1]:
            continue
        n = der_chars(body[a : a + 8])
        if n is None or a + n > len(body) or "\n" not in run[places[a] : places[a + n - 1]]:
            continue
        last = a + n
        while last < len(body) and body[last] == "=" and last < a + n + 2:
            last += 1
        # another line of base64 may follow, but the key's last line ends with it
        if last < len(body) and places[last] == places[last - 1] + 1:
            continue
        if is_der_key(decode64(body[a : a + n])):
            out.append((places[a], places[last - 1] + 1))
    return out


def der_chars(head: str) -> int | None:
    """Base64 characters, padding left out, of the DER value that begins with ``head``; None if none does."""
    data = decode64(head)
    if len(data) < 6:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    if width > 4:
        return None
    return -(-(2 + width + (int.from_bytes(data[2 : 2 + width]) if width else data[1])) * 4 // 3)


def spans(text: str) -> list[tuple[int, int, str]]:
    """Base and confirmed spans by start, then kind, then end."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def decode64(s: str) -> bytes:
    """Bytes of standard or URL-safe base64, padded or not; empty if it can't be decoded."""
    s = s.rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_start(run: str) -> int | None:
    """Where a base64 key begins that ends with the run: at its start or after a hyphen."""
    n = len(run.rstrip("="))
    for a in (0, *(m.start() for m in BLOB_STARTS.finditer(run))):
        # the length in the header tells most starts off before all is decoded
        head = decode64(run[a : a + 8])
        if len(head) < 6:
            continue
        width = head[1] & 0x7F if head[1] & 0x80 else 0
        size = 2 + width + (int.from_bytes(head[2 : 2 + width]) if width else head[1])
        if width <= 4 and size == (n - a) * 3 // 4 and is_der_key(decode64(run[a:])):
            return a
    return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of values that lie one after another; None unless every length fits exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n, at = int.from_bytes(data[at : at + width]), at + width
            if n < 0x80:  # lengths take as few bytes as they can
                return None
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, DSA, SEC1, PKCS#8 (plain or encrypted) or SubjectPublicKeyInfo, by tags and nested lengths."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (items := der_items(top[0][1])):
        return False
    tags = [t for t, _ in items]
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, key octets
        return has_oid(items[1][1])
    if tags == [0x02] * 6:  # DSA: version, p, q, g and the two keys
        return len(items[1][1]) >= 64 and 20 <= len(items[2][1]) <= 33
    if tags[:2] == [0x02, 0x04] and len(items[0][1]) == 1:  # SEC1: version 1, private value
        return items[0][1] == b"\x01" and 20 <= len(items[1][1]) <= 66
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight integers
        return len(items[1][1]) >= 32
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return has_oid(items[0][1])
    return tags == [0x30, 0x03] and has_oid(items[0][1]) and items[1][1][:1] == b"\0"  # SubjectPublicKeyInfo


def has_oid(data: bytes) -> bool:
    items = der_items(data)
    return bool(items) and items[0][0] == 0x06 and 3 <= len(items[0][1]) <= 16


def is_ssh(data: bytes) -> bool:
    """A public blob of length-prefixed fields that end exactly, or a private key file with its magic and cipher names."""
    private = data.startswith(SSH_MAGIC)
    at, fields = len(SSH_MAGIC) if private else 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            break
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if private and len(fields) == 3:
            return all(f.isascii() for f in fields[:2]) and len(data) > at + 8
    return not private and at == len(data) and len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_ssh(data)


def is_signed_token(s: str) -> bool:
    """Header and payload are JSON objects and the header names an algorithm."""
    head, body, _ = s.split(".", 2)
    try:
        header, claims = json.loads(decode64(head)), json.loads(decode64(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str)


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), emit: tuple[str, Callable] | None = None) -> DataFrame:
    """Columns ``keep`` and ``found``, an array of (start, end, kind) by start; or what ``emit`` makes of that list.

    Offsets are code points, ends exclusive.  Every row is scanned for itself over its whole text; null and empty
    texts have no spans, repeated rows stay repeated, and other columns are left out.
    """
    ddl, make = emit or ("found array<struct<start:long,end:long,kind:string>>", lambda found: ([{"start": a, "end": b, "kind": k} for a, b, k in found],))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])

    def rows(batch: pa.RecordBatch) -> list:
        made = [make(spans(t)) for t in texts(batch, text)]
        return [*(batch.column(c) for c in keep), *map(list, zip(*made, strict=True))]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema)


def digest(found: list[tuple[int, int, str]]) -> tuple:
    """Counts of the base kinds, the digest of the base spans, and all spans as a string."""
    base = [s for s in found if s[2] in BASE_KINDS]
    return (*(sum(s[2] == k for s in base) for k in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(found))


DIGEST_DDL = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one.

    All rows and columns stay; null and empty texts stay as they are, repeated rows are masked alike.
    """
    names = docs.columns
    schema = docs.schema

    def rows(batch: pa.RecordBatch) -> list:
        out = []
        for t in batch.column(text).to_pylist():
            at, parts = 0, []
            for a, b, _ in spans(t) if t else ():
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append(t if not parts else "".join([*parts, t[at:]]))
        return [pa.array(out, pa.string()) if c == text else batch.column(c) for c in names]

    return scan(docs, rows, schema)
