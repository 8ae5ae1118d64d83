"""Secrets in texts: plain patterns, then candidates confirmed by their structure.

Base kinds are textual. The structural kinds are reported only after decoding: base64 and
hex candidates (base64 on one line or wrapped) must parse as a DER key (tags and nested lengths that fill their parents),
an OpenSSH key (its magic, counts and length-prefixed strings that end with the buffer) or
a signed token (a JSON header that names an algorithm, a JSON body, a signature of the
length the algorithm asks for).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.wordhash import ROWS, lean, release

# The textual kinds, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 characters or more: runs do not overlap
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "openssh", "hexkey"]

_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60})-----((?:[A-Za-z0-9+/=\s]|\\+[nrt])*)-----END \1-----")  # line ends may be written as \n
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
# Where a key may begin: not inside a word, but after any of "+/_-=", and after a line end written as \n.
_B64_START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
_B64_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_B64_BREAK = re.compile(r"[ \t]*(?:\r\n|\n|\r|\\+r\\+n|\\+[nr])[ \t]*(?=[A-Za-z0-9+/_-])")
_B64_END = re.compile(r"(?:[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*(?==))?={1,2}|(?![A-Za-z0-9+/])")
#: Bytes of the shortest key that is looked for in base64.
_SHORTEST = 30
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{2}|6[Ff]70656e7373682d6b65792d7631)(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
# Signature bytes that each algorithm asks for (None: any length over 0).
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
_SSH_MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Strict decoding of either base64 alphabet, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Decoded:
    """The bytes that base64 text stands for from one of its characters on, decoded only where they are looked at."""

    def __init__(self, text: str, at: int, size: int | None = None) -> None:
        self.text, self.at = text, at
        self.size = (len(text) - at) * 3 // 4 if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self.size)
        first = lo // 3
        piece = self.text[self.at + 4 * first : self.at + 4 * -(-hi // 3)] if hi > lo else ""
        piece = piece[: len(piece) - (len(piece) % 4 == 1)]
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[lo - 3 * first : hi - 3 * first]


#: Elements of one parent that are looked at: no key has more.
_ITEMS = 16


def der_items(data: bytes | Decoded, lo: int = 0, hi: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the contents of the elements that fill ``data`` from lo to hi; None if a length does not fit or is not minimal, or they are over _ITEMS. Only headers are read."""
    out, i, hi = [], lo, len(data) if hi is None else hi
    while i < hi:
        head = data[i : min(i + 6, hi)]
        if len(head) < 2 or len(out) == _ITEMS:
            return None
        tag, size, i = head[0], head[1], i + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or len(head) < 2 + n:
                return None
            size = int.from_bytes(head[2 : 2 + n], "big")
            if size < 0x80 or head[2] == 0:
                return None
            i += n
        if i + size > hi:
            return None
        out.append((tag, i, i + size))
        i += size
    return out


def der_size(data: bytes) -> int | None:
    """Bytes of the element that begins ``data``, by its header."""
    if len(data) < 2 or data[1] < 0x80:
        return 2 + data[1] if len(data) > 1 else None
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 and len(data) >= 2 + n else None


_Items = list[tuple[int, int, int]]


def _short(data: bytes | Decoded, item: tuple[int, int, int]) -> bytes:
    """A content of a few bytes; of longer ones the beginning, which equals no short one."""
    return data[item[1] : min(item[2], item[1] + 32)]


def _length(item: tuple[int, int, int]) -> int:
    return item[2] - item[1]


def is_pkcs1(data: bytes | Decoded, parts: _Items) -> bool:
    """Version, then modulus, exponents, primes and their kin; a multi-prime key has one more element."""
    tags = [x[0] for x in parts]
    whole = tags[:9] == [0x02] * 9 and tags[9:] in ([], [0x02], [0x30])
    return whole and _short(data, parts[0]) in (b"\0", b"\1") and _length(parts[1]) >= 32


def is_sec1(data: bytes | Decoded, parts: _Items) -> bool:
    """Version 1, the number, then at most the curve and the public key."""
    tags = [x[0] for x in parts]
    return tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1} and _short(data, parts[0]) == b"\1" and _length(parts[1]) in (28, 32, 48, 66)


# Object identifiers of key algorithms, by the form of the private key.
_RSA = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
_EC = bytes.fromhex("2a8648ce3d0201")
_DSA_DH = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))
_CURVES = {b"\x2b\x65\x6e": 32, b"\x2b\x65\x6f": 56, b"\x2b\x65\x70": 32, b"\x2b\x65\x71": 57}


def is_private_part(data: bytes | Decoded, algorithm: bytes, part: tuple[int, int, int]) -> bool:
    """Whether the octets of a PKCS#8 key are what its algorithm asks for; of an unknown one, one whole element."""
    items = der_items(data, part[1], part[2])
    if not items or len(items) != 1:
        return False
    body = items[0]
    if algorithm in _RSA or algorithm == _EC:
        parts = der_items(data, body[1], body[2]) if body[0] == 0x30 else None
        return bool(parts) and (is_sec1 if algorithm == _EC else is_pkcs1)(data, parts)
    if algorithm in _CURVES:
        return body[0] == 0x04 and _length(body) == _CURVES[algorithm]
    if algorithm in _DSA_DH:
        return body[0] == 0x02 and _length(body) >= 16
    return _length(body) >= 16


def is_der_key(data: bytes | Decoded) -> bool:
    """A PKCS#1, SEC1, PKCS#8 (plain or encrypted) or SubjectPublicKeyInfo structure, whole."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, top[0][1], top[0][2])
    if not parts or len(parts) < 2:
        return False
    tags = [x[0] for x in parts]
    if tags[0] == 0x02:
        if tags == [0x02] * len(tags):
            return is_pkcs1(data, parts)
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and _short(data, parts[0]) in (b"\0", b"\1"):
            inner = der_items(data, parts[1][1], parts[1][2])  # PKCS#8: algorithm, then the key
            return bool(inner) and inner[0][0] == 0x06 and is_private_part(data, _short(data, inner[0]), parts[2])
        return is_sec1(data, parts)
    if tags[0] == 0x30 and len(tags) == 2:
        inner = der_items(data, parts[0][1], parts[0][2])
        if not inner or inner[0][0] != 0x06:
            return False
        if tags[1] == 0x03:  # SubjectPublicKeyInfo: no unused bits
            return _length(parts[1]) >= 33 and data[parts[1][1] : parts[1][1] + 1] == b"\0"
        return tags[1] == 0x04 and len(inner) == 2 and _length(parts[1]) >= 16  # encrypted PKCS#8
    return False


def _ssh_strings(data: bytes | Decoded, at: int, n: int) -> list[tuple[int, int]] | None:
    """(start, end) of n length-prefixed strings from ``at`` on."""
    out = []
    for _ in range(n):
        head = data[at : at + 4]
        end = at + 4 + int.from_bytes(head, "big")
        if len(head) < 4 or end > len(data):
            return None
        out.append((at + 4, end))
        at = end
    return out


def _openssh_parts(data: bytes | Decoded) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
    """Number of keys, the public and the private part of an openssh-key-v1 private key that begins ``data``."""
    head = _ssh_strings(data, len(_SSH_MAGIC), 3)
    if not head or len(data) < head[2][1] + 4:
        return None
    keys = _ssh_strings(data, head[2][1] + 4, 2)
    return (int.from_bytes(data[head[2][1] : head[2][1] + 4], "big"), *keys) if keys else None


def is_openssh_key(data: bytes | Decoded) -> bool:
    """An openssh-key-v1 private key, whole: cipher, kdf, options, one public and one private part."""
    parts = _openssh_parts(data) if data[: len(_SSH_MAGIC)] == _SSH_MAGIC else None
    if not parts or parts[0] != 1 or parts[2][1] != len(data):
        return False
    size = parts[2][1] - parts[2][0]
    return is_ssh_public(data, *parts[1]) and size >= 32 and size % 8 == 0


def openssh_size(data: bytes | Decoded) -> int | None:
    """Bytes of the openssh-key-v1 private key that begins ``data``, by its lengths."""
    parts = _openssh_parts(data)
    return parts[2][1] if parts else None


def is_ssh_public(data: bytes | Decoded, lo: int = 0, hi: int | None = None) -> bool:
    """A public key blob: its type, then length-prefixed fields to the end, _ITEMS at most."""
    hi = len(data) if hi is None else hi
    first = _ssh_strings(data, lo, 1)
    if not first or first[0][1] > hi or first[0][1] - first[0][0] > 66 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", data[first[0][0] : first[0][1]]):
        return False
    at, n = first[0][1], 0
    while at < hi:
        field = _ssh_strings(data, at, 1)
        if not field or field[0][1] > hi or n == _ITEMS:
            return False
        at, n = field[0][1], n + 1
    return n >= 1


def is_signed_token(header: str, body: str, signature: str) -> bool:
    """A JWS in compact form whose parts decode to what its header promises."""
    try:
        head, claims = (json.loads(unbase64(x) or b"") for x in (header, body))
    except (ValueError, RecursionError):
        return False
    sig = unbase64(signature)
    if not isinstance(head, dict) or not isinstance(claims, dict) or sig is None:
        return False
    alg = head.get("alg")
    if not isinstance(alg, str) or alg not in _SIGNATURES:
        return False
    need = _SIGNATURES[alg]
    return len(sig) == need if need else len(sig) >= 128


class _Region:
    """Base64 characters from ``at`` on that follow each other across line ends, joined once for all keys that may begin in them."""

    def __init__(self, text: str, at: int) -> None:
        runs, self.starts, self.joins, n = [], [], [], 0
        while run := _B64_RUN.match(text, at):
            runs.append(run[0])
            self.starts.append(at)
            self.joins.append(n)
            n += len(run[0])
            self.end = run.end()
            gap = _B64_BREAK.match(text, self.end)
            if not gap:
                break
            at = gap.end()
        self.joined = "".join(runs).replace("-", "+").replace("_", "/")

    def index(self, at: int) -> int:
        """Place among the joined characters of the one at ``at`` in the text."""
        k = bisect_right(self.starts, at) - 1
        return self.joins[k] + at - self.starts[k]

    def after(self, n: int) -> int:
        """Where in the text the first n joined characters end."""
        k = bisect_left(self.joins, n) - 1
        return self.starts[k] + n - self.joins[k]


def base64_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64, on one line or wrapped. A key's own lengths say where it ends; what follows must not go on with base64.

    Only headers and lengths are decoded, so a text full of beginnings of keys takes time in
    proportion to its length.
    """
    done, region = 0, None
    for m in _B64_START.finditer(text):
        at = m.start()
        if at < done:
            continue
        if region is None or at >= region.end:
            region = _Region(text, at)
        ssh, i = text[at] == "b", region.index(at)
        data = Decoded(region.joined, i)
        size = openssh_size(data) if ssh else der_size(data[:9])
        if not size or not _SHORTEST <= size <= len(data):
            continue
        end = region.after(i + -(-size * 4 // 3))
        after = _B64_END.match(text, end)
        if after and (is_openssh_key if ssh else is_der_key)(Decoded(region.joined, i, size)):
            done = after.end()
            yield at, done, "openssh" if ssh else "der"


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start and then by kind as KINDS lists them."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(*m.groups())]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = unbase64(re.sub(r"\s|\\+[nrt]", "", m[2]))
            if data and (is_der_key(data) or is_openssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
                taken.append(m.span())
    starts = [a for a, _ in taken]
    found += [x for x in base64_keys(text) if not ((k := bisect_right(starts, x[0])) and x[0] < taken[k - 1][1])]
    for m in _HEXKEY.finditer(text):
        data = bytes.fromhex(m[0])
        if is_der_key(data) or is_openssh_key(data):
            found.append((m.start(), m.end(), "hexkey"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with each maximal stretch of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [scan(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        arrays.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in spans], kind))
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every secret of every whole text, array<struct<start, end, kind>> in code points.

    Only ``doc_id`` and ``text`` are read. One row for each input row; null and empty texts
    have no spans; a null id stays null; repeated rows are each scanned. Matches of one kind
    do not overlap; those of different kinds may.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lean(_scan_batches), "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with ``mark`` in place of every secret in ``text``; null stays null. Only the text leaves the JVM."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            clean = [None if x is None else redact(x, found, mark) if (found := scan(x)) else x for i in range(0, len(column), ROWS) for x in column.slice(i, ROWS).to_pylist()]
            yield pa.array(clean, pa.string())
            release()

    return docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text").cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the base kinds, and all spans as text."""
    as_text = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
