"""Secret scan with structural confirmation.

Base spans come from three patterns. The method adds spans of three more kinds,
each reported only after its structure has been parsed:

* ``jwt``: three consecutive parts of a dotted base64url run whose first decodes
  to a JSON object with a string ``alg`` and whose second to a JSON object;
* ``der``: a base64, base64url or hex run that decodes to ASN.1 DER whose outer
  SEQUENCE fills the bytes, whose nested lengths add up and which starts as a
  private key does (a version number, then an algorithm or a large integer);
* ``openssh``: a base64 run that decodes to ``openssh-key-v1`` and whose nested
  length-prefixed strings stay inside it.

A key is sought wherever the digits of its first bytes stand, also behind other
letters. It may go on over line breaks, written out as ``\\n`` too, and indentation. It is
cut at the length that the outer DER header or the OpenSSH fields give, so words
on the next line do not belong to it.

Edge cases: a null or empty text has no span. Repeated rows each give a row.
Columns other than doc_id and text are ignored. Whole texts are scanned; the
patterns are linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lagpair.llm.common import small_batches, text_rows

# The base kinds, in the order in which ties are listed, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
_JWT_LEAST = (8, 2, 8)
# The digits of a key's first bytes. DER: a SEQUENCE (0x30) of a length in one, two or three bytes, then the
# INTEGER 0 to 2 of one byte (02 01 0x); in base64 three bytes are four digits. OpenSSH: its magic word.
_B64 = "[A-Za-z0-9+/_-]"
_SHORT_DER = rf"M[A-H][AEIMQUYcgkosw048]CAQ[AEI]"
_BYTE_DER = rf"MI[GH]{_B64}AgE[ABC]"
_WORD_DER = rf"MI[IJKL]{_B64}{{2}}[AQgw]IBA"
_HEX_DER = r"30(?:[0-7][0-9a-fA-F]|81[0-9a-fA-F]{2}|82[0-9a-fA-F]{4})02010[0-2]"
_START = re.compile(rf"{_SHORT_DER}|{_BYTE_DER}|{_WORD_DER}|b3BlbnNzaC1rZXktdjE|{_HEX_DER}")
_ANY_B64, _PLAIN_B64, _HEX_DIGITS = re.compile(rf"{_B64}+"), re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[0-9a-fA-F]+")
_BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
_WORD = re.compile(r"(?:password|passwd|secret|token|api_?key)", re.IGNORECASE | re.ASCII)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns; a match that is too short is dropped after it was consumed."""
    out = []
    if _WORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _b64(part: str) -> bytes | None:
    """Bytes of base64 or base64url without regard to padding; None if it is neither."""
    part = re.sub(r"[\r\n]", "", part).rstrip("=").replace("-", "+").replace("_", "/")
    if len(part) % 4 == 1:
        return None
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(raw: bytes | None) -> dict | None:
    try:
        value = json.loads(raw.decode("utf-8")) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_jwt(head: str, claims: str) -> bool:
    header = _json_object(_b64(head))
    return header is not None and isinstance(header.get("alg"), str) and _json_object(_b64(claims)) is not None


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER values that fill ``raw``; None if their lengths do not add up."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(raw):
                return None
            size, at = int.from_bytes(raw[at : at + width], "big"), at + width
            if size < 0x80:
                return None
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def is_der_key(raw: bytes | None) -> bool:
    """PKCS#1, PKCS#8 or SEC 1 private key: a SEQUENCE of a small version and then an INTEGER, SEQUENCE or OCTET STRING of key size."""
    if raw is None or len(raw) < 24 or raw[0] != 0x30:
        return False
    outer = der_items(raw)
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 2:
        return False
    tags = [tag for tag, _ in inner]
    if tags[1] == 0x02:
        return len(inner) >= 9 and all(tag == 0x02 for tag in tags[:9])
    if tags[1] == 0x30:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner) >= 3 and tags[2] == 0x04
    return tags[1] == 0x04 and len(inner[1][1]) >= 16


def is_openssh_key(raw: bytes | None) -> bool:
    magic = b"openssh-key-v1\0"
    if raw is None or not raw.startswith(magic):
        return False
    at, strings = len(magic), 0
    while at + 4 <= len(raw) and strings < 3:
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4 + size
        if at > len(raw):
            return False
        strings += 1
    return strings == 3


def der_size(raw: bytes | None) -> int | None:
    """Bytes of the outer SEQUENCE with its header, if it begins as a private key does: with a small version."""
    if raw is None or len(raw) < 12 or raw[0] != 0x30:
        return None
    width = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if raw[1] == 0x80 or width > 4 or raw[2 + width : 4 + width] != b"\x02\x01" or raw[4 + width] > 2:
        return None
    return 2 + width + (int.from_bytes(raw[2 : 2 + width], "big") if width else raw[1])


def openssh_size(raw: bytes) -> int | None:
    """Bytes that the fields of an OpenSSH key take: three strings, the number of keys, their public parts, the private part."""
    at = len(b"openssh-key-v1\0")
    for _ in range(3):
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):
        if at + 4 > len(raw):
            return None
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at if at <= len(raw) else None


def taken(text: str, at: int, need: int | None, digits: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """``need`` digits (or all) of the run at ``at``, over line breaks and indentation, and where each line's digits begin and end."""
    parts, places, have = [], [], 0
    while m := digits.match(text, at, len(text) if need is None else at + need - have):
        parts.append(m[0])
        places.append(m.span())
        have += len(m[0])
        if have == need or not (gap := _BREAK.match(text, m.end())):
            break
        at = gap.end()
    return "".join(parts), places


def _padded(text: str, end: int, digits: int) -> int:
    """The end of base64 digits with the padding behind them."""
    most = -digits % 4
    while most and end < len(text) and text[end] == "=":
        end, most = end + 1, most - 1
    return end


def key_span(text: str, start: int) -> tuple[int, str] | None:
    """End and kind of the private key whose base64 or hex begins at ``start``."""
    if text[start] == "M":
        size = der_size(_b64(_ANY_B64.match(text, start, start + 20)[0]))
        if size is None:
            return None
        need = -(-size * 4 // 3)
        digits, places = taken(text, start, need, _ANY_B64)
        raw = _b64(digits) if len(digits) == need else None
        return (_padded(text, places[-1][1], need), "der") if is_der_key(raw) else None
    if text[start] == "3":
        head = _HEX_DIGITS.match(text, start, start + 24)[0]
        size = der_size(bytes.fromhex(head)) if len(head) == 24 else None
        if size is None:
            return None
        digits, places = taken(text, start, 2 * size, _HEX_DIGITS)
        return (places[-1][1], "der") if len(digits) == 2 * size and is_der_key(bytes.fromhex(digits)) else None
    digits, places = taken(text, start, None, _PLAIN_B64)
    raw = _b64(digits[: len(digits) - (len(digits) % 4 == 1)])
    if not is_openssh_key(raw):
        return None
    size = openssh_size(raw)
    if size is None:  # the first fields alone are whole: all of the run
        return _padded(text, places[-1][1], len(digits)), "openssh"
    need = -(-size * 4 // 3)
    for a, b in places:
        if need <= b - a:
            return _padded(text, a + need, -(-size * 4 // 3)), "openssh"
        need -= b - a
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded structure was parsed."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for three in zip(parts, parts[1:], parts[2:]):
            if all(len(part) >= least for part, least in zip(three, _JWT_LEAST)) and is_jwt(three[0], three[1]):
                out.append((at, at + sum(map(len, three)) + 2, "jwt"))
            at += len(three[0]) + 1
    at = 0
    while m := _START.search(text, at):
        span = key_span(text, m.start())
        at = span[0] if span else m.start() + 1
        if span:
            out.append((m.start(), *span))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, the digest of the base spans, all spans."""
    if not text:
        return 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""
    base = base_spans(text)
    kinds = [kind for _, _, kind in base]
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t.as_py()) for t in batch.column("text")]
        cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)] + [pa.array([f[k] for f in found], pa.string()) for k in (3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts of base kinds, digest of base spans, and all spans as ``kind:start:end`` in code points."""
    small_batches(docs.sparkSession)
    return text_rows(docs, "doc_id", "text").mapInArrow(_scanned, SCHEMA)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        old = batch.column(at).to_pylist()
        texts = [redact(t) if t else t for t in old]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        n = batch.schema.get_field_index("n_chars")
        if n >= 0 and pa.types.is_integer(batch.schema.field(n).type):
            sizes = [len(t) if t != o else size for t, o, size in zip(texts, old, batch.column(n).to_pylist())]
            batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
        yield batch


def redact(text: str) -> str:
    """Each span, or run of overlapping spans, replaced by ``[secret]``."""
    parts, at = [], 0
    for start, end, _ in sorted(base_spans(text) + confirmed_spans(text)):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], "[secret]"]
        at = end
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in its texts replaced; rows and columns stay. ``n_chars``, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redacted, docs.schema)
