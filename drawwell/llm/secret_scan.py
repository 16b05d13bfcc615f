"""Secret scans with structural confirmation.

Pattern kinds (assign, access, hex) are reported as matched. Candidates for the other kinds are reported only after
their structure holds: a private key whose nested lengths all add up (der), an OpenSSH private key container (ssh), the
armoured form of either or of an encrypted key (pem), or a signed token whose header and payload are JSON objects and
whose header names an algorithm (jwt).

Base64 and hex are tried wherever in a run of their characters a key can begin, so what stands before it ("conf/", "key-")
doesn't hide it; the key's own length says where it ends. A run goes on over line breaks, escaped ones too. Keys are
looked for up to KEY_BYTES bytes, the length that two length bytes can say; headers of tokens up to HEADER_CHARS.

Defined cases: a null text counts as empty and has no spans; each row is scanned on its own, so repeated rows repeat
their spans; of spans with one start the kinds come in the order of KINDS; keys inside an armoured one are not listed
again; whole texts are scanned whatever their length; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawwell.llm.common import table

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


ASSIGN = re.compile(rf"""({"|".join(map(_either_case, _KEYWORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_BYTES = 1 << 16
HEADER_CHARS = 1 << 13
#: Runs that may hold encoded bytes, over several lines.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n")
#: Where a key can begin in a run: a DER sequence or the name of an OpenSSH key, in base64 or in hex.
OPENING = re.compile(r"(?=(M[A-P])|(30[1-8])|(b3BlbnNzaC1rZXktdjEA)|(6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100))")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
ENCRYPTED = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s")

_SEQUENCE, _INTEGER, _OCTETS, _OID = 0x30, 0x02, 0x04, 0x06
_OPENSSH = b"openssh-key-v1\x00"


def decode_base64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it isn't base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of a run of DER values; None unless their lengths are minimal and fill data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
            if size < 0x80 or size >> 8 * (width - 1) == 0:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """A PKCS#1 or DSA key (version and at least five integers), PKCS#8 (version, algorithm, octets that hold a key by
    its own lengths, or an encrypted key: algorithm, octets in whole blocks), or an EC key (version 1, octets)."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE or not (items := der_items(outer[0][1])):
        return False
    tags = [t for t, _ in items]
    named = lambda content: bool(inner := der_items(content)) and inner[0][0] == _OID
    if tags[0] == _INTEGER and len(items[0][1]) == 1 and items[0][1][0] <= 1:
        if len(tags) >= 6 and set(tags[1:6]) == {_INTEGER} and min(len(c) for _, c in items[1:]) >= 1:
            return True
        if tags[1:3] == [_SEQUENCE, _OCTETS] and named(items[1][1]):
            return _is_key_body(items[2][1])
        return items[0][1] == b"\x01" and tags[1:2] == [_OCTETS] and 16 <= len(items[1][1]) <= 72 and {*tags[2:]} <= {0xA0, 0xA1}
    whole = len(items) == 2 and len(items[1][1]) >= 16 and len(items[1][1]) % 8 == 0
    return tags == [_SEQUENCE, _OCTETS] and named(items[0][1]) and len(der_items(items[0][1]) or ()) > 1 and whole


def _is_key_body(data: bytes) -> bool:
    """What the octets of a PKCS#8 key hold: one value, a sequence that starts with its version, or a string or number
    of 16 bytes or more."""
    inner = der_items(data)
    if not inner or len(inner) != 1:
        return False
    tag, content = inner[0]
    if tag == _SEQUENCE:
        items = der_items(content)
        return bool(items) and len(items) > 1 and items[0][0] == _INTEGER and len(items[0][1]) == 1 and items[0][1][0] <= 1
    return tag in (_OCTETS, _INTEGER) and len(content) >= 16


def ssh_size(data: bytes) -> int | None:
    """Bytes of the openssh-key-v1 container that data starts with: cipher, kdf, options, a count of keys, public keys
    and the private block, each with its own length."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def string() -> int | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return size

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or any(string() is None for _ in range(keys)):
        return None
    return at if string() else None


def is_private_ssh(data: bytes) -> bool:
    return ssh_size(data) == len(data)


def is_signed_token(text: str) -> bool:
    head, body, signature = (decode_base64(x) for x in text.split("."))
    try:
        header, claims = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    return signature is not None and (header["alg"].lower() == "none" or len(signature) >= 16)


def _token_start(text: str) -> int | None:
    """Where in a candidate's first part the header of a signed token starts: at its first character, or at a later one
    that opens an object."""
    head, rest = text.split(".", 1)
    for at in [0, *(m.start() for m in re.finditer("e[wy]", head) if m.start())]:
        if len(head) - at <= HEADER_CHARS and is_signed_token(f"{head[at:]}.{rest}"):
            return at
    return None


def _der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins like this, if a version or an algorithm comes first in it."""
    if len(head) < 6 or head[0] != _SEQUENCE:
        return None
    width = head[1] - 0x80 if head[1] >= 0x80 else 0
    if width > 2 or head[1] == 0x80 or head[2 + width] not in (_INTEGER, _SEQUENCE):
        return None
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def _key_at(run: str, at: int, hexadecimal: bool, ssh: bool) -> int | None:
    """Where the key that begins at a place of a run ends."""
    digits = 2 if hexadecimal else 4 / 3

    def decoded(size: int) -> bytes:
        part = run[at : at + size]
        if not hexadecimal:
            return decode_base64(part if len(part) % 4 != 1 else part[:-1]) or b""
        part = part[: len(part) // 2 * 2]
        return bytes.fromhex(part) if re.fullmatch("[0-9A-Fa-f]*", part) else b""

    if ssh:
        part = re.match("[0-9A-Fa-f]*", run[at : at + 2 * KEY_BYTES])[0] if hexadecimal else ""
        size = ssh_size(decoded(len(part) if hexadecimal else 4 * KEY_BYTES // 3))
    else:
        size = _der_size(decoded(16))
        if size is not None and not is_private_der(decoded(math.ceil(size * digits))[:size]):
            size = None
    end = None if size is None else at + math.ceil(size * digits)
    return end if end is not None and end <= len(run) else None


def encoded_keys(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in base64 or hex."""
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < 48:
            continue
        body, starts, places = m[0].rstrip("="), [0], [m.start()]
        if "\n" in body or "\\" in body:  # lines put together, and where each one came from
            lines, at, joined = [], 0, 0
            for b in [*BREAK.finditer(body), None]:
                lines.append(body[at : b.start() if b else None])
                joined += len(lines[-1])
                if b:
                    at = b.end()
                    starts.append(joined)
                    places.append(m.start() + at)
            body = "".join(lines)
        where = lambda i: places[k := bisect_right(starts, i) - 1] + i - starts[k]  # noqa: E731, B023
        done = 0
        for c in OPENING.finditer(body):
            kind = c.lastindex
            if c.start() < done or (end := _key_at(body, c.start(), kind in (2, 4), kind > 2)) is None:
                continue
            done = end
            close = where(end - 1) + 1
            if end == len(body) and kind in (1, 3):
                close = m.end()
            out.append(("ssh" if kind > 2 else "der", where(c.start()), close))
    return out


def armoured_keys(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of armoured keys; the closing line is looked for as far as a key of KEY_BYTES reaches."""
    out = []
    for m in BEGIN.finditer(text):
        close = f"-----END {m[1]}-----"
        end = text.find(close, m.end(), m.end() + 2 * KEY_BYTES)
        if end < 0 or (out and m.start() < out[-1][2]):
            continue
        body = re.sub(r"\\[rn]", "\n", text[m.end() : end])
        sealed = ENCRYPTED.match(body)
        data = decode_base64(re.sub(r"\s+", "", body[sealed.end() if sealed else 0 :]))
        if data and (len(data) % (len(sealed[1]) // 2) == 0 if sealed else is_private_der(data) or is_private_ssh(data)):
            out.append(("pem", m.start(), end + len(close)))
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then in the order of KINDS."""
    if not text:
        return []
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    armoured = armoured_keys(text) if "-----BEGIN " in text else []
    out += armoured
    out += [k for k in encoded_keys(text) if not any(a <= k[1] and k[2] <= b for _, a, b in armoured)]
    if "." in text:
        for m in TOKEN.finditer(text):
            if (at := _token_start(m[0])) is not None:
                out.append(("jwt", m.start() + at, m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@F.arrow_udf(_SPAN_TYPE)
def _secrets(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py())] for t in texts], SPANS)


def secret_spans(text: Column) -> Column:
    """All secrets of a text column, as an array of (kind, start, end)."""
    return _secrets(text)


def _redacted(text: str | None) -> str | None:
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def redact_secrets(texts: pa.Array) -> pa.Array:
    """The text with each maximal run of secrets replaced by [secret]; null stays null."""
    return pa.array([_redacted(t.as_py()) for t in texts], pa.string())


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: counts of the base kinds, their digest, and all spans."""
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["kind"].isin("assign", "access", "hex"))).cast("long").alias("n_confirmed"),
    )
