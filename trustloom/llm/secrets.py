r"""Secret scans with structural confirmation.

Base kinds are patterns with a length rule: assign (a credential name, `=` or `:`, a value), access (an
access key id) and hex. The method adds spans of three kinds, each confirmed by decoding: `jwt`, three
base64url segments whose first decodes to a JSON object with "alg" and second to a JSON object; `der`, a
base64 or hex run that decodes to an ASN.1 SEQUENCE whose nested lengths fill it exactly and begin as
private (also encrypted) or public key structures do; `sshkey`, a base64 run that decodes to the "openssh-key-v1"
container or to an SSH public key, with length-prefixed fields that fit. Base64 may be of either alphabet and
wrapped: its lines, the first of 16 characters or more, may be of any width, indented, and end in line ends or
in escaped ones; the lengths inside the structure tell where it ends. A wrapped structure is of at most 65,536
bytes, several times the largest keys in use. Base spans always stay.

Defined cases: null text counts as empty and gives zero counts and empty spans. Matches that fail their
rule are dropped and not tried again shorter. Offsets are code points, the end exclusive. Repeated rows each
get their row. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside

KINDS = ("assign", "access", "hex", "jwt", "der", "sshkey")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}")
#: A run that may begin a key: a SEQUENCE, four bytes that start with three zeros, or the container's name; also right behind an escaped line end.
START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?=M[A-P]|AAAA|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{16,}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LINE_END = re.compile(r"[ \t]*(?:\r\n|\n|\r|(?:\\r)?\\n)(?:[ \t]|\\t)*")
PADDING = re.compile(rf"(?:(?:{LINE_END.pattern})?=){{1,2}}")
LONGEST = 65_536
# Object identifier prefixes of password-based encryption, in DER.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# How many fields follow the name of a public key's type.
PUBLIC_FIELDS = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2, b"sk-ssh-ed25519@openssh.com": 2, b"sk-ecdsa-sha2-nistp256@openssh.com": 3}
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in NAMES) and ("=" in text or ":" in text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _json_part(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _der_items(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[lo:hi] exactly; None if lengths don't fit."""
    out = []
    while lo < hi:
        if lo + 2 > hi:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > hi:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > hi:
            return None
        out.append((tag, at, at + n))
        lo = at + n
    return out


def is_key_der(data: bytes) -> bool:
    """A SEQUENCE of a version INTEGER and key parts, or of an algorithm SEQUENCE with an OID and a BIT STRING or, if it encrypts by password, an OCTET STRING."""
    top = _der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _der_items(data, top[0][1], top[0][2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]

    def algorithm(k: int) -> bool:
        inner = _der_items(data, parts[k][1], parts[k][2])
        return parts[k][0] == 0x30 and bool(inner) and inner[0][0] == 0x06

    version = tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] in (0, 1)
    if version and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        return algorithm(1)
    if version and (tags[1] == 0x04 or (len(tags) >= 9 or len(tags) == 6) and set(tags) == {0x02}):
        return True
    if tags == [0x30, 0x04] and algorithm(0):
        _, lo, hi = _der_items(data, parts[0][1], parts[0][2])[0]
        return data[lo:hi].startswith(PBE)
    return tags == [0x30, 0x03] and algorithm(0)


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        n = int.from_bytes(data[15:19], "big")
        return 0 < n <= 64 and len(data) >= 19 + n
    if len(data) < 8:
        return False
    n = int.from_bytes(data[:4], "big")
    if not (4 <= n <= 64 and data[4 : 4 + n].startswith((b"ssh-", b"ecdsa-"))):
        return False
    at = 4 + n
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def confirmed_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "eyJ" in text:
        for m in JWT.finditer(text):
            head, body, _ = m[0].split(".")
            if "alg" in (_json_part(head) or {}) and _json_part(body) is not None:
                out.append(("jwt", m.start(), m.end()))
    keys: list[Span] = []
    for m in START.finditer(text):
        if not keys or m.start() >= keys[-1][2]:
            found = _key_at(text, m.start())
            if found:
                keys.append(found)
    more = []
    for m in BASE64.finditer(text):
        near = bisect.bisect_right(keys, m.start(), key=lambda k: k[1]) - 1
        if near < 0 or m.start() >= keys[near][2]:
            kind = _decoded(m[0])
            if kind:
                more.append((kind, *m.span()))
    return sorted(out + keys + more, key=lambda k: k[1])


def _gathered(text: str, at: int, most: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to most base64 characters from at on, across line ends, and where each line starts: (characters before it, place in text)."""
    body, lines, n = [], [], 0
    while n < most:
        m = LINE.match(text, at)
        if not m:
            break
        part = m[0][: most - n]
        body.append(part)
        lines.append((n, at))
        n += len(part)
        gap = LINE_END.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return "".join(body), lines


def _bytes_of(body: str) -> bytes:
    body = body.replace("-", "+").replace("_", "/")
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _der_size(head: bytes) -> int | None:
    """Bytes of the element that head begins."""
    n, k = head[1], head[1] & 0x7F
    if n < 0x80:
        return 2 + n
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 and len(head) >= 2 + k else None


def _ssh_size(data: bytes) -> int | None:
    """Bytes of the container or public key that data begins, by its length-prefixed fields."""

    def field(at: int) -> int:
        return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    if data.startswith(b"openssh-key-v1\0"):
        at = field(field(field(15)))  # cipher, key derivation and its options
        n = int.from_bytes(data[at : at + 4], "big")
        if not 1 <= n <= 16:
            return None
        at += 4
        for _ in range(n + 1):  # the public keys and the private part
            at = field(at)
    else:
        at = field(0)
        for _ in range(PUBLIC_FIELDS.get(data[4:at], 0) if at <= len(data) else 0):
            at = field(at)
        if data[4 : field(0)] not in PUBLIC_FIELDS:
            return None
    return at if at <= len(data) else None


def _key_at(text: str, start: int) -> Span | None:
    """The key whose base64, wrapped or not, begins at start."""
    if text[start] == "M":
        size = _der_size(_bytes_of(_gathered(text, start, 8)[0]))
        kind, confirmed = "der", is_key_der
    else:
        size = _ssh_size(_bytes_of(_gathered(text, start, -(-LONGEST * 4 // 3))[0]))
        kind, confirmed = "sshkey", lambda data: True
    if size is None or not 30 <= size <= LONGEST:
        return None
    n = -(-size * 4 // 3)
    body, lines = _gathered(text, start, n)
    if len(body) < n or not confirmed(_bytes_of(body)[:size]):
        return None
    before, at = lines[-1]
    end = at + n - before
    if re.match(r"[A-Za-z0-9+/]", text[end : end + 1]):  # the run goes on
        return None
    padding = PADDING.match(text, end) if n % 4 else None
    return kind, start, padding.end() if padding else end


def _decoded(run: str) -> str | None:
    tries = []
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        tries.append(binascii.unhexlify(run))
    body = run.rstrip("=")
    if len(body) % 4 != 1:
        try:
            tries.append(base64.b64decode(body + "=" * (-len(body) % 4)))
        except binascii.Error:
            pass
    return next((kind for data in tries for kind, ok in (("der", is_key_der), ("sshkey", is_ssh_key)) if ok(data)), None)


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def _scan(texts: list[str]) -> dict[str, pa.Array]:
    rows = []
    for text in texts:
        base = base_spans(text)
        rows.append(([sum(s[0] == k for s in base) for k in KINDS[:3]], hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(base + confirmed_spans(text), KINDS)))
    counts = {f"n_{k}": pa.array([r[0][i] for r in rows], pa.int64()) for i, k in enumerate(KINDS[:3])}
    return counts | {"base_sha256": pa.array([r[1] for r in rows], pa.string()), "spans": pa.array([r[2] for r in rows], pa.string())}


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return beside(rows, ["doc_id"], _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
