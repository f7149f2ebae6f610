"""Secrets in texts: pattern candidates, and encoded keys and tokens confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns with the least length of what they must hold, and the order of kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so a run of 32 or more is the whole match
KINDS = ["assign", "access", "hex", "jwt", "pem", "key"]
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\x00"

#: Runs that a signed token may be in: parts joined by dots.
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Header lines, if any, and their continuations, then the body.
ARMOUR = re.compile(r"\s*+((?:[A-Za-z][A-Za-z0-9-]*:[^\r\n]*\r?\n(?:[ \t][^\r\n]*\r?\n)*+)*+)([A-Za-z0-9+/=\s]+)")
PROC_TYPE = re.compile(r"(?m)^Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t]*\r?$")
DEK_INFO = re.compile(r"(?m)^DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{16}){1,2})[ \t]*\r?$")
CODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")

#: Cheap tests of a whole batch; a superset of the rows in which each pattern can match.
MAY = [
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    r"AKIA[A-Z0-9]",
    r"[A-Za-z0-9+/_-]{24}|eyJ",
    r"-----BEGIN ",
]


def _unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _der(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The elements that tile data exactly by their declared lengths, constructed ones checked within."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and _der(body, depth + 1) is None:
            return None
        out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all bytes that starts as a private key (a version), or is a public one (an algorithm and a
    BIT STRING) or an encrypted one (an algorithm with its parameters and an OCTET STRING)."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = _der(data)
    if not top or len(top) != 1:
        return False
    parts = _der(top[0][1])
    if not parts or len(parts) < 2:
        return False
    if parts[0][0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 1:
        return len(parts) >= 3
    if parts[0][0] == 0x30 and parts[1][0] in (0x03, 0x04):
        names = _der(parts[0][1])
        if not names or names[0][0] != 0x06:
            return False
        # A digest of a signature is an algorithm without parameters (or a NULL) and an OCTET STRING.
        return parts[1][0] == 0x03 or len(parts) == 2 and len(names) == 2 and names[1][0] == 0x30 and len(parts[1][1]) > 0
    return False


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at a place, and where it ends."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else None


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that tile data."""
    out, at = [], 0
    while at < len(data):
        if (found := _field(data, at)) is None:
            return None
        out.append(found[0])
        at = found[1]
    return out


def is_openssh_key(data: bytes) -> bool:
    """The private container: cipher, key derivation and its options, the public keys and the private part."""
    at, head = len(OPENSSH), []
    for _ in range(3):
        if (found := _field(data, at)) is None:
            return False
        head.append(found[0])
        at = found[1]
    cipher, kdf, options = head
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not data.startswith(OPENSSH) or at > len(data) or n < 1 or not cipher or not kdf:
        return False
    if (kdf == b"none") != (not options) or (kdf == b"none") != (cipher == b"none"):
        return False
    # A salt and the number of rounds.
    if kdf == b"bcrypt" and ((salt := _field(options, 0)) is None or len(options) != salt[1] + 4):
        return False
    for _ in range(n):
        if (found := _field(data, at)) is None:
            return False
        public = _fields(found[0])
        if not public or len(public) < 2 or not public[0].isascii():
            return False
        at = found[1]
    if (found := _field(data, at)) is None or len(found[0]) < 8 or len(found[0]) % 8:
        return False
    private, at = found
    # Two equal numbers begin a readable private part; ciphers with a tag put its 16 bytes behind.
    if cipher == b"none":
        return private[:4] == private[4:8] and at == len(data)
    return len(data) - at in ((16,) if b"-gcm" in cipher or b"poly1305" in cipher else (0,))


def is_ssh_key(data: bytes) -> bool:
    """The private container, or a public key whose length-prefixed fields tile it."""
    if data.startswith(OPENSSH):
        return is_openssh_key(data)
    fields, at = [], 0
    while at < len(data):
        if (found := _field(data, at)) is None:
            return False
        fields.append(found[0])
        at = found[1]
        if fields[0] not in SSH_NAMES:
            return False
    return len(fields) >= 2


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_ssh_key(data))


def is_pem_key(headers: str | None, body: str) -> bool:
    """A key, or the whole cipher blocks that the headers say it was encrypted to."""
    data = _unbase64("".join(body.split()))
    if headers and PROC_TYPE.search(headers):
        start = DEK_INFO.search(headers)
        return bool(start and data) and len(data) % (len(start[1]) // 2) == 0
    return is_key(data)


def is_token(text: str) -> bool:
    """A signed token: its first two parts are JSON objects and the header names an algorithm. JSON nested deeper than
    the parser goes is none."""
    try:
        head, body = (json.loads(_unbase64(x) or b"") for x in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def token_spans(text: str) -> list[tuple[int, int]]:
    """Signed tokens: three parts joined by dots, from the first "eyJ" of one (an object's start in base64). Each part of
    a run is decoded in three places at most, so time is linear in the text."""
    out = []
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, starts = run[0].split("."), run.start(), []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        k = 0
        while k + 2 < len(parts):
            found = parts[k].find("eyJ")
            if found >= 0 and len(parts[k]) > found + 3 and parts[k + 1] and is_token(f"{parts[k][found:]}.{parts[k + 1]}"):
                out.append((starts[k] + found, starts[k + 2] + len(parts[k + 2])))
                k += 3
            else:
                k += 1
    return out


def armour_spans(text: str) -> list[tuple[int, int]]:
    """Armoured private keys. What stands between two runs of dashes is read once, so time is linear in the text."""
    out = []
    for m in BEGIN.finditer(text):
        end = text.find("-----", m.end())
        last = f"-----END {m[1]}-----"
        if end >= 0 and text.startswith(last, end) and (inside := ARMOUR.fullmatch(text, m.end(), end)) and is_pem_key(inside[1], inside[2]):
            out.append((m.start(), end + len(last)))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What decodes to a key or a signed token."""
    out = [(a, e, "jwt") for a, e in token_spans(text)] + [(a, e, "pem") for a, e in armour_spans(text)]
    for m in CODED.finditer(text):
        s = m[0]
        if is_key(_unbase64(s)) or len(s) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", s) and is_key(bytes.fromhex(s)):
            out.append((m.start(), m.end(), "key"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans of each row of docs (doc_id, text, ...).

    Spans are kind:start:end, in code points, end exclusive; those that start together are in the order of KINDS. Null
    and empty texts have none. Repeated rows are each scanned, rows without doc_id too; other columns are ignored
    whatever their names, and an empty table gives an empty one. Rows are independent: no shuffle, one batch in
    memory, and each text, however long, is scanned in time linear in its length.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_spans string, spans string"

    def run(batches):
        for b in batches:
            text = b.column("text").fill_null("")
            may = [pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in MAY]
            n = len(text)
            counts = {k: [0] * n for k in KINDS[:3]}
            base, whole = [""] * n, [""] * n
            for i in (may[0] | may[1] | may[2] | may[3]).nonzero()[0].tolist():
                t = text[i].as_py()
                found = base_spans(t)
                for _, _, k in found:
                    counts[k][i] += 1
                base[i] = _joined(found)
                more = confirmed_spans(t) if may[2][i] or may[3][i] else []
                whole[i] = _joined(found + more) if more else base[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(base, pa.string()), pa.array(whole, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
