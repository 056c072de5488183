"""Secrets: patterns propose candidates, and only what decodes to a known structure is added.

Base64 and hex candidates are tried from every place where a key's encoding can open, whatever
stands before it: the lengths that the encoding states decide where it ends. Base64 may be wrapped
over lines.

Defined results: a null text counts as empty; a null id stays null; every row of the input gives
one row; texts of any length are scanned whole; other columns of the input are left alone. Spans
of different kinds may overlap, those of one kind don't: of those that do the first is kept.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import kind_is, map_batches, read_table

#: Order of kinds that start at the same place; the first three are the plain ones.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "wire")

# The proposing patterns and the least lengths.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
FRAME = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*?)PRIVATE KEY-----")
SEALED_HEADERS = re.compile(r"Proc-Type: *4,ENCRYPTED\s.*?DEK-Info: *[A-Z0-9-]+,([0-9A-Fa-f]+)\s", re.S)
HEADERS = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t][^\n]*\n)*)*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*(?:(?:[ \t]*\r?\n[ \t]*)?={1,2})?")
PADDING = re.compile(r"(?:[ \t]*\r?\n[ \t]*)?={1,2}")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{48,}")
MIN_BASE64 = 48
URL_SAFE = str.maketrans("-_", "+/")
#: How a SEQUENCE of at least 24 bytes, the magic, or a length and a type name open in either encoding.
OPENINGS = re.compile(r"M[B-I]|b3BlbnNzaC1rZXktdjEA|AAAAB3NzaC1|AAAAC3NzaC1lZDI1NTE5|AAAAE2VjZHNhLXNoYTIt")
HEX_OPENINGS = re.compile(r"30(?:8[1-4]|[1-7][0-9a-f])|6f70656e7373682d6b65792d763100|000000077373682d|0000000b7373682d|000000136563647361", re.I)
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Type names that open a key in the length-prefixed wire format.
WIRE_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
WIRE_MAGIC = b"openssh-key-v1\0"
#: Fields of a key of each type.
WIRE_FIELDS = (3, 5, 2, 3, 3, 3)


def decode64(text: str) -> bytes:
    """Bytes of standard or URL-safe base64 with or without padding; empty if it is neither."""
    text = re.sub(r"\s+", "", text).rstrip("=").translate(URL_SAFE)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


#: Gives n bytes of a candidate from a place on, fewer at its end.
Part = Callable[[int, int], bytes]


def der_size(head: bytes) -> int:
    """Bytes of the value that head opens, by its tag and length; 0 if that can't be read."""
    if len(head) < 2 or head[1] == 0x80 or head[1] > 0x84:
        return 0
    n = max(0, head[1] - 0x80)
    return 2 + n + (int.from_bytes(head[2 : 2 + n]) if n else head[1]) if len(head) >= 2 + n else 0


def der_children(part: Part, total: int) -> list[int] | None:
    """Tags of the values in one SEQUENCE over all bytes, if all nested lengths fit; else None."""
    ends, tags, at = [], [], 0
    while at < total:
        while ends and at == ends[-1]:
            ends.pop()
        head = part(at, 6)
        size = der_size(head)
        if not size or at + size > (ends[-1] if ends else total) or (not ends and (head[0] != 0x30 or size != total)):
            return None
        if len(ends) == 1:
            tags.append(head[0])
        if head[0] & 0x20:  # holds values itself
            ends.append(at + size)
            at += 2 + max(0, head[1] - 0x80)
        else:
            at += size
    return tags


def is_key_shape(tags: list[int] | None) -> bool:
    """Whether a SEQUENCE of these is a key: version INTEGER and key material, or a key sealed or public."""
    if not tags:
        return False
    numbers = len(tags) >= 6 and all(k == 0x02 for k in tags)
    return numbers or tags[:3] == [0x02, 0x30, 0x04] or tags[:2] == [0x02, 0x04] or tags in ([0x30, 0x04], [0x30, 0x03])


def fields_end(part: Part, total: int, at: int, n: int) -> int:
    """Where n length-prefixed fields from a place on end; 0 if they don't fit."""
    for _ in range(n):
        if at + 4 > total:
            return 0
        at += 4 + int.from_bytes(part(at, 4))
    return at if at <= total else 0


def wire_size(part: Part, total: int) -> int:
    """Bytes of the key that opens in the length-prefixed format: a known type and its fields, or
    the magic, three fields, a count of keys, the public ones and the private part; else 0."""
    head = part(0, 4 + max(map(len, WIRE_TYPES)))
    if head.startswith(WIRE_MAGIC):
        at = fields_end(part, total, len(WIRE_MAGIC), 3)
        keys = int.from_bytes(part(at, 4)) if at else 0
        return fields_end(part, total, at + 4, keys + 1) if 0 < keys <= total // 4 else 0
    size = int.from_bytes(head[:4])
    for name, n in zip(WIRE_TYPES, WIRE_FIELDS):
        if size == len(name) and head[4 : 4 + size] == name:
            return fields_end(part, total, 0, n)
    return 0


def key_opened(part: Part, total: int) -> tuple[str, int] | None:
    """(kind, bytes) of the key that opens a candidate of at most `total` bytes."""
    head = part(0, 6)
    if head[:1] == b"\x30":
        size = der_size(head)
        return ("der", size) if 24 <= size <= total and is_key_shape(der_children(part, size)) else None
    size = wire_size(part, total)
    return ("wire", size) if size else None


def is_key(data: bytes) -> bool:
    """Whether one key takes all of the bytes."""
    found = key_opened(lambda at, n: data[at : at + n], len(data))
    return found is not None and found[1] == len(data)


def keys_in_base64(text: str, low: int, high: int) -> list[tuple[str, int, int]]:
    """Spans of keys in a run of base64, which may hold line breaks; a key ends where a line does."""
    body = text[low:high].rstrip("=")
    run = "".join(body.split()).translate(URL_SAFE)
    if len(run) < MIN_BASE64 or not OPENINGS.search(run):
        return []
    place = [k for k, c in enumerate(body) if not c.isspace()] if len(run) < len(body) else range(len(body))
    out, at = [], 0
    while m := OPENINGS.search(run, at):
        start, at = m.start(), m.start() + 1

        def part(k: int, n: int, start=start) -> bytes:
            chars = run[start + k // 3 * 4 : start + -(-(k + n) // 3) * 4]
            chars = chars[:-1] if len(chars) % 4 == 1 else chars
            return binascii.a2b_base64(chars + "=" * (-len(chars) % 4))[k % 3 : k % 3 + n]

        found = key_opened(part, (len(run) - start) * 3 // 4)
        if not found:
            continue
        last = start + -(-found[1] * 4 // 3)
        if last - start < MIN_BASE64 or (last < len(run) and place[last] == place[last - 1] + 1):
            continue
        at, end = last, low + place[last - 1] + 1
        if m := PADDING.match(text, end, high):
            end = m.end()
        out.append((found[0], low + place[start], end))
    return out


def keys_in_hex(text: str, low: int, high: int) -> list[tuple[str, int, int]]:
    """Spans of keys that end a run of hex digits."""
    at = low
    while m := HEX_OPENINGS.search(text, at, high):
        start, at = m.start(), m.start() + 1
        found = key_opened(lambda k, n: binascii.unhexlify(text[start + 2 * k : min(start + 2 * (k + n), start + (high - start) // 2 * 2)]), (high - start) // 2)
        if found and start + 2 * found[1] == high:
            return [(found[0], start, high)]
    return []


def framed_keys(text: str) -> list[tuple[str, int, int]]:
    """Framed keys whose body decodes to a key, or whose headers seal it: then the body must fill
    whole blocks of as many bytes as the headers' initial vector."""
    out, opened = [], None
    for m in FRAME.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2]:
            body = text[opened.end() : m.start()]
            sealed = SEALED_HEADERS.match(body.lstrip())
            raw = decode64(body[HEADERS.match(body).end() :])
            block = len(sealed[1]) // 2 if sealed else 0
            if is_key(raw) or (block in (8, 16) and raw and len(raw) % block == 0):
                out.append(("pem", opened.start(), m.end()))
            opened = None
    return out


def apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the overlapping spans of a kind, the first."""
    out, ends = [], {}
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= ends.get(kind, 0):
            ends[kind] = end
            out.append((kind, start, end))
    return out


def is_signed_token(text: str) -> bool:
    """A header object that names its algorithm, and a payload object, both base64url JSON."""
    head, body, _ = text.split(".")
    try:
        header, payload = json.loads(decode64(head)), json.loads(decode64(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    added = []
    if "eyJ" in text:
        added += [("token", *m.span()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        added += framed_keys(text)
    for m in HEX_KEY.finditer(text):
        added += keys_in_hex(text, *m.span())
    for m in BASE64.finditer(text):
        added += keys_in_base64(text, *m.span())
    return sorted(out + apart(added), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans ARRAY<STRUCT<kind, start, end>> of every row of docs."""

    def setup():
        def kernel(ids, texts):
            return [ids, [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t or "")] for t in texts]]

        return kernel

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, spans ARRAY<STRUCT<kind: STRING, start: LONG, end: LONG>>", setup)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
