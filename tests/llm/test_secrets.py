import base64
import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import secrets

PLAIN = (
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    out = [(k, *m.span()) for k, p, ok in PLAIN for m in p.finditer(text) if ok(m)]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


pieces = st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", "toKen", "=", ": ", "'", '"', "AKIA", "ABCDEF0123456789", "deadbeef01234567", "zz", " ", "\n", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert [s for s in secrets.find_spans(text) if s[0] in secrets.KINDS[:3]] == brute(text)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7]) * n) for n in (130, 3, 128, 64, 64)))


def test_structures_are_confirmed():
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----"
    assert [s[0] for s in secrets.find_spans(f"x {pem} y") if s[0] == "pem"] == ["pem"]
    assert not [s for s in secrets.find_spans(pem.replace("A", "")) if s[0] == "pem"]
    assert "der" in [s[0] for s in secrets.find_spans("k " + base64.b64encode(RSA).decode())]
    assert "der" in [s[0] for s in secrets.find_spans("k " + RSA.hex())]
    assert "der" not in [s[0] for s in secrets.find_spans("k " + (RSA[:-1]).hex())]
    field = lambda b: len(b).to_bytes(4) + b
    wire = field(b"ssh-ed25519") + field(b"k" * 32)
    assert "wire" in [s[0] for s in secrets.find_spans("ssh-ed25519 " + base64.b64encode(wire).decode())]
    assert "wire" not in [s[0] for s in secrets.find_spans(base64.b64encode(wire + b"x").decode())]


FIELD = lambda b: len(b).to_bytes(4) + b
SMALL = der(0x30, der(2, b"\0") + der(0x30, der(6, b"abc")) + der(4, b"k" * 30))
KEYS = [RSA, SMALL, der(0x30, der(0x30, der(6, b"x")) + der(3, b"p" * 140)), FIELD(b"ssh-ed25519") + FIELD(b"q" * 32), FIELD(b"ssh-rsa") + FIELD(b"\1\0\1") + FIELD(b"n" * 128), b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4) + FIELD(b"pub" * 9) + FIELD(b"priv" * 30)]


def plain_key(data):
    """Kind of key that all of the bytes are, read by plain recursion."""

    def items(x):
        out = []
        while x:
            if len(x) < 2 or x[1] == 0x80 or x[1] > 0x84:
                return None
            n = x[1] - 0x80 if x[1] > 0x80 else 0
            size = int.from_bytes(x[2 : 2 + n]) if n else x[1]
            inner, rest = x[2 + n : 2 + n + size], x[2 + n + size :]
            if len(inner) < size or (x[0] & 0x20 and items(inner) is None):
                return None
            out.append((x[0], inner))
            x = rest
        return out

    if data[:1] == b"\x30" and len(data) >= 24 and (top := items(data)) and len(top) == 1:
        return "der" if secrets.is_key_shape([t for t, _ in items(top[0][1])]) else None
    return None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(KEYS), st.sampled_from(["", "/", "x/", "/abc/", "A"]), st.integers(0, 76), st.sampled_from(["", " y", "\nword then", '"']), st.booleans())
def test_base64_keys_are_found_wherever_they_open(key, before, width, after, safe):
    text = (base64.urlsafe_b64encode if safe else base64.b64encode)(key).decode()
    want = "der" if key[0] == 0x30 else "wire"
    line = max(width, 16)
    whole = before + ("\n".join(text[k : k + line] for k in range(0, len(text), line)) if width else text)
    assert (want, 2 + len(before), 2 + len(whole)) in secrets.find_spans("k " + whole + after)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(KEYS), st.sampled_from(["", "0x", "a", "30", "3081"]), st.booleans())
def test_hex_keys_are_found_in_either_case(key, before, upper):
    text = before + (key.hex().upper() if upper else key.hex())
    want = "der" if key[0] == 0x30 else "wire"
    assert (want, 2 + len(before), 2 + len(text)) in secrets.find_spans("k " + text + " z")


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(KEYS[:3]), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 255)), max_size=2), st.integers(0, 2))
def test_structure_equals_plain_recursion(key, changes, cut):
    data = bytearray(key)
    for at, v in changes:
        data[at % len(data)] = v
    data = bytes(data[: len(data) - cut])
    assert (secrets.is_key(data) and data[0] == 0x30) == (plain_key(data) == "der")


def test_deep_nesting_and_long_texts():
    deep = b"\2\1\0"
    for _ in range(40):
        deep = der(0x30, deep)
    key = der(0x30, der(2, b"\0") + deep + der(4, b"k" * 9))
    assert secrets.is_key(key)
    noise = base64.b64encode(bytes(range(256)) * 4000).decode()
    text = noise + " " + base64.b64encode(key).decode() + " " + "MIIMII" * 20_000 + " " + "AAAAB3NzaC1yc2E" * 5000
    spans = secrets.find_spans(text)
    assert ("der", len(noise) + 1, len(noise) + 1 + len(base64.b64encode(key))) in spans and len(spans) < 5


def test_frames_with_headers():
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n" + base64.encodebytes(b"s" * 160).decode() + "-----END RSA PRIVATE KEY-----"
    assert ("pem", 1, 1 + len(sealed)) in secrets.find_spans("\n" + sealed)
    assert not [s for s in secrets.find_spans(sealed.replace("DEK-Info", "Dek")) if s[0] == "pem"]
    plain = "-----BEGIN PRIVATE KEY-----\nComment: mine\n\n" + base64.encodebytes(SMALL).decode() + "-----END PRIVATE KEY-----"
    assert ("pem", 0, len(plain)) in secrets.find_spans(plain)


def test_signed_tokens():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    good = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    assert ("token", 1, 1 + len(good)) in secrets.find_spans(" " + good)
    assert not [s for s in secrets.find_spans(f"{part({'typ': 'x'})}.{part({})}.a") if s[0] == "token"]


def test_rows(spark, tmp_path):
    rows = [(1, "token=abcdef"), (1, "token=abcdef"), (2, None), (3, "é password: abc"), (None, "AKIA" + "A" * 16)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op6_secrets(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].spans == "assign:0:12" and by[1].n_assign == 1 and by[None].n_access == 1
    assert by[2].base_sha256 == by[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secrets.op6_secrets(spark, f"{tmp_path}/none").count() == 0
