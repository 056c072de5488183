"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Defined results: a null text counts as empty; a null id stays null; every row of the input gives
one row (repeated rows and ids included); texts are scanned whole, in time linear in their
length; other columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidim.llm.common import kind_is, map_batches, read_table

#: Order in which kinds are reported; the first four are counted by the query.
KINDS = ("email", "ip", "card", "phone", "iban")

# The proposing patterns. A lookbehind keeps digit runs from being tried at each digit.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# Score of a confirmed span, and words near it that raise or lower the score.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.85}
RAISING = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
LOWERING = ("example", "sample", "dummy", "version", "isbn", "order", "invoice")
CONTEXT_CHARS = 48
STEP = 0.15
#: Longest local part looked for to the left of an @ before the search is widened.
LOCAL_STEP = 128


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an IBAN without blanks."""
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ with a domain, the longest local part back to the last match."""
    out, floor = [], 0
    for m in DOMAIN.finditer(text):
        at, step = m.start(), LOCAL_STEP
        if at < floor:
            continue
        while True:
            low = max(floor, at - step)
            left = LOCAL.search(text[low:at])
            if not left or left.start() or low == floor:
                break
            step *= 4
        if left:
            out.append((low + left.start(), m.end()))
            floor = m.end()
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ibans(text: str) -> list[tuple[int, int]]:
    """From each start the longest end, at the proposal's or an earlier blank, that mod 97 confirms.

    A word of capitals after an IBAN is proposed as its last group, and a code before one as its
    first; so where no end is confirmed the next start may lie within the proposal.
    """
    out, at = [], 0
    while m := IBAN.search(text, at):
        end = len(m[0])
        while end > 0 and not mod97(m[0][:end].replace(" ", "")):
            end = m[0].rfind(" ", 0, end)
        if end > 0:
            out.append((m.start(), m.start() + end))
        at = m.start() + max(end, 1)
    return out


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out + [("iban", s, e) for s, e in _ibans(text)]


def scored(text: str) -> list[tuple[str, int, int, float]]:
    out = []
    for kind, start, end in confirmed(text):
        near = set(re.findall(r"\w+", (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
        change = STEP * (any(w in near for w in RAISING[kind]) - any(w in near for w in LOWERING))
        out.append((kind, start, end, round(min(1.0, max(0.0, BASE_SCORE[kind] + change)), 6)))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans ARRAY<STRUCT<kind, start, end, score>> of every row of docs."""

    def setup():
        def kernel(ids, texts):
            return [ids, [[dict(zip(("kind", "start", "end", "score"), s)) for s in scored(t or "")] for t in texts]]

        return kernel

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, spans ARRAY<STRUCT<kind: STRING, start: LONG, end: LONG, score: DOUBLE>>", setup)


def redact(text: str, spans: list, least: float = 0.5) -> str:
    """The text with each span of a sufficient score replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["score"] >= least and s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
    return "".join(out) + text[at:]


def joined(spans, kinds=None) -> F.Column:
    """kind:start:end of the spans, comma-joined, in their order."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(text: str) -> str:
    """What sha2 gives for the joined spans; for tests."""
    return hashlib.sha256(text.encode()).hexdigest()


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(
        "doc_id", *n,
        F.sha2(joined(F.col("spans"), KINDS[:4]), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
