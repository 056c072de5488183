import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import pii

# The contract's patterns as they are given, run plainly.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+_% 0123 456789()é\n", max_size=80))
def test_base_spans_equal_plain_patterns(text):
    assert [s for s in pii.confirmed(text) if s[0] != "iban"] == brute(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.confirmed("iban DE89 3704 0044 0532 0130 00.")[-1][0] == "iban"


def test_ibans_before_capital_words():
    ibans = lambda t: [t[s:e] for k, s, e in pii.confirmed(t) if k == "iban"]
    es, de, at = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201"
    for after in ("", " EUR 50", " BIC X", " BANK", " BANK OF", "."):
        for code in (es, de, at, es.replace(" ", "")):
            assert ibans(f"IBAN {code}{after}") == [code]
    assert ibans(f"{es} {at} {de}") == [es, at, de] and ibans(f"AB12 CDEF 3456 {es} EUR") == [es]
    assert ibans("ES91 2100 0418 4502 0005 1333 EUR") == []
    assert ibans("AB12 CDEF " * 30_000) == []


def test_context_and_redaction():
    near, far, low = (pii.scored(t)[0][3] for t in ("mail me a@b.co", "xx a@b.co", "example a@b.co"))
    assert near > far > low
    spans = [dict(zip(("kind", "start", "end", "score"), s)) for s in pii.scored("write a@b.co now")]
    assert pii.redact("write a@b.co now", spans) == "write [EMAIL] now"


def test_long_runs_stay_linear():
    assert pii.confirmed("a" * 300_000 + " " + "1" * 300_000) == []
    assert pii.confirmed("a" * 5000 + "@b.co") == [("email", 0, 5005)]


def test_rows(spark, tmp_path):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, ""), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, spans string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 2 and sum(r.n_ip for r in got) == 1
    by = {r.doc_id: r for r in got}
    assert by[1].spans == "email:0:6" and by[1].base_sha256 == pii.digest("email:0:6")
    assert by[2].spans == "" and by[2].base_sha256 == pii.digest("") == by[3].base_sha256
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op8_pii(spark, f"{tmp_path}/none").count() == 0
