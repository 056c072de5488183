import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCAN = licenses.Scanner()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    words = WORDS.findall(lowered(text))
    out = []
    for p, label in licenses.PHRASES.items():
        want = p.split(" ")
        out += [(label, k) for k in range(len(words)) if words[k : k + len(want)] == want]
    return len(words), out


pieces = st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "2.0", "cc", "by-nc", "cc by nc", "É", "x", "\n", "under the mit license", "-", "_", "{"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14).map(" ".join) | st.lists(pieces, max_size=8).map("".join))
def test_base_places_equal_brute_force(text):
    n, places, _ = SCAN(text)
    assert (n, places) == brute(text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(licenses.NOTICES)), st.data())
def test_edited_notices_are_found(notice, data):
    edited = notice
    for _ in range(data.draw(st.integers(0, licenses.edits_of(notice)))):
        at = data.draw(st.integers(0, len(edited) - 1))
        how = data.draw(st.sampled_from("dis"))
        edited = edited[:at] + ("" if how == "d" else data.draw(st.sampled_from("abz"))) + edited[at + (how != "i") :]
    text = f"qq zz {edited} vv yy"
    found = SCAN.fuzzy(f" {text} ")
    label = licenses.NOTICES[notice]
    assert any(s[0] == label for s in found)
    for _, start, end, edits, size in found:
        assert any(distance(n, f" {text} "[start:end]) <= edits for n in licenses.NOTICES if len(n) == size)


def test_edited_notices_before_a_better_one_are_found():
    notice, label = next((n, x) for n, x in licenses.NOTICES.items() if n == "all rights reserved")
    text = " all right reserved all rights reserved al rights reserved "
    assert [(s[0], text[s[1] : s[2]].strip(), s[3]) for s in SCAN.fuzzy(text)] == [(label, "all right reserved", 1), (label, notice, 0), (label, "al rights reserved", 1)]
    long = max(licenses.NOTICES, key=len)
    edited = long.replace("e", "", 2)
    twice = [s for s in SCAN.fuzzy(f" {edited} {long} ") if s[4] == len(long)]
    assert [s[3] for s in twice] == [2, 0]
    many = SCAN.fuzzy(" " + "all right reserved " * 300 + "all rights reserved ")
    assert len([s for s in many if s[0] == label]) == 301


def test_spans_point_into_the_text():
    text = "Ünder x. Licensed  under THE Apache-Licence!"
    (span,) = [s for s in SCAN(text)[2] if s["label"] == "apache-2"]
    assert text[span["start"] : span["end"]] == "Licensed  under THE Apache-Licence" and span["edits"] == 1
    assert SCAN("nothing of the kind in this text at all")[2] == []


def test_rows(spark, tmp_path):
    rows = [(1, "Under the MIT License. under the mit license"), (1, "x"), (2, None), (3, ""), (None, "CC-BY-NC"), (4, "undr the mit licence")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, labels string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op4_licenses(spark, str(tmp_path)).collect()
    assert len(got) == 6
    two = next(r for r in got if r.n_base == 2)
    assert (two.first_word, two.last_word, two.base_labels, two.labels, two.score, two.n_words) == (0, 4, "mit", "mit", 1.0, 8)
    none = next(r for r in got if r.doc_id == 2)
    assert (none.n_words, none.n_base, none.first_word, none.base_labels, none.labels, none.score) == (0, 0, None, "", "", 0.0)
    near = next(r for r in got if r.doc_id == 4)
    assert near.base_labels == "" and near.labels == "mit" and 0.8 < near.score < 1
    assert next(r for r in got if r.doc_id is None).labels == "cc-by-nc"
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert licenses.op4_licenses(spark, f"{tmp_path}/none").count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


NOTICE = "all rights reserved"
SMALL = licenses.Scanner({}, {NOTICE: "own", "gnu general public license": "gpl"})
word_list = st.lists(st.sampled_from(["all rights reserved", "all right reserved", "al rigths reserved", "small rights reserved", "all rights", "reserved", "the", "gnu general public licence", "gnu general public license", "gnu generous public license"]), max_size=7).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(word_list)
def test_fuzzy_spans_equal_brute_force(text):
    """No occurrence is lost: whatever whole words are within the edits of a notice lie on a span
    of it; and spans are whole words, disjoint, with their true edits."""
    _, _, spans = SMALL(text)
    words = text.split()
    for notice, label in ((NOTICE, "own"), ("gnu general public license", "gpl")):
        own = [(s["first_word"], s["last_word"], s["edits"]) for s in spans if s["label"] == label]
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        for first, last, edits in own:
            assert edits == edit_distance(notice, " ".join(words[first : last + 1])) <= licenses.edits_of(notice)
        for i in range(len(words)):
            for j in range(i, min(len(words), i + 6)):
                if edit_distance(notice, " ".join(words[i : j + 1])) <= licenses.edits_of(notice):
                    assert any(first <= j and last >= i for first, last, _ in own)


def test_adjacent_notices_and_word_bounds():
    spans = licenses.Scanner()("gnu general public licence gnu general public license")[2]
    assert [(s["first_word"], s["last_word"], s["edits"]) for s in spans] == [(0, 3, 1), (4, 7, 0)]
    assert all(s["edits"] for s in licenses.Scanner()("small rights reserved")[2])


def test_very_long_text():
    n, places, spans = licenses.Scanner()("some words " * 400_000 + "under the mit license")
    assert n == 800_004 and places == [("mit", 800_000)] and spans[-1]["first_word"] == 800_000
