import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import decontamination as dc

ALPHABET = "abc de"


def semi(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        how = rng.choice("dis")
        text = text[:at] + ("" if how == "d" else rng.choice(ALPHABET)) + text[at + (how != "i") :]
    return text


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=24), st.integers(0, 5))
def test_align_equals_full_matrix(pattern, text, edits):
    got, want = dc.align(pattern.encode(), text.encode(), edits), semi(pattern, text)
    if want > edits:
        assert got is None
    else:
        assert got[0] == want == distance(pattern, text[got[1] : got[2]])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_matcher_equals_brute_force():
    rng = random.Random(5)
    items = [words(rng, rng.randint(6, 40)) for _ in range(30)]
    patterns = [(k, dc.normal(t)) for k, t in enumerate(items)]
    texts = [dc.normal(words(rng, rng.randint(0, 120))) for _ in range(40)]
    for k in range(60):
        item = patterns[rng.randrange(30)][1].decode()
        texts.append(dc.normal(words(rng, rng.randint(0, 40)) + " " + edited(rng, item, rng.randint(0, dc.budget(len(item)) + 3)) + " " + words(rng, rng.randint(0, 40))))
    m = dc.Matcher(patterns)
    got = m.find(texts)
    n = 0
    for a, text in enumerate(texts):
        for k, (_, p) in enumerate(patterns):
            least = semi(p.decode(), text.decode())
            assert ((a, k) in got) == (least <= dc.budget(len(p)))
            if (a, k) in got:
                n += 1
                edits, start, end = got[a, k]
                assert edits == least == distance(p.decode(), text[start:end].decode())
    assert n > 30


def test_ranges_are_halved_without_loss():
    rng = random.Random(9)
    items = [words(rng, rng.randint(6, 40)) for _ in range(12)] + ["aaaaaaaa " * 30]
    patterns = [(k, dc.normal(t)) for k, t in enumerate(items)]
    texts = [dc.normal(words(rng, 60) + " " + edited(rng, items[rng.randrange(13)], rng.randint(0, 6)) + " " + words(rng, 60)) for _ in range(80)] + [dc.normal("aaaaaaaa " * 3000)]
    m = dc.Matcher(patterns)
    want = m.find(texts)
    old, dc.HITS = dc.HITS, 50
    try:
        assert m.find(texts) == want and len(want) > 20
    finally:
        dc.HITS = old


def test_shared_openings_stay_within_memory():
    """200 items that open alike, against 400 short texts of that opening and some that hold items."""
    import tracemalloc

    rng = random.Random(10)
    opening = words(rng, 40)
    items = [dc.normal(opening + " " + words(rng, 50)) for _ in range(200)]
    texts = [dc.normal(opening)] * 200 + [dc.normal(words(rng, 3) + " " + opening) for _ in range(200)]
    texts += [items[k] + b" x y" for k in (3, 50, 199)]
    m = dc.Matcher(list(enumerate(items)))
    tracemalloc.start()
    got = m.find(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    plain = {(400, 3), (401, 50), (402, 199)}
    assert {k for k, v in got.items() if v[0] == 0} == plain
    for t in (0, 399, 400):  # the rest of the items is other words, beyond the budget
        for k in range(0, 200, 40):
            least = semi(items[k].decode(), texts[t].decode())
            assert ((t, k) in got) == (least <= dc.budget(len(items[k])))


def test_long_items_are_found_by_windows():
    rng = random.Random(6)
    item = words(rng, 400)
    m = dc.Matcher([(9, w) for w in dc.windows(dc.normal(item))])
    part = item[300:1400]
    assert m.find([dc.normal(words(rng, 50) + " " + part)]) and not m.find([dc.normal(words(rng, 500))])


def test_very_long_text():
    rng = random.Random(11)
    item = dc.normal(words(rng, 40))
    noise = dc.normal(words(rng, 5000))
    m = dc.Matcher([(0, item)])
    text = b" ".join([noise] * 120) + b" " + item + b" " + noise
    (edits, start, end) = m.find([text])[0, 0]
    assert edits == 0 and text[start:end] == item and len(text) > 2 * dc.STRETCH


def test_rows(spark, tmp_path):
    rng = random.Random(7)
    items = [(k, words(rng, 25)) for k in range(6)] + [(6, None), (7, ""), (0, words(rng, 25)), (8, "tiny"), (9, "abc")]
    near = edited(rng, items[2][1], 3)
    rows = [(1, "x " + items[0][1].upper() + "! y"), (1, items[8][1]), (2, None), (3, ""), (None, "Zz, " + items[1][1]), (4, words(rng, 300)), (5, near + "\n" + items[2][1]), (6, "q tiny."), (7, "tinys")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, item_id int, start string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dc.op10_decontamination(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id or -1), r.item_id, r.edits) for r in got) == [(-1, 1, 0), (1, 0, 0), (5, 2, 0), (6, 8, 0)]
    by = {r.doc_id: r for r in got}
    text = dict((i, t) for i, t in rows if i != 1)
    assert text[5][by[5].start : by[5].end] == items[2][1] and text[None][by[None].start : by[None].end] == items[1][1]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert dc.op10_decontamination(spark, f"{tmp_path}/none").count() == 0
