import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import similarity_join as sj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, n, num, den):
    sets = [brute_set(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    label[root(a)] = root(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root(k)] = min(first.get(root(k), i), i)
    return [(i, len(s), None if i is None else first[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def corpus(seed, n_groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows, i = [], 0
    for _ in range(n_groups):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 90, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = "\n ".join(copy) if rng.random() < 0.3 else " ".join(copy)
            rows.append((i, (passage + " " + text) if rng.random() < 0.2 else text.upper() if rng.random() < 0.1 else text))
            i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \t"), (i + 4, "One Two"), (i + 5, "one  two"), (3, rows[3][1]), (3, "quite other words stand here"), (None, rows[0][1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,num,den,block,in_task", [(1, 3, 90, 100, 512, 0), (2, 3, 90, 100, 2, 1000), (3, 5, 4, 5, 3, 1000)])
def test_equals_brute_force(spark, monkeypatch, seed, n, num, den, block, in_task):
    monkeypatch.setattr(sj, "LINKS_IN_TASK", in_task)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _n int, _root int").repartition(3)
    got = [(r._id, r._n, r._component) for r in sj.near_duplicates(docs.select("doc_id", "text"), n, num, den, block=block).collect()]
    want = brute(rows, n, num, den)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({c for *_, c in want}) < len(rows) - 5


def test_words_over_stretches():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "é", "long" * 9, "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " ", "x" * 500, "a b"]
    want = sj.shingle_sets(texts, 3)
    for n in (1, 7, 64):
        old, sj.STRETCH = sj.STRETCH, n
        try:
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(sj.shingle_sets(texts, 3), want))
        finally:
            sj.STRETCH = old
    sj.worker_cache().clear()
    assert [len(s) for s in want] == [len(brute_set(t, 3)) for t in texts]


def test_a_text_of_100_mb():
    import resource

    import pyarrow as pa

    part = " ".join(f"w{k % 49_999}" for k in range(160_000)) + " "
    text = part * (100_000_000 // len(part))
    column = pa.array([text], pa.string())
    del text
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((_, (tokens,)),) = sj.sets_in(column, 3)
    assert 49_999 <= len(tokens) < 60_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB


def test_a_large_group_ships_its_sets_a_few_times(spark):
    """Near copies of one text, some of them too far off to link, in blocks far smaller than the group."""
    rng = random.Random(6)
    words, m, shipped = [f"v{k}" for k in range(120)], 600, []
    rows = []
    for i in range(m):
        copy = list(words)
        for _ in range(8 if i % 40 == 0 else 1):
            copy[rng.randrange(len(copy))] = f"x{i}-{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = sj.fragment_overlaps
    try:
        sj.fragment_overlaps = lambda df: old(shipped.append(df.count()) or df)
        got = [(r._id, r._n, r._component) for r in sj.near_duplicates(docs, 3, 90, 100, block=64).collect()]
    finally:
        sj.fragment_overlaps = old
    assert sorted(got) == sorted(brute(rows, 3, 90, 100))
    blocks = 2 * m // 64
    assert sum(shipped) < sj.FRAGMENTS * m * blocks / 2  # each with each would be 4 m times the blocks


def test_query_and_empty_tables(spark, tmp_path):
    rows = corpus(9, 8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sj.op9_ngram_jaccard(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 3, 90, 100), key=key)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sj.op9_ngram_jaccard(spark, f"{tmp_path}/none").count() == 0


def test_one_of_each_stays(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(2)
    got = sj.one_of_each(docs).collect()
    comp = brute(rows, 5, 4, 5)
    free = [(i, t) for (i, t) in rows if i is None or not brute_set(t, 5)]
    kept = {(r.doc_id, r.text) for r in got}
    assert all(f in kept for f in free)
    linked = [r for r in got if (r.doc_id, r.text) not in free]
    components = {c for (i, n, c), (_, t) in zip(comp, rows) if i is not None and n}
    assert {r.doc_id for r in linked} == components and all(c[0] is None or c[2] is not None for c in comp)
    assert docs.columns == sj.one_of_each(docs).columns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=6), st.integers(1, 40))
def test_overlaps(left, right, columns):
    old, sj.COLUMNS = sj.COLUMNS, columns
    try:
        sets = [[np.unique(np.array(x, np.uint64)) for x in side] for side in (left, right)]
        got = sj.overlaps(*sets)
    finally:
        sj.COLUMNS = old
    assert got.tolist() == [[len(set(a) & set(b)) for b in right] for a in left]


@pytest.mark.parametrize("in_task", [0, 1000])
def test_components_of_long_chains(spark, monkeypatch, in_task):
    monkeypatch.setattr(sj, "LINKS_IN_TASK", in_task)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(edges)
    df = spark.createDataFrame([((a, 0), (b, 0)) for a, b in edges], "_a struct<x: long, y: long>, _b struct<x: long, y: long>")
    got = {r._node.x: r._root.x for r in sj.components(df).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 201: 200, 202: 200}
