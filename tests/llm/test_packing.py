import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def filled(counts, limit):
    """Checks the places of a plan; gives the number of sequences."""
    seqs, seen = {}, {n: set() for n in counts}
    for length, low, high, first, offset in packing.plan(counts, limit):
        for r in range(low, high):
            assert r not in seen[length]
            seen[length].add(r)
            seqs.setdefault(first + r - low, []).append((offset, length))
    assert all(seen[n] == set(range(c)) for n, c in counts.items())
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(seqs)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_every_piece_has_one_gapless_place(counts):
    n = filled(counts, 30)
    total = sum(a * c for a, c in counts.items())
    # never worse than twice the least number, which any best fit keeps to
    assert -(-total // 30) <= n <= max(1, 2 * -(-total // 30)) or not counts


def test_exact_complements_fill_bins():
    assert filled({20: 5, 10: 5}, 30) == 5
    assert filled({17: 3, 8: 3, 5: 3}, 30) == 3
    assert filled({14: 2, 9: 2, 4: 2, 3: 2}, 30) == 2
    assert filled({15: 4, 10: 6}, 30) == 4


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    small = {n: rng.randint(0, 50) for n in range(1, 2049)}
    large = {n: c * 1_000_000 for n, c in small.items()}
    a, b = packing.plan(small), packing.plan(large)
    assert len(b) < 3 * len(a) + 2048
    total = sum(n * c for n, c in large.items())
    assert a and max(first + high - low for _, low, high, first, _ in b) <= 1.05 * total / 2048


texts = st.lists(st.sampled_from(["the", "don't", "é", "\n", " ", "  ", "\t", "x" * 60, "12", " ", "!?", "<|endoftext|>", "日本", "\n\n", "Ünïcode", "aʰb", "x...", "½y!", "\u0301z", "Ⅷ", "ªº,"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(texts.map(" ".join) | texts.map("".join))
def test_word_cache_gives_the_tokenizers_ids(text):
    e = packing.Encoder(PATH)
    assert e.by_words
    for _ in range(2):  # from the tokenizer, then from the cache
        assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


@pytest.mark.parametrize("parts", [1, 3])
def test_rows(spark, tmp_path, parts):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 10, 300, 900, 5000])))) for i in range(60)]
    rows += [(7, "same"), (7, "same"), (900, None), (901, ""), (None, "z")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, offset int").repartition(parts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op1_packing(spark, str(tmp_path)).collect()
    tok = packing.Encoder(PATH).tokenizer
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts_ in seqs.values():
        at = 0
        for offset, length in sorted(parts_):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 2
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert packing.op1_packing(spark, f"{tmp_path}/none").count() == 0


def test_round_trip_of_sequences(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 50) for i in range(40)], "doc_id long, text string")
    got = packing.sequences(packing.packed(packing.tokenized(docs, PATH))).collect()
    tok = packing.Encoder(PATH).tokenizer
    texts = [tok.decode(list(p)) for r in got for p in _split(np.frombuffer(r.ids, "<u4"))]
    assert sorted(texts) == sorted(f"word {i} " * 50 for i in range(40))


def _split(ids):
    at = 0
    for end in np.flatnonzero(ids == 0):
        yield ids[at:end]
        at = end + 1
