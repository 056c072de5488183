import random
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lexidim.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "\xa0", "#", " ", "\n", "\r", "\x0b", "\x1c", "long", "<|>"]), max_size=60).map(lambda x: " ".join(x)) | st.text(max_size=40))
def test_base_counts_equal_brute_force(text):
    assert qr.statistics(text)[:6] == brute(text)


def mcd_step(x, mean, inverse, h):
    d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    near = x[np.argsort(d)[: int(h * len(x))]]
    cov = np.cov(near.T, bias=True) * qr.consistency(h, x.shape[1]) + np.diag([f * f for f in qr.FLOORS.values()])
    return near.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def plain_mcd(x, h=qr.H):
    """The least determinant over the same starts, each stepped on until it stands still."""
    floor = np.array(list(qr.FLOORS.values())) ** 2
    q = np.quantile(x, [0.25, 0.45, 0.5, 0.55, 0.75], axis=0, method="inverted_cdf")
    found = []
    for m, v in [(q[2], ((q[4] - q[0]) / 1.349) ** 2), (x.mean(0), x.var(0)), (q[2], ((q[3] - q[1]) / 0.2513) ** 2)]:
        last, now = np.inf, (m, np.diag(1 / (v + floor)), 1e9)
        while now[2] < last - 1e-9:
            last = now[2]
            now = mcd_step(x, now[0], now[1], h)
        found.append(now)
    return min(found, key=lambda e: e[2])


def test_consistency_factor():
    x = np.random.default_rng(0).normal(size=(200_000, 6))
    d = (x**2).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert abs(qr.consistency(0.75, 6) * near.var(0).mean() - 1) < 0.01


def make(rng, bad):
    words = [rng.choice("thing other words stand here in some order of theirs quite plainly".split()) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(70, 400))]
    if bad:
        words = [w + rng.choice(["###", "|", "$$"]) for w in words]
    return " ".join(words).capitalize()


def test_estimates_equal_plain_steps(spark):
    rng = random.Random(3)
    rows = [(i, make(rng, i % 9 == 0), "en", f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    table = qr.with_stratum(qr.described(docs, "doc_id", "text", "lang", "source"))
    got = {r._own: r for r in qr.estimates(table).collect()}
    assert set(got) == {"en\x1fs0", "en\x1fs1"}
    for s in (0, 1):
        stats = [qr.statistics(t) for _, t, _, x in rows if x == f"s{s}"]
        x = np.array([v[6:] for v in stats if not v[5]])
        mean, inverse, det = plain_mcd(x)
        own = got[f"en\x1fs{s}"]
        far = lambda m, i: np.einsum("ij,jk,ik->i", x - m, i, x - m)
        a, b = far(np.array(own._mean), np.array(own._inverse).reshape(6, 6)), far(mean, inverse)
        limit = qr.CUTOFF * qr.chi_square_quantile(qr.QUANTILE, 6)
        assert ((a > limit) == (b > limit)).all() and np.quantile(np.abs(a - b) / (1 + b), 0.99) < 0.2
        assert abs(own._det - det) < 0.1


def test_least_determinant_wins_over_a_bad_start(spark):
    """Two clusters: the median start of one coordinate lies between them, the least determinant in one."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.05, (800, 6)), rng.normal(3, 0.6, (200, 6))])
    rows = spark.createDataFrame([("s", False, *map(float, r)) for r in x], "_own string, base_failed boolean, " + ", ".join(f"_{c} double" for c in qr.NAMES))
    (got,) = qr.estimates(rows).collect()
    assert np.abs(np.array(got._mean)).max() < 0.1 and abs(got._det - plain_mcd(x)[2]) < 0.1


def test_quantiles():
    x = (np.random.default_rng(1).normal(size=(200_000, 6)) ** 2).sum(1)
    assert abs(qr.chi_square_quantile(0.99, 6) - np.quantile(x, 0.99)) < 0.2


def test_very_long_text():
    n, *_, failed = qr.statistics("one two three four five six. " * 300_000)[:6]
    assert n == 1_800_000 and failed


def test_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, make(rng, i in (5, 77)), rng.choice(["en", "de"]), "s") for i in range(300)]
    rows += [(9, rows[9][1], "en", "s"), (400, None, "en", "s"), (401, "", None, None), (None, make(rng, False), None, "s"), (402, "x y z " * 40, "en", None)]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, lang string, source string, distance double, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = qr.op3_quality_rules(spark, str(tmp_path)).toPandas()
    want = pd.DataFrame([(i, *brute(t)) for i, t, *_ in rows], columns=["doc_id", *qr.COUNTS, "base_failed"])
    order = ["doc_id", *qr.COUNTS]
    pd.testing.assert_frame_equal(got[want.columns].sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)
    rejected = set(got[~got.kept & ~got.base_failed].doc_id)
    assert rejected == {5, 77} and not got[got.base_failed].kept.any()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert qr.op3_quality_rules(spark, f"{tmp_path}/none").count() == 0
