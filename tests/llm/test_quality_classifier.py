import random

import numpy as np

from lexidim.llm import quality_classifier as qc

GOOD = "the quick brown fox jumps over lazy dogs while other people read quiet books near old rivers".split()


def text(rng, good):
    words = [rng.choice(GOOD) for _ in range(rng.randint(30, 200))]
    if not good:
        kind = rng.randint(0, 2)
        words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
    return " ".join(words).capitalize() + ("." if good else "")


def make(seed, n=900, labelled=0.5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.85
        t = text(rng, good)
        rows.append((i, t, rng.choice(["en", "de", None]), f"s{i % 3}", len(t)))
        labels.append((i, int(good)))
    return rows, labels, [x for x in labels if rng.random() < labelled]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def test_held_out_accuracy(spark, tmp_path):
    rows, truth, known = make(1)
    rows += [(3, rows[3][1], "en", "s", 4), (None, rows[4][1], None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0)]
    spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in known] + [(known[0][0], None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = qc.op2_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept, seen = {r.doc_id: r.kept for r in got}, {i for i, _ in known}
    unseen = [(i, q) for i, q in truth if i not in seen]
    assert sum(kept[i] == bool(q) for i, q in unseen) / len(unseen) > 0.97
    assert all(kept[i] for i, q in truth if q)


def test_no_labels_and_no_rows(spark, tmp_path):
    rows, _, _ = make(2, 20)
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = qc.judged(docs, none).collect()
    assert all(r.kept and r.score == 0.5 for r in got) and len(got) == 20
    assert qc.judged(docs.limit(0), none).count() == 0
    assert qc.kept_documents(docs, none).columns == docs.columns and qc.kept_documents(docs, none).count() == 20


def test_newton_equals_plain_regression(spark):
    rows, truth, known = make(3, 300, 1.0)
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    table = qc.described(docs, "doc_id", "text", "lang", "source", "n_chars").join(spark.createDataFrame(known, "_id long, _label int"), "_id")
    from pyspark.sql import functions as F

    table = table.withColumn("_held", F.lit(False))
    got = qc._newton([(table, lambda c, m, y, h: (c, y.astype(float), np.ones(len(y))), None)], qc.N_CONTENT + 1, np.zeros(qc.N_CONTENT + 1), 6, qc.RIDGE)
    x = np.array([[1.0, *qc.content_view(r[1])] for r in rows])
    y = np.array([q for _, q in truth], float)
    beta, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [qc.RIDGE] * (x.shape[1] - 1))
    for _ in range(6):
        p = qc.sigmoid(x @ beta)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * beta)
        beta -= move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
    assert np.allclose(got, beta, atol=1e-6)


def test_metadata_matrix():
    rows = [("en", "web", 1000), (None, None, None), ("de", "web", -5), ("en", "web", 1 << 40)]
    x = qc.metadata_matrix([np.array(qc.metadata_view(*r), float).tobytes() for r in rows])
    assert x.shape == (4, qc.N_METADATA + 1) and (x[:, 3:].sum(axis=1) == 4).all() and (x[:, 0] == 1).all()
    assert (x[0, 3:19] == x[2, 3:19]).all() and (x[0] != x[1]).any() and x[3, -1] == 1


def test_very_long_text():
    good = qc.content_view("the quick brown fox jumps over lazy dogs. " * 250_000)
    assert len(good) == qc.N_CONTENT and all(np.isfinite(good))
