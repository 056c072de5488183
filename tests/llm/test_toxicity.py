import random
import zlib

import numpy as np

from lexidim.llm import toxicity as tx

PLAIN = "the river runs past old houses where quiet people read long books about distant seas".split()


def make(seed, n=1500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(PLAIN) + rng.choice(["", "s"]) for _ in range(rng.randint(8, 150))]
        if toxic:
            stem = i % 3 == 0
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), "zorbl" + rng.choice(["a", "est", "ung", "ix", "ov"]) if stem else rng.choice(["idiot", "scum", "Worthless", "moron"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_rows(spark, tmp_path):
    rows, labels = make(1)
    extra = [(3, rows[3][1]), (None, "you idiot"), (9000, None), (9001, "")]
    spark.createDataFrame([(i, t, 1, "p") for i, t in rows + extra], "doc_id long, text string, toxic int, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels] + [(labels[0][0], 1, labels[0][1]), (None, 1, 1), (9000, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows) and by[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97
    assert by[9000].predicted == by[9001].predicted == 0 and by[None].predicted == 1


def test_held_out_labels_are_not_read(spark):
    rows, labels = make(2, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = tx.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = tx.fitted(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, toxic int"))
    assert a.weights == b.weights and a.intercept == b.intercept


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot scum"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in tx.scored(docs, tx.fitted(docs, none)).collect()}
    assert scores[1] > scores[2]
    assert tx.scored(docs.limit(0), tx.fitted(docs.limit(0), none)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    yes, no = np.array([0.7, 0.5, 0.6, 0.4]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = rng.random((len(y), 4)) < np.where(y[:, None], yes, no)
    votes = np.column_stack([votes, votes[:, 0] ^ (rng.random(len(y)) < 0.01)])  # nearly the first again
    texts, counts = np.unique(["".join("01"[int(v)] for v in r) for r in votes], return_counts=True)
    start = np.array([0.8 if "1" in t else 0.1 for t in texts])
    known = np.zeros((len(texts), 2))
    blocks = tx.redundant_blocks(list(texts), counts.astype(float))
    assert blocks == [[0, 4], [1], [2], [3]]
    post = tx.LabelModel(blocks).fit(list(texts), counts.astype(float), known, start)
    assert tx.correlated_blocks(list(texts), counts.astype(float), post, blocks) == blocks
    model = tx.LabelModel(blocks)
    post = model.fit(list(texts), counts.astype(float), known, post)
    truth = {t: y[[("".join("01"[int(v)] for v in r)) == t for r in votes[:5000]] + [False] * 15000].mean() for t in ("00000", "11111")}
    assert abs(model.prior - 0.2) < 0.03 and post[list(texts).index("11111")] > 0.95 and abs(post[list(texts).index("00000")] - truth["00000"]) < 0.05
