import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "r", "st", "l") for c in ("a", "e", "i", "o", "um")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    items = [sentence(rng, 30) for _ in range(4)]
    line = sentence(rng, 14)
    rows, labels = [], []
    for i in range(260):
        text = "\n".join(sentence(rng, rng.randint(10, 40)) for _ in range(rng.randint(2, 6)))
        bad = i % 8 == 0
        if bad:
            text = " ".join(w.upper() + "!!###" for w in text.split())
        elif i % 50 == 1:
            text += "\n" + items[i % 4]
        elif i % 10 == 3:
            text += "\n" + line
        elif i % 20 == 7:
            text = rows[i - 1][1] + " " + rng.choice(WORDS)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        if i % 3 != 1:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, line


def test_each_stage_takes_effect(spark, folder):
    path, rows, line = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == COLUMNS
    rejected, deduped, joined, clean, packed = seen
    assert set(rejected) == {r[0] for r in rows if r[0] % 8 or r[0] >= 700}
    holders = [i for i, r in rejected.items() if line in (r.text or "")]
    assert [i for i, r in deduped.items() if line in r.text] == [max(holders)] and len(deduped) == len(rejected)
    assert all(r.n_chars == len(r.text) for r in deduped.values())
    near = {r[0] for r in rows if r[0] % 20 == 7 and (r[0] - 1) in rejected and r[0] < 700 and r[0] % 50 != 1 and r[0] % 10 != 3}
    assert near and not near & set(joined) and set(deduped) - set(joined) <= near
    leaked = {r[0] for r in rows if r[0] % 50 == 1 and r[0] % 8 and r[0] < 700}
    assert set(joined) - set(clean) == leaked & set(joined)
    assert set(packed) == set(clean)


def test_run_and_registration(spark, folder):
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100


def test_rows_without_an_id_are_judged_by_their_own_text(spark, folder):
    path, rows, _ = folder
    items = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rng = random.Random(2)
    good = ["\n".join(sentence(rng, 25) for _ in range(4)) for _ in range(3)]
    bad = " ".join(w.upper() + "!!###" for w in sentence(rng, 90).split())
    texts = [good[0], good[1] + "\n" + items[0], good[2] + "\n" + items[0], bad, None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    anonymous = spark.createDataFrame([(None, t, "en", "s0", len(t or "")) for t in texts], schema)
    docs = spark.read.parquet(f"{path}/documents.parquet").unionByName(anonymous)
    kept = corpus_pipeline.quality_classifier(spark, docs, path)
    left = sorted(r.text or "" for r in kept.where("doc_id IS NULL").collect())
    assert left == sorted(t or "" for t in texts if t != bad)
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == {r[0] for r in rows if r[0] % 8 or r[0] >= 700}
    clean = corpus_pipeline.benchmark_decontamination(spark, anonymous, path)
    assert clean.columns == COLUMNS and sorted(r.text or "" for r in clean.collect()) == sorted(["", good[0], bad])
    from lexidim.llm.decontamination import contaminated

    assert contaminated(anonymous, spark.read.parquet(f"{path}/benchmark.parquet")).count() == 2


def test_empty_tables_repeated_rows_and_clashing_columns(spark, folder, tmp_path):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    twice = docs.where("doc_id < 20").withColumn("_id", docs["lang"]).withColumn("_mark", docs["n_chars"])
    twice = twice.unionByName(twice)
    from pyspark.sql import functions as F

    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, twice, path)
        assert out.columns == twice.columns
        n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert set(n.values()) == ({1} if name == "ngram_jaccard_join" else {2})
    assert corpus_pipeline.best_fit_packing(spark, twice, path).select("doc_id").distinct().count() == 20
