import os

import duckdb
import pytest

import __spark_entry__
from lexidim import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), con.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_greedy_resolution_equals_the_plain_one(spark):
    from lexidim import lexicons as lx
    from lexidim.operators.scan import Region, resolved

    spans, kept = {}, {}
    for r in core.line_spans(spark, SF).distinct().collect():
        spans.setdefault(r.doc_id, []).append(Region(r.type, r.start, r.end))
    for r in core.resolve.resolved(core.line_spans(spark, SF).distinct(), lx.PRIORITY).collect():
        kept.setdefault(r.doc_id, set()).add((r.type, r.start, r.end))
    assert kept == {d: {r[:3] for r in resolved(x)} for d, x in spans.items()}


def test_entry(spark):
    assert {"type", "n_regions", "n_chars"} == set(__spark_entry__.entry(spark).columns) and __spark_entry__.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/lexidim", f"{tmp_path}/lexidim", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'regions_by_type' in q and 'pipeline' not in q and 'op1_packing' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_blank_texts_are_covered_too(spark, tmp_path):
    import hashlib

    texts = {1: "", 2: " \n ", 3: None, 4: "a 5 mm ", 5: "\n5 mm"}
    spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sha256 for r in core.QUERIES["regions_cover_text"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items() if t is not None}


def test_gaps_beside_equal_spans(spark):
    """Of spans equal but for their type it makes no difference which stands first."""
    from pyspark.sql import functions as F

    spans = [(1, t, s, e) for t, s, e in (("QTY", 0, 5), ("QTY", 10, 20), ("NUM", 10, 20), ("IDX", 10, 20), ("IDX", 30, 40), ("NUM", 30, 40))]
    for rows in (spans, spans[::-1]):
        df = spark.createDataFrame(rows, "doc_id INT, type STRING, start INT, `end` INT")
        found = core.resolve.gaps(df, df.select("doc_id").distinct().withColumn("length", F.lit(50)))
        assert sorted(map(tuple, found.collect())) == [(1, 5, 10), (1, 20, 30), (1, 40, 50)]
