"""Scans of few files: their rows go to all cores, and each text of a batch is scanned once."""

import os

import pyarrow as pa
import pytest
from pyspark import SparkConf

from lexidim import queries as core
from lexidim.plans import engine as en
from lexidim.plans import sql as lexi_sql

SF = "/root/testdata/sf0.001"
#: Queries that scan texts of one file.
DEALT = [
    "unit_only_scan",
    "preprocess_parts",
    "unit_composition_scan",
    "idx_norm_scan",
    "regions_by_type_parts",
    "op_scan",
    "sql_functions",
    "unit_letter_ambiguity",
    "const_scan",
    "sym_definition",
    "qty_uncertainty",
    "qty_range",
    "sym_scan",
    "num_kinds_scan",
    "qty_render_a",
    "ref_scan",
    "llm_messages",
    "qty_render_b",
    "qty_scan_part",
]
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def is_dealt(df) -> bool:
    return "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", DEALT)
def test_rows_of_one_file_are_dealt(spark, name):
    assert is_dealt(core.QUERIES[name](spark, SF))


@tables
def test_a_stream_of_one_file_is_dealt(spark):
    assert len(core.QUERIES["stream_regions"](spark, SF).inputFiles()) > 1


def test_rows_of_many_files_and_of_none_stay(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k} mm",) for k in range(64)], "text STRING")
    rows.repartition(32).write.parquet(f"{tmp_path}/many")
    assert not is_dealt(en.dealt(rows)) and not is_dealt(en.dealt(spark.read.parquet(f"{tmp_path}/many")))
    assert [r.text for r in en.Engine().preprocess(rows).select("text").collect()] == [f"{k} mm" for k in range(64)]


def test_large_tables_go_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(f"{k} mm",) for k in range(2000)], "text STRING").coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    assert en.dealt(df).rdd.getNumPartitions() == en._TASKS * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(en, "_BYTES", 100)
    assert en.dealt(df).rdd.getNumPartitions() == en._bytes_read(df) // 100 > 16
    assert sorted(r.text for r in en.dealt(df).collect()) == sorted(r.text for r in df.collect())


#: Queries on files that are as many as the tasks of the two cores that Spark counts before executors come.
EARLY = [
    "preprocess_parts",
    "regions_by_type_parts",
    "sym_definition",
    "qty_render_a",
    "llm_messages",
]


def before_executors_come(spark, monkeypatch, **settings):
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 2))
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda _: SparkConf(False).setAll([(f"spark.{k}", v) for k, v in settings.items()]))


@tables
@pytest.mark.parametrize("name", EARLY)
def test_rows_are_dealt_over_executors_that_are_yet_to_come(spark, tmp_path, monkeypatch, name):
    spark.read.parquet(f"{SF}/part.parquet").repartition(8).write.parquet(f"{tmp_path}/part.parquet")
    rows = sorted(map(tuple, core.QUERIES[name](spark, SF).collect()))
    before_executors_come(spark, monkeypatch, **{"executor.instances": "3", "executor.cores": "4"})
    df = core.QUERIES[name](spark, str(tmp_path))
    assert f"RoundRobinPartitioning({en._TASKS * 12})" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == rows


def test_cores_asked_for_count(spark, monkeypatch):
    sc = spark.sparkContext
    for settings, cores in (({}, 2), ({"executor.instances": "3"}, 3), ({"cores.max": "20"}, 20), ({"executor.instances": "1", "executor.cores": "1"}, 2)):
        with monkeypatch.context() as m:
            before_executors_come(spark, m, **settings)
            assert en._cores(sc) == cores
            m.setattr(sc, "master", "local-cluster[3, 4,10240]")
            assert en._cores(sc) == max(12, int(settings.get("cores.max", 0)))


def test_each_text_of_a_batch_is_scanned_once(monkeypatch):
    seen = []
    monkeypatch.setattr(en, "regions", lambda t, *rest: seen.append(t) or [])
    texts = pa.array(["a", None, "b", "a", "", "a", None])
    made = en.each_distinct(texts, lambda t: [{"type": t}] if en.regions(t) == [] else None, pa.list_(pa.struct([("type", pa.string())])))
    assert seen == ["a", "b", ""]
    assert made.to_pylist() == [None if t is None else [{"type": t}] for t in texts.to_pylist()]


def test_repeated_texts_give_the_same_as_each_alone(spark):
    texts = ["viga com 5 kN", "nada", "", None, "NBR 6118 e 7 foobar/m", "viga com 5 kN", "nada", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, text STRING").coalesce(1)
    one = lambda frame: {r.k: r[1:] for r in frame.collect()}
    alone = df.repartition(8, "k")
    for of in (lambda d: en.Engine().regions(d).select("k", "regions"), lambda d: en.Engine().preprocess(d).select("k", "preprocessed", "preprocessed_errors")):
        assert one(of(df)) == one(of(alone))


def test_units_are_read_once():
    from lexidim import units
    from lexidim.operators import render

    for atoms in (None, {"m": ((0, 1, 0, 0, 0, 0, 0), 3.0, "si")}):  # an own table isn't mixed up with another
        for _ in range(2):
            assert render.quantities("5 m/foo", atoms)[0].dim is None and render.quantities("2 m", atoms)[0].si_value == (2.0 if atoms is None else 6.0)
            with pytest.raises(units.UnitError):
                render.quantities("?", atoms)
    assert {"m/foo", "m"} <= set(render._UNITS) and "?" not in render._UNITS


def test_regions_in_sql_go_with_their_row(spark):
    lexi_sql.register(spark)
    spark.createDataFrame([(1, "5 m e 6 kg"), (2, None), (3, ""), (4, "5 m e 6 kg")], "k INT, text STRING").createOrReplaceTempView("texts")
    df = spark.sql("SELECT k, r.* FROM texts, LATERAL lexi_regions(text) r WHERE r.type = 'QTY'")
    assert df.columns == ["k", "type", "start", "end", "content", "tag"]
    assert sorted((r.k, r.start, r.end, r.content) for r in df.collect()) == [(k, *x) for k in (1, 4) for x in ((0, 3, "5 m"), (6, 10, "6 kg"))]
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()  # batches, not a call for each row
