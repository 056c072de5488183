import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from lexidim.llm import line_dedup


def brute(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(line_dedup.BLANKS))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)], key=rank))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=lambda r: ((r[0] is not None, r[0] or 0), r[1:]))


LONG = ["Àé " + "x" * 40, "b" * 40, "c" * 39, "D e" * 20, "Ñ" * 45, "Ã©" * 30, "short"]


@pytest.fixture
def rows():
    rng = random.Random(4)
    out = [(i, "\n".join(rng.choice([s.upper().replace("À", "À") if rng.random() < 0.1 else s, f"  {s}\t", f"{s}{rng.randint(0, 3)}", ""]) for s in rng.choices(LONG, k=rng.randint(0, 12)))) for i in range(80)]
    return out + [(3, "b" * 40 + "\n" + "b" * 40), (3, "b" * 40), (3, "b" * 40), (None, "b" * 40), (200, None), (201, ""), (202, "\n"), (77, "b" * 40)]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, tmp_path, rows, parts):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_lines int, line string").repartition(parts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert result(line_dedup.op7_line_dedup(spark, str(tmp_path))) == brute(rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert line_dedup.op7_line_dedup(spark, f"{tmp_path}/none").count() == 0


def test_sql_equals_brute_force(rows):
    distinct = [r for r in dict(rows).items() if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", distinct)
    got = con.execute(line_dedup.OP7_SQL).fetchall()
    assert sorted(got) == brute(distinct)


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(i, "q" * 50, i * 2) for i in range(6)], "doc_id long, text string, extra int")
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert {r.extra for r in got.values()} == {0, 2, 4, 6, 8, 10}
    assert [got[i].text for i in range(6)] == [""] * 5 + ["q" * 50]


def test_batches_against_runs(spark):
    runs = line_dedup.LineRuns(4)
    seen = set()
    for k in range(5):
        rows = [(i, i % (k + 7), 0) for i in range(k * 10, k * 10 + 10)]
        batch = spark.createDataFrame(rows, "_id long, _h1 long, _h2 long")
        assert {r._h1 for r in runs.unseen(batch).collect()} == {r[1] for r in rows} - seen
        runs.add(batch)
        seen |= {r[1] for r in rows}
        assert all(len(level) < runs.fanout for level in runs.levels)
    totals = {r._h1: (r.n_docs, r.last) for r in runs.totals().collect()}
    ids = [(i, i % (k + 7)) for k in range(5) for i in range(k * 10, k * 10 + 10)]
    assert totals == {h: (len([i for i, x in ids if x == h]), max(i for i, x in ids if x == h)) for h in seen}


def test_positions_are_cut_in_order(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\n", [0, 2, 4]), ("a", [0]), ("\n", [1])], "t string, p array<int>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(line_dedup.without(F.col("t"), F.col("p"))).collect()] == ["b\nd", "", ""]


def test_each_batch_is_merge_anti_joined_with_the_runs(spark):
    lines = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (3, 6, 0)], "_id long, _h1 long, _h2 long")
    runs = line_dedup.LineRuns(2)
    runs.add(lines)
    assert sorted(r._id for r in line_dedup.held_often(lines, runs.totals(), 2).collect()) == [1, 2]
    docs = spark.createDataFrame([(i, "q" * 50) for i in range(6)], "doc_id long, text string")
    plan = line_dedup.deduplicated(docs)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"SortMergeJoin .*LeftAnti", plan)) == line_dedup.BATCHES
