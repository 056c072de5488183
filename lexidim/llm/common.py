"""What the corpus operators share: tables, checkpoints and Arrow-batched kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexidim.folders import shared_folder

#: Whether a query's exchange files go as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that a kernel holds as Python objects at a time.
SLICE_ROWS = 512
#: Bytes of such a batch's columns, beyond which fewer rows are held at a time.
SLICE_BYTES = 4 << 20
#: Rows of a table that is broadcast after a count.
SMALL_ROWS = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there.

    Exchange files behind the cut are of no more use; Spark removes them as the query ends.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own takes the setting
    finally:
        spark.conf.set(CLEANUP, before)


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else joins deal it out."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gathered(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df as a local table with a broadcast hint if it has at most so many rows, else checkpointed."""
    some = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(some, df.schema)) if len(some) <= rows else checkpointed(df)


def text_mark(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart: a hash of their text; 0 where there is an id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).otherwise(F.lit(0).cast("long"))


def as_one(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with all its columns in one, `_doc`, beside others: so no name of theirs meets ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(c.alias(n) for n, c in columns.items()))


def without_rows(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less the rows that lost names by id and _mark; without an id by the mark alone."""
    gone = lost.select(F.col(id_col).alias("_lost_id"), F.col("_mark").alias("_lost_mark")).distinct()
    marked = as_one(docs, _own_id=F.col(id_col), _own_mark=text_mark(id_col, text_col))
    same = F.col("_own_id").eqNullSafe(F.col("_lost_id")) & (F.col("_own_mark") == F.col("_lost_mark"))
    return marked.join(gone, same, "left_anti").select("_doc.*")


def kind_is(kind: str) -> Callable:
    """Predicate of F.filter over spans; a lambda's default argument would be taken as the index."""
    return lambda span: span["kind"] == kind


_KEPT: dict = {}


def worker_cache() -> dict:
    """What a Python worker keeps from task to task; functions that travel by value keep nothing."""
    return _KEPT


def map_batches(df: DataFrame, columns: list, schema: str, setup: Callable[[], Callable]) -> DataFrame:
    """Run a kernel over slices of df[columns] in Arrow batches.

    setup() is called once a task and returns kernel(*column_lists) -> list of output column
    lists, which may have another number of rows. Columns of df that aren't named never reach
    Python.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = setup()
        for batch in batches:
            for part in slices(batch):
                out = kernel(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by at most SLICE_ROWS rows and about SLICE_BYTES bytes, or single rows that are larger."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, SLICE_ROWS)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = part.slice(0, max(1, part.num_rows // 2))
        at += part.num_rows
        yield part
