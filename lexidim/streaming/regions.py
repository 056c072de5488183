"""Regions of a stream of texts: the scan is stateless, counts by window are kept with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidim.plans.engine import FIELDS, Engine


def region_stream(texts: DataFrame, engine: Engine, text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return engine.exploded(texts, text_col, fields)


def counts_by_window(texts: DataFrame, engine: Engine, time_col: str, text_col: str = "text", window: str = "1 hour", late: str = "1 hour", id_col: str | None = None) -> DataFrame:
    """Regions by type in windows of event time; with id_col, repeated events count once."""
    events = texts.withWatermark(time_col, late)
    if id_col:
        events = events.dropDuplicatesWithinWatermark([id_col])
    return engine.exploded(events, text_col, ("type",)).groupBy(F.window(time_col, window), "type").agg(F.count("*").alias("n_regions")).select(F.col("window.start").alias("window_start"), "type", "n_regions")


def written(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives up to the end of what there is, written as Parquet beside its checkpoint in
    a folder that driver and executors share; a run that was stopped goes on from there."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
