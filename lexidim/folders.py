"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that spark.checkpoint.dir names.

    Only where neither that setting nor a checkpoint folder exists, and Spark runs on one machine
    (tests), is a temporary folder taken.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or (sc.master or "").startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexidim-checkpoint-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared ones."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of a text that the driver has."""
    fs, place = _file_system(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Give the only part file of a written folder a name, and remove the folder."""
    fs, place = _file_system(spark, folder)
    parts = [s.getPath() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))]
    target = _file_system(spark, path)[1]
    fs.delete(target, False)
    if parts:
        fs.rename(parts[0], target)
    else:
        fs.create(target, True).close()
    fs.delete(place, True)
