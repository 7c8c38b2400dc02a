"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, by application. Where the session names none, a local one will do only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tidewell/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Take a file or folder out of whatever store holds it."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, place = _place(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get_bytes(spark: SparkSession, path: str) -> bytes | None:
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    source = fs.open(place)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()
