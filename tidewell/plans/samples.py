"""The relations every plan starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32 = 4294967295
HALF = 2147483648
SERIES_LIMIT = 256

SAMPLES = T.StructType(
    [
        T.StructField("series", T.IntegerType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.FloatType()),
        T.StructField("event_id", T.LongType()),
    ]
)

#: Series of the one-second tick relation, by event type.
TICK_SERIES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Millisecond samples: one series per low byte of the user, a clock that wraps at 32 bits."""
    return events(spark, sf_dir).select(
        F.col("user_id").bitwiseAND(SERIES_LIMIT - 1).cast("int").alias("series"),
        F.unix_millis(F.col("ts").cast("timestamp")).bitwiseAND(U32).alias("ts_ms"),
        F.col("value").cast("float").alias("value"),
        "event_id",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second ticks: one series per event type."""
    code = F.create_map(*[F.lit(x) for pair in TICK_SERIES.items() for x in pair])
    return events(spark, sf_dir).select(
        code[F.col("event_type")].cast("int").alias("series"),
        F.unix_seconds(F.col("ts").cast("timestamp")).bitwiseAND(U32).alias("ts_ms"),
        F.col("value").cast("float").alias("value"),
        "event_id",
    )
