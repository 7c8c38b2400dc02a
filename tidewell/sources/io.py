"""Sources and sinks: generated samples, stored tables, text exports, command lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import g9
from ..operators.scan import clamped, series_range

#: Rows of a ramp that one task sums up.
RAMP_ROWS = 1 << 20
#: Fixed value: the patterns of the command lines.
PATTERNS = {"w": r"^w (\d+) (\d+) ([-+.\deE]+)$", "f": r"^f$", "s": r"^s$", "l": r"^l (\d+)$", "e": r"^e (\d+) (\d+) (\d+)$"}


def generated(spark: SparkSession, rows: int, period_ms: int = 100, start: int = 0, accumulate: bool = False) -> DataFrame:
    """Rows of a slow ramp from 25 in steps of 0.1; accumulate: summed in single precision, as a device does."""
    i = F.col("id")
    if not accumulate:
        return spark.range(rows).select((start + i * period_ms).alias("ts_ms"), (F.lit(25.0) + F.lit(0.1) * i).cast("float").alias("value"))
    # single-precision sums depend on all before them: one pass in the driver gives what each chunk starts from
    firsts, value = [], np.float32(25)
    for at in range(0, rows, RAMP_ROWS):
        firsts.append((at, float(value)))
        value = np.cumsum(np.r_[value, np.full(min(RAMP_ROWS, rows - at), 0.1, "f4")], dtype="f4")[-1]

    def ramp(batches):
        import pyarrow as pa

        for b in batches:
            for at, first in zip(*(b.column(n).to_pylist() for n in ("at", "first"))):
                n = min(RAMP_ROWS, rows - at)
                values = np.cumsum(np.r_[np.float32(first), np.full(n - 1, 0.1, "f4")], dtype="f4")
                yield pa.RecordBatch.from_arrays([pa.array(start + period_ms * np.arange(at, at + n)), pa.array(values)], names=["ts_ms", "value"])

    return spark.createDataFrame(firsts, "at long, first float").repartition(max(1, len(firsts))).mapInArrow(ramp, "ts_ms long, value float")


def store(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet laid out for pruning: a folder per series, files sorted by time with their own bounds; a long series takes many files."""
    samples.repartitionByRange("series", "ts_ms").sortWithinPartitions("series", "ts_ms").write.mode(mode).partitionBy("series").parquet(path)


def csv_lines(samples: DataFrame, series: int, t0: int, t1: int) -> DataFrame:
    t0, t1 = clamped(t0, t1)
    return series_range(samples, series, t0, t1).select(F.concat(F.col("ts_ms").cast("string"), F.lit(","), g9(F.col("value"))).alias("line"))


def ndjson_lines(samples: DataFrame, series: int, t0: int, t1: int) -> DataFrame:
    t0, t1 = clamped(t0, t1)
    line = F.concat(F.lit('{"ts_ms":'), F.col("ts_ms").cast("string"), F.lit(',"value":'), g9(F.col("value")), F.lit("}"))
    return series_range(samples, series, t0, t1).select(line.alias("line"))


def write_csv(samples: DataFrame, series: int, t0: int, t1: int, path: str) -> None:
    t0, t1 = clamped(t0, t1)
    series_range(samples, series, t0, t1).select("ts_ms", g9(F.col("value")).alias("value")).write.csv(path, header=True)


def write_ndjson(samples: DataFrame, series: int, t0: int, t1: int, path: str) -> None:
    ndjson_lines(samples, series, t0, t1).write.text(path)


def parsed_commands(line: Column) -> dict[str, Column]:
    """verb, series, ts_ms, t1, value, rc of a command line; lines that fit no pattern are errors."""
    verb = F.substring(line, 1, 1)
    fits = F.coalesce(*[F.when(verb == v, line.rlike(p)) for v, p in PATTERNS.items()], F.lit(False))
    group = lambda v, k, kind: F.when(fits & (verb == v), F.regexp_extract(line, PATTERNS[v], k).cast(kind))
    return {
        "verb": verb,
        "series": F.coalesce(group("w", 1, "int"), group("l", 1, "int"), group("e", 1, "int")),
        "ts_ms": F.coalesce(group("w", 2, "long"), group("e", 2, "long")),
        "t1_ms": group("e", 3, "long"),
        "value": group("w", 3, "float"),
        "rc": F.when(fits, "OK").otherwise("ERR"),
    }
