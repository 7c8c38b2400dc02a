"""Reads: ranges, full scans, latest samples, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.serial import in_range
from ..plans.samples import SERIES_LIMIT


def check_series(series: int) -> int:
    if not 0 <= series < SERIES_LIMIT:
        raise ValueError(f"series {series} is outside 0..{SERIES_LIMIT - 1}")
    return series


def result_code(series: Column) -> Column:
    return F.when(series.between(0, SERIES_LIMIT - 1), "OK").otherwise("EINVAL")


def accepted(samples: DataFrame) -> DataFrame:
    """Samples with a valid series and a finite value."""
    value = F.col("value")
    return samples.filter((result_code(F.col("series")) == "OK") & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def series_range(samples: DataFrame, series: int, t0: int, t1: int) -> DataFrame:
    """Both bounds included; an inverted window is empty."""
    return samples.where((F.col("series") == check_series(series)) & F.col("ts_ms").between(t0, t1)).select("ts_ms", "value")


def wrap_range(samples: DataFrame, t0: int, t1: int, series: int | None = None) -> DataFrame:
    out = samples.where(in_range(F.col("ts_ms"), t0, t1))
    return out if series is None else out.where(F.col("series") == check_series(series))


def full_scan(samples: DataFrame, series: int) -> DataFrame:
    return samples.where(F.col("series") == check_series(series)).select("ts_ms", "value")


def clamped(t0: int, t1: int) -> tuple[int, int]:
    return t0, max(t0, t1)


def latest(samples: DataFrame, series: int | None = None) -> DataFrame:
    """The sample written last in each series; partial maxima, no sort. Empty for a series without samples."""
    rows = samples if series is None else samples.where(F.col("series") == check_series(series))
    last = F.max_by(F.struct("ts_ms", "value"), "event_id")
    return rows.groupBy("series").agg(last.alias("last")).select("series", "last.ts_ms", "last.value")
