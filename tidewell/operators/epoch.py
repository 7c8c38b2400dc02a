"""Clock epochs: a backward jump of more than half the clock starts the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.samples import HALF, U32
from .rank import chunk_of


def unwrapped(samples: DataFrame, chunk: int | None = None, last: int | None = None, epoch: int = 0) -> DataFrame:
    """samples with epoch_id and ts64, in the order of event_id; `last` and `epoch` are those of an earlier sample that they follow.

    Jumps are counted within chunks of event_id; between chunks, one row per chunk carries the count on.
    """
    jumped = lambda before, now: F.coalesce((before - now > HALF), F.lit(False)).cast("long")
    rows = samples.withColumn("__chunk", chunk_of(samples, "event_id", chunk))
    w = Window.partitionBy("__chunk").orderBy("event_id")
    rows = rows.withColumn("__jump", jumped(F.lag("ts_ms").over(w), F.col("ts_ms")))
    ends = rows.groupBy("__chunk").agg(
        F.min_by("ts_ms", "event_id").alias("first"), F.max_by("ts_ms", "event_id").alias("last"), F.sum("__jump").alias("jumps")
    )
    order = Window.orderBy("__chunk")  # one row per chunk
    cross = jumped(F.coalesce(F.lag("last").over(order), F.lit(last).cast("long")), F.col("first")) + F.coalesce(F.lag("jumps").over(order), F.lit(0))
    base = ends.select("__chunk", cross.alias("cross")).select("__chunk", F.sum("cross").over(order).alias("__base"))
    out = rows.join(base, "__chunk").withColumn("epoch_id", F.lit(epoch) + F.col("__base") + F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("ts64", F.col("epoch_id") * (U32 + 1) + F.col("ts_ms")).drop("__chunk", "__jump", "__base")
