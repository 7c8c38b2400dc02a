"""Row numbers and running sums without an unpartitioned window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers at a time.
CHUNK = 1 << 20


def chunk_of(df: DataFrame, order: str, chunk: int | None) -> Column:
    """Chunk of a row by its integer id. `chunk` is how many ids a chunk spans; where ids may have gaps, it is None and the span is
    taken from the table's least and greatest id and its rows, so there are about as many chunks as rows / CHUNK."""
    if chunk:
        return F.floor(F.col(order) / chunk).cast("long")
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    span = (float(high) - float(low) + 1) * CHUNK / n if n else 1.0
    # rounding keeps the order, and each id falls into one chunk
    return F.floor((F.col(order).cast("double") - float(low or 0)) / max(span, 1.0)).cast("long")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, chunk: int | None = None) -> DataFrame:
    """df with a zero-based row number per key in the order of an integer id.

    Rows are numbered within chunks of the id; what chunks hold is summed over one row per chunk.
    """
    df = df.withColumn("__chunk", chunk_of(df, order, chunk))
    within = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(order)).cast("long") - 1
    sizes = df.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = df.withColumn("__within", within).join(offsets, [*keys, "__chunk"])
    return out.withColumn(name, F.col("__within") + F.col("__before")).drop("__chunk", "__within", "__before")
