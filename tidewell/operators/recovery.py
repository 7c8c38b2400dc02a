"""Recovery: valid prefixes, isolation of bad blocks, snapshots, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(blocks: DataFrame, valid: Column) -> DataFrame:
    """Blocks before the first invalid page of their segment."""
    w = Window.partitionBy("segment_no").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("__ok", F.min(valid.cast("int")).over(w)).where("__ok = 1").drop("__ok")


def truncations(blocks: DataFrame, valid: Column) -> DataFrame:
    """Segments cut after at least one valid page: segment_no, valid_pages."""
    first_bad = F.min(F.when(~valid, F.col("page_no")))
    return blocks.groupBy("segment_no").agg(first_bad.alias("valid_pages")).where("valid_pages > 0")


def isolated(blocks: DataFrame, valid: Column) -> DataFrame:
    """All blocks but the bad ones themselves."""
    return blocks.where(valid)


def snapshot(retained: DataFrame, epochs: DataFrame) -> DataFrame:
    """One row: epoch, head, tail, and the slot that the head's parity names."""
    ends = retained.agg(F.max("seg_seqno").alias("seg_seq_head"), F.min("seg_seqno").alias("seg_seq_tail"))
    epoch = epochs.agg(F.max("epoch_id").alias("epoch_id"))
    slot = F.when(F.col("seg_seq_head") % 2 == 1, "A").otherwise("B")
    return epoch.join(ends, F.lit(True)).select(slot.alias("slot"), "epoch_id", "seg_seq_head", "seg_seq_tail")


def select_snapshot(candidates: DataFrame) -> DataFrame:
    """The valid one with the greatest head; of equals, slot A."""
    return candidates.where("valid").orderBy(F.desc("seg_seq_head"), "slot").limit(1)
