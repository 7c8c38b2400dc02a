"""Segments of 15 blocks: zone maps, pruning, ring retention, reclamation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import numbered

BLOCKS = 15
SEGMENT_BYTES, META_BYTES = 4096, 32768


def capacity(flash_bytes: int) -> int:
    return (flash_bytes - META_BYTES) // SEGMENT_BYTES


def assigned(rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """One row per block of rows (series, blk, event_id, ts64): block_no by last event, segment, page."""
    blocks = rows.groupBy("series", "blk").agg(
        F.max("event_id").alias("last_event_id"), F.count("*").alias("cnt"), F.min("ts64").alias("t_min"), F.max("ts64").alias("t_max")
    )
    out = numbered(blocks, [], "last_event_id", "block_no", chunk)
    segment = F.floor(F.col("block_no") / BLOCKS).cast("long")
    return out.withColumns({"segment_no": segment, "page_no": F.col("block_no") % BLOCKS, "seg_seqno": segment + 1})


def zone_map(blocks: DataFrame) -> DataFrame:
    """One row per segment. Bounds are on the unwrapped clock, so a segment across the wrap is never pruned wrongly."""
    return blocks.groupBy("segment_no").agg(
        F.max("seg_seqno").alias("seg_seqno"),
        F.min("t_min").alias("t_min"),
        F.max("t_max").alias("t_max"),
        F.count("*").alias("block_count"),
        F.sort_array(F.collect_set("series")).alias("series_set"),
    )


def pruned(zones: DataFrame, series: int | None, t0: int, t1: int) -> DataFrame:
    hit = (F.col("t_min") <= t1) & (F.col("t_max") >= t0)
    return zones.where(hit if series is None else hit & F.array_contains("series_set", series))


def pruned_range(rows: DataFrame, zones: DataFrame, series: int, t0: int, t1: int) -> DataFrame:
    """Only files and row groups of candidate segments are read; the row filter decides. Same rows as the plain scan."""
    candidates = pruned(zones, series, t0, t1).select("segment_no")
    low, high = candidates.agg(F.min("segment_no"), F.max("segment_no")).first()  # bounds for the scan
    hit = (F.col("series") == series) & F.col("ts64").between(t0, t1)
    if low is None:
        return rows.where(F.lit(False)).select("event_id", "ts64", "value")
    rows = rows.where(hit & F.col("segment_no").between(low, high))
    return rows.join(candidates, "segment_no", "left_semi").select("event_id", "ts64", "value")


def ring(blocks: DataFrame, capacity: int) -> DataFrame:
    """Blocks of the newest `capacity` segments."""
    newest = blocks.agg(F.max("seg_seqno").alias("newest"))
    floor = F.broadcast(newest)  # one row
    return blocks.join(floor, F.col("seg_seqno") > F.col("newest") - capacity).drop("newest")


def watermarks(zones: DataFrame) -> DataFrame:
    """Free space as each segment fills a ring of exactly as many segments."""
    total = F.broadcast(zones.agg(F.count("*").alias("capacity")))  # one row
    out = zones.join(total, F.col("block_count") > 0).select("segment_no", (F.col("segment_no") + 1).alias("used"), "capacity")
    out = out.withColumn("free", F.col("capacity") - F.col("used"))
    return out.withColumns({"warn": F.col("free") * 100 < 10 * F.col("capacity"), "busy": F.col("free") * 100 < 5 * F.col("capacity")}).drop("capacity")


def victims(zones: DataFrame) -> DataFrame:
    """Oldest segments to reclaim until a tenth of the ring is free again."""
    state = F.broadcast(zones.agg(F.count("*").alias("capacity"), F.min("seg_seqno").alias("tail")))  # one row
    out = zones.join(state, F.col("seg_seqno") >= F.col("tail")).withColumn("victim_rank", F.col("seg_seqno") - F.col("tail") + 1)
    return out.where((F.col("victim_rank") - 1) * 100 < 10 * F.col("capacity")).select("segment_no", "seg_seqno", "victim_rank")


def quota(requests: DataFrame, window_s: int, most: int = 2) -> DataFrame:
    """rc per request (event_id, at_s): the first `most` of each tumbling window pass."""
    w = Window.partitionBy("slot").orderBy("event_id")
    out = requests.withColumn("slot", F.floor(F.col("at_s") / window_s).cast("long"))
    rank = F.row_number().over(w).cast("long")
    return out.select("event_id", "slot", rank.alias("rank_in_window"), F.when(rank <= most, "OK").otherwise("EBUSY").alias("rc"))


def anchored_quota(requests: DataFrame, window_ms: int = 1000, most: int = 2) -> DataFrame:
    """Like quota, but a window starts at the first request at least window_ms after the last start; in order per ring."""

    def run(key, pdf):
        start, used, out = None, 0, []
        for at in pdf.sort_values("event_id")["at_ms"]:
            if start is None or at - start >= window_ms:
                start, used = at, 0
            used += 1
            out.append("OK" if used <= most else "EBUSY")
        return pdf.sort_values("event_id").assign(rc=out)[["ring", "event_id", "rc"]]

    return requests.groupBy("ring").applyInPandas(run, "ring long, event_id long, rc string")
