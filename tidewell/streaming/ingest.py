"""Live ingest: the block builder as keyed state of a streaming query.

Every series keeps its open block (times and values) and the last time seen. Samples that arrive extend it; blocks that
close are emitted. State lives in the checkpoint, so a restart goes on where the last commit ended. With `flush_ms`, a block
that has been open for that long without a sample is closed by a timer; `open_blocks` packs what a finished input leaves open.

`run` publishes a folder per batch with its blocks' segments, counts what it sees, and keeps the newest segments only, as a ring does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shipping import ship
from ..operators import segments
from ..operators.packing import PAYLOAD
from ..operators.rank import numbered
from ..operators.scan import accepted
from ..plans.samples import HALF, SAMPLES
from ..sources import shared

ROWS = "series int, blk long, row_in_blk long, event_id long, ts_ms long, value float, epoch_id long"
STATE = "blk long, wide boolean, epoch long, last long, ids array<long>, times array<long>, values array<float>, epochs array<long>"


def sample_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Samples as they arrive in a folder of Parquet files; max_files limits a trigger's intake."""
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", max_files).parquet(path)


def _build(key, batches: Iterator[pd.DataFrame], state: GroupState, flush_ms: int | None = None) -> Iterator[pd.DataFrame]:
    series = int(key[0])
    blk, wide, epoch, last, ids, times, values, epochs = state.get if state.exists else (0, False, 0, -1, [], [], [], [])
    ids, times, values, epochs = list(ids), list(times), list(values), list(epochs)
    out = []

    def close():
        nonlocal blk, wide, ids, times, values, epochs
        out.append(
            pd.DataFrame({"series": series, "blk": blk, "row_in_blk": range(len(ids)), "event_id": ids, "ts_ms": times, "value": values, "epoch_id": epochs})
        )
        blk, wide, ids, times, values, epochs = blk + 1, False, [], [], [], []

    if state.hasTimedOut:
        if ids:
            close()
        state.update((blk, wide, epoch, last, ids, times, values, epochs))
        yield from out
        return
    arrived = pd.concat(list(batches)).sort_values("event_id")
    for event_id, ts, value in zip(arrived["event_id"], arrived["ts_ms"], arrived["value"]):
        epoch += int(last - ts > HALF)
        if ids:
            delta = ts - times[-1]
            now = wide or delta > 255
            if delta < 0 or delta > 65535 or (len(ids) + 1) * (4 if now else 3) > PAYLOAD:
                close()
            else:
                wide = now
        ids.append(int(event_id))
        times.append(int(ts))
        values.append(float(value))
        epochs.append(epoch)
        last = int(ts)
    state.update((blk, wide, epoch, last, ids, times, values, epochs))
    if flush_ms and ids:
        state.setTimeoutDuration(flush_ms)
    yield from out


def packed_stream(samples: DataFrame, flush_ms: int | None = None) -> DataFrame:
    """Rows of closed blocks of a streaming relation of samples."""
    ship(samples.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_ms else GroupStateTimeout.NoTimeout
    return accepted(samples).groupBy("series").applyInPandasWithState(partial(_build, flush_ms=flush_ms), ROWS, STATE, "append", timeout)


def open_blocks(samples: DataFrame, closed: DataFrame) -> DataFrame:
    """Samples that no closed block holds yet."""
    return samples.join(closed.select("event_id"), "event_id", "left_anti")


def run(samples: DataFrame, path: str, checkpoint: str, retain_segments: int | None = None, every: str | None = None, flush_ms: int | None = None):
    """Write closed blocks, a folder per batch, each replaced as a whole if its batch is run again; beside it the counters so far.
    With retain_segments, folders go once all their segments are older than so many."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        so_far = counters(spark, path, batch_id - 1)
        rows = shared.written(batch, "closed")
        blocks = rows.groupBy("series", "blk").agg(F.max("event_id").alias("last_event_id"))
        blocks = numbered(blocks, [], "last_event_id", "block_no").withColumn("block_no", F.col("block_no") + so_far["blocks_written"])
        blocks = blocks.withColumn("seg_seqno", F.floor(F.col("block_no") / segments.BLOCKS).cast("long") + 1)
        seen = Observation(f"batch-{batch_id}")
        out = rows.join(blocks.select("series", "blk", "block_no", "seg_seqno"), ["series", "blk"])
        last = F.when(F.col("row_in_blk") == 0, 1)  # one a block
        out = out.observe(seen, F.count(last).alias("blocks"), F.count("*").alias("rows"), F.max("seg_seqno").alias("head"))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        got = seen.get
        now = {
            "blocks_written": so_far["blocks_written"] + got["blocks"], "rows_written": so_far["rows_written"] + got["rows"],
            "seg_seq_head": got["head"] or so_far["seg_seq_head"], "batches": so_far["batches"] + 1,
        }
        shared.put_bytes(spark, f"{path}/_counters/{batch_id}.json", json.dumps(now).encode())
        if retain_segments:
            for old in shared.names(spark, path):
                k = int(old[6:]) if old.startswith("batch=") else batch_id
                if k < batch_id and counters(spark, path, k)["seg_seq_head"] <= now["seg_seq_head"] - retain_segments:
                    shared.delete(spark, f"{path}/{old}")

    stream = packed_stream(samples, flush_ms).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def counters(spark: SparkSession, path: str, batch_id: int | None = None) -> dict:
    """What had been published after a batch (the last one unless named)."""
    found = [int(n[:-5]) for n in shared.names(spark, f"{path}/_counters") if n.endswith(".json")]
    found = [n for n in found if batch_id is None or n <= batch_id]
    if not found:
        return {"blocks_written": 0, "rows_written": 0, "seg_seq_head": 0, "batches": 0}
    return json.loads(shared.get_bytes(spark, f"{path}/_counters/{max(found)}.json"))


def commands(lines: DataFrame) -> DataFrame:
    """Parsed command lines of a text stream (column `value`)."""
    from ..sources.io import parsed_commands

    return lines.select(*[c.alias(n) for n, c in parsed_commands(F.col("value")).items()])
