"""Samples into blocks: fixed, greedy, and by runs of one series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.samples import U32
from .rank import numbered

PAYLOAD = 224
WIDE_ROWS, NARROW_ROWS = PAYLOAD // 4, PAYLOAD // 3  # 56 and 74
#: Rows of a series that a task packs at a time.
CHUNK_ROWS = 1 << 16


def fixed_blocks(samples: DataFrame, rows: int = WIDE_ROWS, chunk: int | None = None) -> DataFrame:
    """samples with blk: so many rows of a series each."""
    return numbered(samples, ["series"], "event_id", "__rn", chunk).withColumn("blk", F.floor(F.col("__rn") / rows).cast("long")).drop("__rn")


def run_blocks(samples: DataFrame, rows: int = WIDE_ROWS, chunk: int | None = None) -> DataFrame:
    """samples with run and blk as one builder gives them: a change of series closes the block.

    A run is found by numbering all rows and the rows of each series: within a run both grow alike.
    """
    df = numbered(numbered(samples, [], "event_id", "__all", chunk), ["series"], "event_id", "__own", chunk).withColumn("__gap", F.col("__all") - F.col("__own"))
    w = Window.partitionBy("series", "__gap").orderBy("event_id")
    at = F.row_number().over(w).cast("long") - 1
    start = F.min("event_id").over(Window.partitionBy("series", "__gap"))
    return df.withColumn("run_start", start).withColumn("blk", F.floor(at / rows).cast("long")).drop("__all", "__own", "__gap")


def block_ends(ts: np.ndarray) -> np.ndarray:
    """For every row the end (first row of the next block) of a block that starts there.

    Narrow (8-bit) deltas take 3 bytes a row, wide ones 4, once a block is wide; a block ends before it would
    overflow, and where a delta is negative or over 65535. So only the next wide delta and the next that fits no lane count.
    """
    n = len(ts)
    rows, delta = np.arange(n), np.diff(ts)
    never = n + NARROW_ROWS

    def following(marks: np.ndarray) -> np.ndarray:
        """The first marked row after each row."""
        at = np.flatnonzero(marks) + 1
        return np.append(at, never)[np.searchsorted(at, rows, "right")]

    wide, cut = following(delta > 255), following((delta < 0) | (delta > 65535))
    end = np.where(wide - rows < WIDE_ROWS, rows + WIDE_ROWS, np.minimum(wide, rows + NARROW_ROWS))
    return np.minimum(end, cut)


def closes(ts: np.ndarray) -> np.ndarray:
    """Greedy blocks of one series: block numbers of its timestamps."""
    ends, starts, at = block_ends(ts).tolist(), [], 0
    while at < len(ts):
        starts.append(at)
        at = ends[at]
    return np.searchsorted(starts, np.arange(len(ts)), "right") - 1


def greedy_blocks(samples: DataFrame, chunk: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """samples with blk.

    A series is cut into chunks of rows. The first block of a chunk can start at any of its first 74 rows; for each of these
    a task follows the blocks through the chunk (and what its last block needs of the next one), which gives the row of
    the next chunk where they go on and how many they are. These maps, one row a chunk, are composed along the series; then every chunk
    numbers its own rows. The rows are shuffled once.
    """
    ship(samples.sparkSession)
    ahead = NARROW_ROWS + 1
    rows = numbered(samples.select("series", "ts_ms", "value", "event_id"), ["series"], "event_id", "rn", chunk)
    own = F.floor(F.col("rn") / chunk_rows).cast("long")
    rows = rows.withColumn("part", F.explode(F.when((F.col("rn") % chunk_rows < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))

    def ends_of(table, part):
        """The chunk in order, its own rows, and the ends of blocks that start in them."""
        table = table.sort_by("rn")
        n = int((table.column("rn").to_numpy() < (part + 1) * chunk_rows).sum())
        return table, n, block_ends(table.column("ts_ms").to_numpy())

    def walk(key, table):
        import pyarrow as pa

        series, part = (k.as_py() for k in key)
        _, n, ends = ends_of(table, part)
        at, blocks = np.arange(NARROW_ROWS), np.zeros(NARROW_ROWS, "i8")
        while (on := np.flatnonzero(at < n)).size:
            at[on] = ends[at[on]]
            blocks[on] += 1
        return pa.table({"series": pa.array([series], pa.int32()), "part": [part], "next": [np.maximum(at - n, 0).tolist()], "blocks": [blocks.tolist()]})

    def composed(table):
        import pyarrow as pa

        table = table.sort_by("part")
        entry, before, out = 0, 0, []
        for following, blocks in zip(table.column("next").to_pylist(), table.column("blocks").to_pylist()):
            out.append((entry, before))
            entry, before = following[entry], before + blocks[entry]
        first, count = zip(*out)
        return pa.table({"series": table.column("series"), "part": table.column("part"), "entry": pa.array(first, pa.int64()), "before": pa.array(count, pa.int64())})

    def number(key, table, entries):
        import pyarrow as pa

        table, n, ends = ends_of(table, key[1].as_py())
        at, before = entries.column("entry")[0].as_py(), entries.column("before")[0].as_py()
        ends, starts = ends.tolist(), []
        while at < n:
            starts.append(at)
            at = ends[at]
        blk = before - 1 + np.searchsorted(starts, np.arange(n), "right")
        return table.select(["series", "ts_ms", "value", "event_id"]).slice(0, n).append_column("blk", pa.array(blk, pa.int64()))

    maps = rows.groupBy("series", "part").applyInArrow(walk, "series int, part long, next array<long>, blocks array<long>")
    entries = maps.groupBy("series").applyInArrow(composed, "series int, part long, entry long, before long")
    return rows.groupBy("series", "part").cogroup(entries.groupBy("series", "part")).applyInArrow(number, "series int, ts_ms long, value float, event_id long, blk long")


def with_deltas(blocks: DataFrame) -> DataFrame:
    """Rows with row_in_blk and delta (0 for the first row of a block)."""
    w = Window.partitionBy("series", "blk").orderBy("event_id")
    delta = (F.col("ts_ms") - F.lag("ts_ms").over(w)).bitwiseAND(U32)
    return blocks.withColumns({"row_in_blk": F.row_number().over(w).cast("long") - 1, "delta": F.coalesce(delta, F.lit(0).cast("long"))})


def undeltaed(rows: DataFrame) -> DataFrame:
    """ts_ms rebuilt from a block's first time and the running sum of its deltas."""
    w = Window.partitionBy("series", "blk").orderBy("row_in_blk")
    t0 = F.first("t0_ms").over(w)
    total = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("decoded_ts_ms", (t0 + total).bitwiseAND(U32))
