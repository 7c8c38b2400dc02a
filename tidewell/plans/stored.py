"""Blocks and segments of the events, laid out once per application and read by all plans that start from them.

`rows` are the samples on the unwrapped clock with their block and segment, in files by range of segments, sorted by segment, series and
time, so Parquet's own bounds prune them; `blocks` has a row per block, `zones` one per segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import epoch, packing, segments
from ..operators.rank import CHUNK
from ..sources import shared
from .samples import samples


@dataclass
class Stored:
    rows: DataFrame
    blocks: DataFrame
    zones: DataFrame


_built: dict[tuple[str, str], Stored] = {}


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build(spark, sf_dir)
    return _built[key]


def build(spark: SparkSession, sf_dir: str) -> Stored:
    rows = packing.fixed_blocks(epoch.unwrapped(samples(spark, sf_dir), CHUNK), chunk=CHUNK)
    blocks = shared.written(segments.assigned(rows, CHUNK), "blocks")
    rows = rows.join(blocks.select("series", "blk", "block_no", "segment_no", "page_no"), ["series", "blk"])
    rows = shared.written(rows.repartitionByRange("segment_no").sortWithinPartitions("segment_no", "series", "ts64"), "rows")
    return Stored(rows, blocks, shared.written(segments.zone_map(blocks), "zones"))
