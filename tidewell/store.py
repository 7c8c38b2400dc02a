"""A store of samples as checksummed blocks in a ring of segments, behind a small Python interface.

On disk, under one path: `blocks/batch=N` holds pages (header and payload image, with the few columns that Parquet prunes by),
`segments/batch=N` the footers of sealed segments, `meta/A.bin` and `B.bin` the snapshots. A batch folder counts once its writer
has finished it (`_SUCCESS`); one that was cut off is written over. Pages of a batch are sorted by series and time, so a
range reads only the row groups whose series and times can hold it.

Opening scans the footers, rebuilds the zones of segments without a valid one from their pages, and probes the newest segment page by
page: what follows its first bad page is cut off, and writing goes on in the next segment. Elsewhere a bad page loses
only itself. Values come back as 16-bit steps of their block's range, times exactly. Writes are staged and published by flush(), which
closes the open blocks. One writer at a time: a second one fails when it publishes, and can open anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import codec, epoch, packing, scan, segments
from .operators.rank import numbered
from .plans.samples import SAMPLES, U32
from .sources import io, shared

PAGES = (
    "seg_seqno long, page_no long, block_no long, series int, epoch_id long, t_first long, t_last long, cnt long, first_event_id long, "
    "last_event_id long, header binary, payload binary"
)


class Store:
    """Samples under one path."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = segments.capacity(4 << 20)):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        self._staged: list[tuple] = []
        self._open()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # opening

    def _batches(self, kind: str) -> list[int]:
        """Published batches; what was cut off doesn't count."""
        found = (n for n in shared.names(self.spark, f"{self.path}/{kind}") if n.startswith("batch="))
        return sorted(int(n[6:]) for n in found if shared.exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={n}" for n in self._batches(kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _open(self) -> None:
        """Recovery: footer scan, page scan of segments without a footer, tail probe."""
        self._blocks_written = self._warned = self._busy = self._truncations = 0
        self._next_id, self._epoch, self._last_ts, self._batch = 0, 0, None, 0
        self._head, self._page, self._tail = 1, 0, 1
        batches = self._batches("blocks")
        if not batches:
            return
        self._batch = batches[-1] + 1
        pages = self._read("blocks", PAGES)
        newest = pages.agg(
            F.max("seg_seqno"), F.max("last_event_id"), F.max_by("epoch_id", "last_event_id"), F.max_by(F.col("t_last").bitwiseAND(U32), "last_event_id"), F.min("seg_seqno")
        ).first()
        if newest[0] is None:
            return
        self._next_id, self._epoch, self._last_ts = newest[1] + 1, newest[2], newest[3]
        self._head = newest[0]
        sealed = self._footers().where(F.col("seg_seqno") == self._head).select("block_count").first()
        if sealed:
            self._head, self._page = self._head + 1, 0
        else:
            probe = codec.checked(pages.where(F.col("seg_seqno") == self._head)).select("page_no", "ok").orderBy("page_no").collect()  # 15 pages at most
            valid = next((k for k, r in enumerate(probe) if not r.ok or r.page_no != k), len(probe))
            self._page = valid
            if valid < len(probe):
                self._truncations += valid > 0
                self._seal(self._head, self._head, {self._head: valid})
            if valid < len(probe) or valid == segments.BLOCKS:
                self._head, self._page = self._head + 1, 0
        snapshot = self._saved()
        if snapshot:
            self._epoch = max(self._epoch, snapshot["epoch_id"])
        self._tail = max(newest[4], self._head - self._most_used() + 1)

    def _footers(self) -> DataFrame:
        return codec.read_footers(self._read("segments", "seg_seqno long, footer binary"))

    def zones(self) -> DataFrame:
        """Live segments: seg_seqno, t_min, t_max (unwrapped), block_count, series_set. A segment without a valid footer is summed up from
        its valid pages."""
        footers = self._footers().select("seg_seqno", F.col("block_count").alias("sealed"))
        pages = self._read("blocks", PAGES).where(F.col("seg_seqno") >= self._tail).join(footers, "seg_seqno", "left")
        whole = pages.where("page_no < sealed")
        rest = codec.checked(pages.where("sealed is null")).where("ok").drop("ok")
        return whole.unionByName(rest).groupBy("seg_seqno").agg(
            F.min("t_first").alias("t_min"), F.max("t_last").alias("t_max"), F.count("*").alias("block_count"), F.sort_array(F.collect_set("series")).alias("series_set")
        )

    # writing

    def write(self, series: int, ts_ms: int, value: float) -> None:
        scan.check_series(series)
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("values must be finite")
        self._staged.append((series, ts_ms & U32, float(value), self._next_id + len(self._staged)))

    def append(self, samples: DataFrame) -> None:
        """Publish a DataFrame of samples; its event ids follow those stored."""
        samples = shared.written(scan.accepted(samples).select("series", "ts_ms", "value", "event_id"), "arrived")
        low, high, n = samples.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
        if not n:
            return
        if low < self._next_id:
            raise ValueError(f"event ids must start at {self._next_id}")
        rows = epoch.unwrapped(samples, last=self._last_ts, epoch=self._epoch)
        blocks = packing.greedy_blocks(samples)
        times = blocks.join(rows.select("event_id", "epoch_id", "ts64"), "event_id").groupBy("series", "blk").agg(
            F.min("epoch_id").alias("epoch_id"), F.min("ts64").alias("t_first"), F.max("ts64").alias("t_last"), F.min("event_id").alias("first_event_id")
        )
        images = codec.block_images(codec.with_values(packing.with_deltas(blocks))).join(times, ["series", "blk"])
        done = (self._head - 1) * segments.BLOCKS + self._page
        pages = numbered(images, [], "last_event_id", "n").withColumn("block_no", F.col("n") + done)
        pages = pages.withColumns({"seg_seqno": F.floor(F.col("block_no") / segments.BLOCKS).cast("long") + 1, "page_no": F.col("block_no") % segments.BLOCKS})
        names = [c.split()[0] for c in PAGES.split(", ")]
        place = f"{self.path}/blocks/batch={self._batch}"
        if shared.exists(self.spark, f"{place}/_SUCCESS"):
            raise RuntimeError("another writer has published meanwhile; open the store anew")
        pages.select(*names).repartitionByRange(F.floor(F.col("seg_seqno") / 4096), "series").sortWithinPartitions("series", "t_first").write.mode("overwrite").parquet(place)
        last = self.spark.read.schema(PAGES).parquet(place).agg(
            F.count("*"), F.max_by("epoch_id", "last_event_id"), F.max_by(F.col("t_last").bitwiseAND(U32), "last_event_id")
        ).first()
        before, self._batch = self._head, self._batch + 1
        self._blocks_written += last[0]
        self._next_id, self._epoch, self._last_ts = high + 1, last[1], last[2]
        self._head, self._page = (done + last[0]) // segments.BLOCKS + 1, (done + last[0]) % segments.BLOCKS
        if self._head > before:
            self._seal(before, self._head - 1)
        self._retain(self._head - before)

    def flush(self) -> None:
        if self._staged:
            staged, self._staged = self._staged, []
            self.append(self.spark.createDataFrame(staged, SAMPLES))

    def _seal(self, first: int, last: int, cut: dict[int, int] | None = None) -> None:
        """Write the footers of full segments (and of one that is cut off after so many pages)."""
        pages = self._read("blocks", PAGES).where(F.col("seg_seqno").between(first, last))
        for seg, valid in (cut or {}).items():
            pages = pages.where((F.col("seg_seqno") != seg) | (F.col("page_no") < valid))
        zones = pages.groupBy("seg_seqno").agg(
            F.min(F.col("t_first").bitwiseAND(U32)).alias("t_min"), F.max(F.col("t_last").bitwiseAND(U32)).alias("t_max"), F.count("*").alias("block_count"),
            F.sort_array(F.collect_set("series")).alias("series_set"),
        )
        if cut:  # a segment may keep nothing
            empty = self.spark.createDataFrame([(s, U32, 0, 0, []) for s, v in cut.items() if not v], "seg_seqno long, t_min long, t_max long, block_count long, series_set array<int>")
            zones = zones.unionByName(empty)
        at = max(self._batches("segments"), default=-1) + 1
        codec.packed_footers(zones).write.mode("overwrite").parquet(f"{self.path}/segments/batch={at}")

    def _most_used(self) -> int:
        """Segments in use beyond which the oldest is reclaimed: a tenth of the ring stays free."""
        return max(1, self.capacity - -(-self.capacity // 10))

    def _retain(self, opened: int) -> None:
        """Reclaim the oldest segments, one for each that is opened while less than a tenth of the ring is free."""
        used = self._head - self._tail + 1
        over = min(max(0, used - self._most_used()), opened)
        self._warned += over
        # when a segment is reclaimed, one more than the most is in use
        self._busy += over if (self.capacity - self._most_used() - 1) * 100 < 5 * self.capacity else 0
        self._tail = max(self._tail, self._head - self._most_used() + 1)
        if over:
            ends = self._read("blocks", PAGES).groupBy(F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long").alias("batch")).agg(F.max("seg_seqno").alias("last"))
            for r in ends.where(F.col("last") < self._tail).collect():  # one row a batch
                shared.delete(self.spark, f"{self.path}/blocks/batch={r.batch}")

    def close(self) -> None:
        self.flush()

    # reading

    def blocks(self) -> DataFrame:
        """Live pages: those of the ring that no truncation has cut off."""
        sealed = F.broadcast(self._footers().where(F.col("block_count") < segments.BLOCKS).select("seg_seqno", "block_count"))  # truncated segments, one a recovery at most
        pages = self._read("blocks", PAGES).where(F.col("seg_seqno") >= self._tail)
        return pages.join(sealed, "seg_seqno", "left").where("block_count is null or page_no < block_count").drop("block_count")

    def _decoded(self, pages: DataFrame) -> DataFrame:
        rows = codec.read_images(pages.select(F.col("block_no").alias("blk"), "header", "payload"))
        # blocks hold at most 74 rows, so this goes by write order within a series
        return rows.select("series", "ts_ms", F.col("decoded").alias("value"), (F.col("blk") * 128 + F.col("row_in_blk")).alias("event_id"))

    def samples(self) -> DataFrame:
        return self._decoded(self.blocks())

    def pages_of(self, series: int, t0: int, t1: int) -> DataFrame:
        """Pages that can hold a sample of the range, by columns that Parquet prunes by: payloads of others aren't read."""
        # a block lies in one epoch of the clock; its times are unwrapped, so the window is looked for in every epoch
        turns = [e * (U32 + 1) for e in range(self._epoch + 1)]
        hit = F.lit(False)
        for at in turns:
            hit = hit | ((F.col("t_first") <= at + t1) & (F.col("t_last") >= at + max(t0, 0)))
        return self.blocks().where((F.col("series") == scan.check_series(series)) & hit)

    def query(self, series: int, t0: int, t1: int) -> DataFrame:
        return scan.series_range(self._decoded(self.pages_of(series, t0, t1)), series, t0, t1)

    def rows(self, series: int, t0: int, t1: int) -> Iterator:
        """The rows of a range in the order they were written, one partition at a time."""
        hit = self._decoded(self.pages_of(series, t0, t1)).where(F.col("ts_ms").between(t0, t1))
        yield from hit.orderBy("event_id").select("ts_ms", "value").toLocalIterator()

    def latest(self, series: int):
        """The last sample of the newest good block; newer bad ones are passed over, a few at a time."""
        pages, before, most = self.blocks().where(F.col("series") == scan.check_series(series)), 1 << 62, 4
        while True:
            newest = [r.block_no for r in pages.where(F.col("block_no") < before).select("block_no").orderBy(F.desc("block_no")).limit(most).collect()]
            if not newest:
                return None
            row = scan.latest(self._decoded(pages.where(F.col("block_no").isin(newest))), series).first()
            if row:
                return row.ts_ms, row.value
            before, most = newest[-1], most * 4

    def export_csv(self, series: int, t0: int, t1: int, path: str) -> None:
        io.write_csv(self._decoded(self.pages_of(series, *scan.clamped(t0, t1))), series, t0, t1, path)

    def export_ndjson(self, series: int, t0: int, t1: int, path: str) -> None:
        io.write_ndjson(self._decoded(self.pages_of(series, *scan.clamped(t0, t1))), series, t0, t1, path)

    # state

    def snapshot(self) -> bytes:
        """Save epoch, head, tail and head address to the slot that the head's parity names."""
        address = (self._head - 1) % self.capacity * segments.SEGMENT_BYTES + self._page * 256
        image = codec.pack_snapshot(self._epoch, self._head, self._tail, address)
        shared.put_bytes(self.spark, f"{self.path}/meta/{'A' if self._head % 2 else 'B'}.bin", image.ljust(256, b"\xff"))
        return image

    def _saved(self) -> dict | None:
        """The newest valid snapshot; a blank or damaged slot counts as missing."""
        found = []
        for slot in "AB":
            page = shared.get_bytes(self.spark, f"{self.path}/meta/{slot}.bin")
            if page and not codec.blank(page) and (snapshot := codec.unpack_snapshot(page)):
                found.append((snapshot["seg_seq_head"], slot == "A", snapshot))
        return max(found, key=lambda x: x[:2])[2] if found else None

    def info(self) -> dict:
        """The seven counters. crc_errors are live pages that no scan can use; the other counts are since opening."""
        bad = codec.checked(self.blocks().select("header", "payload")).where(~F.col("ok")).count()
        return {
            "seg_seq_head": self._head, "seg_seq_tail": self._tail, "blocks_written": self._blocks_written, "crc_errors": bad,
            "gc_warn_events": self._warned, "gc_busy_events": self._busy, "recovery_truncations": self._truncations,
        }

    def reset(self) -> None:
        shared.delete(self.spark, self.path)
        self._staged = []
        self._open()
