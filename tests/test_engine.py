"""Goldens, properties and faults of the time-series engine."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions.checksum import checksum
from tidewell.operators import codec, epoch, packing, recovery, scan, segments
from tidewell.operators.rank import numbered
from tidewell.plans.samples import SAMPLES
from tidewell.sources import io


def frame(spark, rows):
    return spark.createDataFrame([(s, t, float(v), i) for i, (s, t, v) in enumerate(rows)], SAMPLES)


def imaged(samples):
    return codec.block_images(codec.with_values(packing.with_deltas(packing.greedy_blocks(samples))))


def test_checksum_vector():
    assert checksum(b"123456789") == 0xF28417BE


def test_golden_export(spark):
    rows = codec.with_values(packing.with_deltas(packing.greedy_blocks(frame(spark, [(5, i * 10, i % 100) for i in range(1000)]))))
    decoded = rows.select(F.lit(5).alias("series"), "ts_ms", F.col("decoded").alias("value"), "event_id")
    lines = [r.line for r in io.csv_lines(decoded, 5, 0, 5000).orderBy(F.split("line", ",")[0].cast("long")).collect()]
    assert len(lines) == 501
    assert lines[:2] == ["0,-0.000556945801", "10,0.999732971"] and lines[-1] == "5000,-0.000755310059"


def test_range_and_latest(spark):
    s = frame(spark, [(1, i * 10, np.sin(0.01 * i)) for i in range(500)])
    assert scan.series_range(s, 1, 100, 2200).count() == 211
    assert scan.latest(s, 1).first().ts_ms == 4990
    assert scan.latest(s, 2).count() == 0
    with pytest.raises(ValueError):
        scan.series_range(s, 256, 0, 1)


def test_latest_is_by_write_order(spark):
    assert scan.latest(frame(spark, [(1, 50, 1), (1, 20, 2)]), 1).first().ts_ms == 20


def test_ingest_rejects(spark):
    s = frame(spark, [(1, 0, 1), (300, 0, 1), (2, 0, float("nan")), (3, 0, float("inf"))])
    assert [r.series for r in scan.accepted(s).collect()] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 70_000), max_size=300))
def test_greedy_invariants(deltas):
    ts = np.cumsum(np.array([1_000_000, *deltas], "i8"))
    blk = packing.closes(ts)
    for b in np.unique(blk):
        d = np.diff(ts[blk == b])
        assert ((d >= 0) & (d <= 65535)).all()
        assert len(d) + 1 <= (packing.WIDE_ROWS if (d > 255).any() else packing.NARROW_ROWS)


def test_greedy_gaps(spark):
    rows = [(1, 0, 0), (1, 300, 0)] + [(1, 300 + 10 * i, 0) for i in range(1, 74)]  # one wide gap
    rows += [(1, 80_000, 0), (1, 79_000, 0)]  # a gap that doesn't fit, a step back
    sizes = [r.n for r in packing.greedy_blocks(frame(spark, rows)).groupBy("blk").agg(F.count("*").alias("n")).orderBy("blk").collect()]
    assert sizes == [56, 19, 1, 1]


def test_images_read_back_and_isolate_faults(spark):
    images = imaged(frame(spark, [(4, i * 10, i) for i in range(222)]))
    good = codec.read_images(images)
    assert good.count() == 222
    flip = F.concat(F.substring("payload", 1, 9), F.unhex(F.lit("00")), F.substring("payload", 11, 214))
    bad_payload = images.withColumn("payload", F.when(F.col("blk") == 1, flip).otherwise(F.col("payload")))
    assert sorted(r.blk for r in codec.read_images(bad_payload).select("blk").distinct().collect()) == [0, 2]
    bad_header = images.withColumn("header", F.when(F.col("blk") == 0, F.unhex(F.lit("FF" * 32))).otherwise(F.col("header")))
    assert codec.read_images(bad_header).count() == 148


class Mapped:
    """Stands for a DataFrame: gives back the function that would run over its Arrow batches."""

    schema = StructType([])

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    groupBy = agg = drop = select

    def mapInArrow(self, run, _):
        return run


def lanes_of(n):
    """An Arrow batch of n blocks of 74 rows, as the encoder gets them."""
    deltas, qvals = np.random.default_rng(n).integers(0, 256, (n, 74)), np.random.default_rng(n).integers(-32768, 32768, (n, 74))
    deltas[:, 0] = 0
    cols = {"series": pa.array([3] * n, pa.int32()), "blk": pa.array(range(n), pa.int64()), "cnt": pa.array([74] * n, pa.int64()), "t0_ms": pa.array([2**32 - 9] * n, pa.int64())}
    cols |= {"dt_bits": pa.array([8] * n, pa.int32()), "bias": pa.array([1.2] * n, pa.float32()), "scale": pa.array([0.005] * n, pa.float32()), "last_event_id": pa.array(range(n), pa.int64())}
    cols |= {"deltas": pa.array(deltas.tolist(), pa.list_(pa.int64())), "qvals": pa.array(qvals.tolist(), pa.list_(pa.int32()))}
    return pa.RecordBatch.from_pydict(cols), deltas, qvals


def peak_of(run, batch):
    """Most memory that Python and NumPy hold while a batch is worked on."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_images_of_a_large_batch_take_no_more_memory(spark):
    encode, decode, check = (f(Mapped(spark)) for f in (codec.block_images, codec.read_images, codec.checked))
    small, large = (lanes_of(n)[0] for n in (2048, 8192))
    pages = [pa.Table.from_batches(encode(iter([b]))).combine_chunks().to_batches()[0] for b in (small, large)]
    assert [p.num_rows for p in pages] == [2048, 8192]
    assert peak_of(encode, large) < 1.5 * peak_of(encode, small)
    assert peak_of(decode, pages[1]) < 1.5 * peak_of(decode, pages[0])
    assert peak_of(check, pages[1]) < 1.5 * peak_of(check, pages[0])


def test_images_of_a_large_batch_read_back(spark):
    batch, deltas, qvals = lanes_of(2500)
    pages = pa.Table.from_batches(codec.block_images(Mapped(spark))(iter([batch])))
    bad = {0: 40, 1024: 40, 1700: 223, 2499: 1}
    payloads = [p[: bad[k]] + bytes([p[bad[k]] ^ 1]) + p[bad[k] + 1 :] if k in bad else p for k, p in enumerate(pages.column("payload").to_pylist())]
    payloads[7] = payloads[7][:-1]  # a page that was cut off
    pages = pages.set_column(pages.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary())).combine_chunks().to_batches()
    kept = [k for k in range(2500) if k not in {*bad, 7}]
    assert np.flatnonzero(pa.Table.from_batches(codec.checked(Mapped(spark))(iter(pages))).column("ok").to_numpy()).tolist() == kept
    rows = pa.Table.from_batches(codec.read_images(Mapped(spark))(iter(pages)))
    got = {n: rows.column(n).to_numpy() for n in rows.schema.names}
    assert got["blk"].tolist() == np.repeat(kept, 74).tolist() and got["row_in_blk"].tolist() == list(range(74)) * len(kept)
    assert (got["series"] == 3).all() and (got["qval"] == qvals[kept].ravel()).all()
    assert (got["ts_ms"] == ((2**32 - 9 + deltas.cumsum(1)) % 2**32)[kept].ravel()).all()
    assert (got["decoded"] == np.float32(1.2) + np.float32(0.005) * qvals[kept].ravel().astype("f4")).all()


def test_quantization_bounds(spark):
    rows = codec.with_values(packing.with_deltas(packing.fixed_blocks(frame(spark, [(1, i, v) for i, v in enumerate([2.5] * 56 + [-1, 1])]))))
    got = {(r.blk, r.qval, r.decoded) for r in rows.collect()}
    assert {g[1:] for g in got if g[0] == 0} == {(0, 2.5)}
    assert {g[1] for g in got if g[0] == 1} == {-32768, 32767}


def test_payload_round_trip():
    d, q = [(i % 5) + 1 for i in range(60)], [i - 30 for i in range(60)]
    a, b = codec.decode_payload(codec.encode_payload(8, d, q), 8, 60)
    assert a.tolist() == d and b.tolist() == q
    with pytest.raises(ValueError):
        codec.encode_payload(16, [0] * 57, [0] * 57)


def test_footer_and_snapshot_images():
    image = codec.pack_footer(7, 1, 2, 15, [0, 9, 255])
    assert len(image) == 56 and codec.unpack_footer(image)["series_set"] == [0, 9, 255]
    assert codec.unpack_footer(image[:21] + b"\x07" + image[22:]) is None
    image = codec.pack_snapshot(1, 9, 2, 4096)
    assert codec.unpack_snapshot(image)["seg_seq_head"] == 9
    assert codec.unpack_snapshot(b"\x00" + image[1:]) is None


def test_epoch_across_chunks(spark):
    ts = [4_294_000_000, 4_294_900_000, 5, 10, 4_200_000_000, 7]
    for chunk in (2, 3, 100):
        got = [r.epoch_id for r in epoch.unwrapped(frame(spark, [(1, t, 0) for t in ts]), chunk).orderBy("event_id").collect()]
        assert got == [0, 0, 1, 1, 1, 2]


def test_wrap_window_is_never_pruned(spark):
    s = epoch.unwrapped(frame(spark, [(1, t, 0) for t in (4294963200, 4294967295, 20, 40)]))
    blocks = segments.assigned(packing.fixed_blocks(s))
    assert segments.pruned(segments.zone_map(blocks), 1, 2**32 + 16, 2**32 + 32).count() == 1


def test_numbering_across_chunks(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("event_id"))
    got = {(r.event_id, r.n) for r in numbered(df, ["k"], "event_id", "n", chunk=7).collect()}
    assert got == {(i, i // 3) for i in range(50)}


def test_prefix_and_ring(spark):
    blocks = spark.range(60).select(
        F.col("id").alias("block_no"), F.floor(F.col("id") / 15).alias("segment_no"), (F.col("id") % 15).alias("page_no"), (F.floor(F.col("id") / 15) + 1).alias("seg_seqno")
    )
    valid = ~F.col("block_no").isin(15, 33)
    assert recovery.prefix(blocks, valid).count() == 15 + 0 + 3 + 15
    assert [r.segment_no for r in recovery.truncations(blocks, valid).collect()] == [2]
    assert recovery.isolated(blocks, valid).count() == 58
    assert segments.ring(blocks, 2).agg(F.min("block_no")).first()[0] == 30


def test_anchored_quota(spark):
    r = spark.createDataFrame([(0, i, t) for i, t in enumerate([900, 950, 1100, 1899, 1900, 1950, 2000])], "ring long, event_id long, at_ms long")
    assert [x.rc for x in segments.anchored_quota(r).orderBy("event_id").collect()] == ["OK", "OK", "EBUSY", "EBUSY", "OK", "OK", "EBUSY"]


def test_capacity():
    assert (segments.capacity(4 << 20), segments.capacity(256 << 10)) == (1016, 56)


def test_single_precision_ramp(spark):
    v = np.float32(25)
    for r in io.generated(spark, 50, accumulate=True).orderBy("ts_ms").collect():
        assert np.float32(r.value) == v
        v = np.float32(v + np.float32(0.1))


def test_commands(spark):
    lines = [("w 3 100 1.5",), ("f",), ("s",), ("l 9",), ("e 2 0 50",), ("w x",), ("q",), ("",)]
    got = spark.createDataFrame(lines, "line string").select(*[c.alias(n) for n, c in io.parsed_commands(F.col("line")).items()]).collect()
    assert [r.rc for r in got] == ["OK"] * 5 + ["ERR"] * 3
    assert (got[0].series, got[0].ts_ms, got[0].value) == (3, 100, 1.5) and got[4].t1_ms == 50


def test_store(spark, tmp_path):
    from tidewell.store import Store

    with Store(spark, str(tmp_path / "s")) as s:
        for i in range(20):
            s.write(1, i * 100, 0.5 * i)
        s.flush()
        assert [r.ts_ms for r in s.rows(1, 0, 1900)] == [i * 100 for i in range(20)]
        ts, value = s.latest(1)
        assert ts == 1900 and abs(value - 9.5) < 1e-3 and s.latest(2) is None  # a 16-bit step of the range 0..9.5
        assert codec.unpack_snapshot(s.snapshot())["seg_seq_head"] == 1
        s.export_ndjson(1, 0, 100, str(tmp_path / "out"))
        assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from tidewell.streaming import ingest

    rng = np.random.default_rng(5)
    ts = np.cumsum(rng.integers(1, 400, 600))
    rows = [(int(i % 3), int(t), float(i)) for i, t in enumerate(ts)]
    all_ = frame(spark, rows)
    for k in range(3):
        all_.filter((F.col("event_id") >= 200 * k) & (F.col("event_id") < 200 * k + 200)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.run(ingest.sample_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    closed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    batch = packing.greedy_blocks(all_)
    last = batch.groupBy("series").agg(F.max("blk").alias("last"))
    expected = {(r.event_id, r.series, r.blk) for r in batch.join(last, "series").filter("blk < last").collect()}
    assert {(r.event_id, r.series, r.blk) for r in closed.collect()} == expected
    assert ingest.open_blocks(all_, closed).count() == 600 - len(expected)
