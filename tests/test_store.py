"""The block store: round trips, reopening, damage, retention, commands; packing over chunks; live flushes."""

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.operators import codec, packing
from tidewell.operators.rank import chunk_of, numbered
from tidewell.plans.samples import SAMPLES
from tidewell.store import Store


def frame(spark, rows, first=0):
    return spark.createDataFrame([(s, t, float(v), first + i) for i, (s, t, v) in enumerate(rows)], SAMPLES)


def stored(store, series):
    return [(r.ts_ms, round(r.value, 2)) for r in store.rows(series, 0, 2**32 - 1)]


def damage(path, block_no, column="payload"):
    """Flip a byte of one stored page."""
    for f in Path(path).glob("blocks/batch=*/*.parquet"):
        table = pq.ParquetFile(f).read()
        if block_no in (numbers := table.column("block_no").to_pylist()):
            images = table.column(column).to_pylist()
            k = numbers.index(block_no)
            images[k] = images[k][:5] + bytes([images[k][5] ^ 1]) + images[k][6:]
            at = table.schema.get_field_index(column)
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
            pq.write_table(table.set_column(at, table.schema.field(at), [images]), f)
            return
    raise AssertionError("no such page")


def test_write_reopen_write(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, path) as s:
        assert s.latest(1) is None and s.info()["seg_seq_head"] == 1 and list(s.rows(1, 0, 10)) == []
        assert codec.unpack_snapshot(s.snapshot())["seg_seq_tail"] == 1 and s.zones().count() == 0
        for i in range(3):
            s.write(1, i * 1000, i)
    with Store(spark, path) as s:
        assert s.latest(1)[0] == 2000
        s.write(1, 4000, 4.0)
        s.flush()
        assert s.latest(1)[0] == 4000 and [r.ts_ms for r in s.query(1, 0, 9999).orderBy("ts_ms").collect()] == [0, 1000, 2000, 4000]
        assert s.info()["blocks_written"] == 1
        with pytest.raises(ValueError):
            s.append(frame(spark, [(1, 5, 5)]))  # ids that aren't new
    with pytest.raises(ValueError):
        Store(spark, path).write(256, 0, 0)


def test_golden_export_through_the_store(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.append(frame(spark, [(5, i * 10, i % 100) for i in range(1000)]))
        s.export_csv(5, 0, 5000, str(tmp_path / "csv"))
        lines = sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).collect(), key=lambda r: int(r.ts_ms))
        assert len(lines) == 501 and s.info()["blocks_written"] == 14
        assert [tuple(lines[k]) for k in (0, 1, -1)] == [("0", "-0.000556945801"), ("10", "0.999732971"), ("5000", "-0.000755310059")]


def test_bad_pages_and_reopening(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(4, i * 10, i) for i in range(74 * 40)]  # 40 blocks: two sealed segments and ten pages of a third
    with Store(spark, path) as s:
        s.append(frame(spark, rows))
        assert s.info() == {"seg_seq_head": 3, "seg_seq_tail": 1, "blocks_written": 40, "crc_errors": 0, "gc_warn_events": 0, "gc_busy_events": 0, "recovery_truncations": 0}
        assert [(r.seg_seqno, r.block_count) for r in s.zones().orderBy("seg_seqno").collect()] == [(1, 15), (2, 15), (3, 10)]
    damage(path, 3)  # in a sealed segment: loses only itself
    damage(path, 20, "header")
    damage(path, 36)  # seventh page of the open segment: cuts off what follows
    with Store(spark, path) as s:
        live = [b for b in range(40) if b not in (3, 20) and b < 36]
        want = [(t, round(v, 2)) for k, (_, t, v) in enumerate(rows) if k // 74 in live]
        got = stored(s, 4)
        assert [t for t, _ in got] == [t for t, _ in want] and all(abs(a[1] - b[1]) < 0.01 for a, b in zip(got, want))
        info = s.info()
        assert (info["crc_errors"], info["recovery_truncations"], info["seg_seq_head"]) == (2, 1, 4)
        assert s.latest(4)[0] == (36 * 74 - 1) * 10
        s.write(4, 10**6, 1.0)
        s.flush()
        assert s.latest(4) == (10**6, 1.0)
    with Store(spark, path) as s:
        assert s.latest(4)[0] == 10**6 and s.info()["recovery_truncations"] == 0 and len(stored(s, 4)) == len(want) + 1
        damage(path, 45)
        assert Store(spark, path).latest(4)[0] == (36 * 74 - 1) * 10  # the newest page is bad, so it is passed over


def test_lost_footers_and_cut_off_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, path) as s:
        s.append(frame(spark, [(i % 3, i * 10, i) for i in range(74 * 45)]))
        zones = {tuple(map(str, r)) for r in s.zones().collect()}
        head = s.info()["seg_seq_head"]
    for f in Path(path).glob("segments/batch=*/*.parquet"):
        table = pq.ParquetFile(f).read()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        pq.write_table(table.set_column(1, "footer", [[b"\0" * 56] * len(table)]), f)
    s = Store(spark, path)
    assert {tuple(map(str, r)) for r in s.zones().collect()} == zones and s.info()["seg_seq_head"] == head
    cut = Path(path) / "blocks" / "batch=1"  # a writer was stopped before it finished
    cut.mkdir()
    (cut / "part-0.parquet").write_bytes(b"PAR1 torn")
    s = Store(spark, path)
    assert s.samples().count() == 74 * 45
    s.write(1, 10**6, 1.0)
    s.flush()
    assert s.samples().count() == 74 * 45 + 1


def test_the_clock_wraps(spark, tmp_path):
    path, top = str(tmp_path / "s"), 2**32
    with Store(spark, path) as s:
        for t in (top - 3000, top - 1000, 500, 2500):
            s.write(1, t % top, t % 1000)
    with Store(spark, path) as s:
        for t in (top - 2000, 100):  # once more round
            s.write(1, t, 0.0)
        s.flush()
        zone = s.zones().first()
        assert (zone.t_min, zone.t_max) == (top - 3000, 2 * top + 100)
        assert sorted(r.ts_ms for r in s.query(1, 0, 1000).collect()) == [100, 500]
        assert codec.unpack_snapshot(s.snapshot())["epoch_id"] == 2 and s.latest(1)[0] == 100


def test_the_ring_drops_its_oldest_segments(spark, tmp_path):
    path = str(tmp_path / "s")
    s, n = Store(spark, path, capacity=10), 0
    for _ in range(4):
        rows = [(2, (n + i) * 10, n + i) for i in range(74 * 60)]  # four segments
        s.append(frame(spark, rows, n))
        n += len(rows)
    info = s.info()
    assert (info["seg_seq_head"], info["seg_seq_tail"], info["gc_warn_events"], info["gc_busy_events"]) == (17, 9, 8, 8)
    assert s.blocks().agg(F.min("seg_seqno"), F.count("*")).first()[:] == (9, 8 * 15)
    assert stored(s, 2)[0][0] == 8 * 15 * 74 * 10 and len(list(Path(path).glob("blocks/batch=*"))) == 2
    again = Store(spark, path, capacity=10)
    assert stored(again, 2) == stored(s, 2) and again.latest(2) == s.latest(2)


def test_a_range_reads_few_row_groups(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(frame(spark, [(i % 7, i * 10, i) for i in range(7000)]))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = s.pages_of(3, 100, 900)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(series,3)" in plan and "LessThanOrEqual(t_first,900)" in plan and "GreaterThanOrEqual(t_last,100)" in plan


def test_snapshot_slots(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, path) as s:
        s.write(1, 1, 1)
        s.flush()
        image = s.snapshot()
        slot = Path(path) / "meta" / "A.bin"
        assert slot.read_bytes()[: len(image)] == image and s._saved()["seg_seq_head"] == 1
        slot.write_bytes(b"\xff" * 256)
        Path(str(slot.parent / ".A.bin.crc")).unlink(missing_ok=True)
        assert s._saved() is None  # an erased page
    df = spark.createDataFrame([(b"\xff" * 256,), (b"\xff" * 255 + b"\0",)], "page binary")
    assert [r.blank for r in df.select(codec.is_blank(F.col("page")).alias("blank")).collect()] == [True, False]


@pytest.mark.parametrize("kind", ["phase", "mixed", "gaps"])
def test_greedy_blocks_over_many_chunks(spark, kind):
    rng = np.random.default_rng(5)
    deltas = {"phase": np.full(1500, 7), "mixed": rng.choice([1, 9, 255, 256, 900], 1500, p=[0.5, 0.3, 0.15, 0.04, 0.01]), "gaps": rng.choice([5, 300, 70_000, -4], 1500, p=[0.7, 0.2, 0.05, 0.05])}
    rows = [(s, 10**6 + int(t), 0) for s in (1, 2) for t in np.cumsum(deltas[kind] + (s == 2))]
    df = frame(spark, rows)
    want = {s: packing.closes(np.array([t for k, t, _ in rows if k == s])) for s in (1, 2)}
    got = packing.greedy_blocks(df, chunk_rows=100).orderBy("event_id").collect()
    assert {s: [r.blk for r in got if r.series == s] for s in (1, 2)} == {s: b.tolist() for s, b in want.items()}


def test_block_ends_follow_the_budget():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ts = np.cumsum(rng.choice([1, 200, 256, 65535, 65536, -1], rng.integers(1, 200), p=[0.6, 0.3, 0.06, 0.02, 0.01, 0.01]))
        blk, count, wide, want = 0, 1, False, [0]
        for d in np.diff(ts):
            now = wide or d > 255
            if d < 0 or d > 65535 or (count + 1) * (4 if now else 3) > packing.PAYLOAD:
                blk, count, wide = blk + 1, 1, False
            else:
                count, wide = count + 1, now
            want.append(blk)
        assert packing.closes(ts).tolist() == want


def test_numbering_of_sparse_ids(spark):
    rng = np.random.default_rng(0)
    ids = np.unique(rng.integers(-(2**62), 2**62, 3000))
    df = spark.createDataFrame([(int(i), int(k % 3)) for k, i in enumerate(rng.permutation(ids))], "event_id long, k long")
    want = Counter()
    rank = {}
    for i, k in sorted((r.event_id, r.k) for r in df.collect()):
        rank[i] = want[k]
        want[k] += 1
    assert {r.event_id: r.n for r in numbered(df, ["k"], "event_id", "n").collect()} == rank
    assert df.select(chunk_of(df, "event_id", None).alias("c")).distinct().count() < 5


def test_commands_act_on_a_store(spark, tmp_path):
    from tidewell.streaming.dispatch import Dispatcher

    with Store(spark, str(tmp_path / "s")) as s:
        d = Dispatcher(s)
        lines = ["w 1 0 2.5", "w 1 10 2.5", "l 1", "f", "l 1", "w 1 20 2.5", "w 999 5 1", "bad", "e 1 0 100", "e 1", "s", "w 2 7 1"]
        df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string").repartition(3)
        assert list(d.act(df)) == [
            (2, "OK 0 0.000000"), (3, "OK"), (4, "OK 10 2.500000"), (7, "ERR"), (8, "0,2.5"), (8, "10,2.5"), (8, "END"), (9, "ERR"), (10, "OK"),
        ]
        assert d.replies(df).where("reply = 'OK'").count() == 10 and codec.unpack_snapshot((Path(s.path) / "meta/A.bin").read_bytes())["seg_seq_head"] == 1
        assert list(d.act(spark.createDataFrame([(0, "f"), (1, "l 2"), (2, "l 1")], "line_no long, line string"))) == [(0, "OK"), (1, "OK 7 1.000000"), (2, "OK 20 2.500000")]


class State:
    """What the builder needs of a group's state."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.get, self.timeout = False, False, None, None

    def update(self, value):
        self.exists, self.get, self.timeout = True, value, None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_a_timer_closes_open_blocks():
    import pandas as pd

    from tidewell.streaming import ingest

    state = State()
    arrive = lambda ids: [pd.DataFrame({"series": 1, "ts_ms": [i * 10 for i in ids], "value": 1.0, "event_id": ids})]
    assert list(ingest._build((1,), arrive([0, 1, 2]), state, 500)) == [] and state.timeout == 500
    state.hasTimedOut = True
    closed = list(ingest._build((1,), iter([]), state, 500))
    assert [len(c) for c in closed] == [3] and state.timeout is None
    assert list(ingest._build((1,), iter([]), state, 500)) == []  # nothing is open
    state.hasTimedOut = False
    (block,) = ingest._build((1,), arrive(list(range(3, 80))), state, 500)
    assert block["blk"].tolist() == [1] * 74 and block["event_id"].iloc[0] == 3


def test_live_counters_and_retention(spark, tmp_path):
    from tidewell.streaming import ingest

    for k in range(4):  # 20 blocks of one series each
        frame(spark, [(1, (k * 1480 + i) * 10, i) for i in range(1480)], k * 1480).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.run(ingest.sample_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "cp"), retain_segments=2).awaitTermination(200)
    now = ingest.counters(spark, out)
    assert now == {"blocks_written": 79, "rows_written": 79 * 74, "seg_seq_head": 6, "batches": 4}
    kept = spark.read.parquet(*[str(p) for p in Path(out).glob("batch=*")])
    assert [p.name for p in Path(out).glob("batch=*")] == ["batch=3"] and kept.agg(F.min("seg_seqno")).first()[0] == 4  # the others end at 4 at most
    assert kept.where("row_in_blk = 0").groupBy("seg_seqno").count().where("count > 15").count() == 0
