"""Named queries over the driver's tables, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import codec, epoch, packing, recovery, scan, segments
from .operators.rank import CHUNK
from .plans.samples import events, samples, ticks
from .plans.stored import stored
from .sources import io

RING, BAD_EVERY, QUOTA_S = 8, 37, 600


def _valid():
    return F.col("block_no") % BAD_EVERY != 0


# the event ids of these tables have no gaps, so CHUNK of them are a chunk


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return packing.with_deltas(packing.fixed_blocks(samples(spark, d), chunk=CHUNK))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).blocks


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).zones


def _tick_rows(spark: SparkSession, d: str) -> DataFrame:
    return packing.fixed_blocks(ticks(spark, d), chunk=CHUNK).withColumn("ts64", F.col("ts_ms"))


def _greedy(spark: SparkSession, d: str) -> DataFrame:
    return packing.with_deltas(packing.greedy_blocks(ticks(spark, d), CHUNK))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return codec.block_images(codec.with_values(_greedy(spark, d)))


def ingest_validate(spark, d):
    codes = spark.read.parquet(f"{d}/orders.parquet").select(scan.result_code(F.col("o_custkey")).alias("rc"))
    return codes.groupBy("rc").agg(F.count("*").alias("n"))


def range_limit(spark, d):
    hit = samples(spark, d).where((F.col("series") == 7) & F.col("ts_ms").between(0, 2_000_000_000))
    return hit.orderBy("event_id").limit(10).select("event_id", "ts_ms", "value")


def epoch_unwrap(spark, d):
    return epoch.unwrapped(samples(spark, d), CHUNK).groupBy("epoch_id").agg(F.count("*").alias("n"))


def block_pack_runs(spark, d):
    return packing.run_blocks(samples(spark, d), chunk=CHUNK).select("event_id", "series", "run_start", "blk")


def delta_decode(spark, d):
    w = Window.partitionBy("series", "blk")
    rows = _fixed(spark, d).withColumn("t0_ms", F.min_by("ts_ms", "row_in_blk").over(w))
    return packing.undeltaed(rows).select("event_id", "ts_ms", "decoded_ts_ms")


def roundtrip_error(spark, d):
    rows = codec.with_values(_fixed(spark, d))
    ratio = F.abs(F.col("decoded").cast("double") - F.col("value").cast("double")) / F.col("scale").cast("double")
    return rows.select(ratio.alias("r")).agg(F.count("*").alias("n"), F.count_if(F.col("r") <= 0.5).alias("within_half"), F.round(F.max("r"), 6).alias("worst"))


def block_sizes(spark, d):
    used = (F.col("cnt") * (F.col("dt_bits") / 8 + 2)).cast("long")
    return codec.headers(_fixed(spark, d)).select(
        "series", "blk", used.alias("used_bytes"), (packing.PAYLOAD - used).alias("slack_bytes"), F.round(F.lit(256.0) / (10.0 * F.col("cnt")), 6).alias("ratio")
    )


def payload_roundtrip(spark, d):
    return codec.read_images(_images(spark, d)).select("series", "blk", "row_in_blk", "ts_ms", "qval")


def header_roundtrip(spark, d):
    def fields(batches):
        import pyarrow as pa

        for b in codec.sliced(batches):
            got = [h or {} for h in codec.unpack_headers(b.column("header").to_pylist())]  # a damaged header has no fields
            names, kinds = ("series", "cnt", "t0_ms", "dt_bits", "bias", "scale"), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.float32())
            yield pa.RecordBatch.from_arrays([b.column("blk"), *(pa.array([g.get(n) for g in got], k) for n, k in zip(names, kinds))], names=["blk", *names])

    return _images(spark, d).select("blk", "header").mapInArrow(fields, "blk long, series int, cnt long, t0_ms long, dt_bits int, bias float, scale float")


def zone_map(spark, d):
    return _zones(spark, d).select("segment_no", "seg_seqno", "t_min", "t_max", "block_count", F.size("series_set").cast("long").alias("n_series"))


def zone_prune(spark, d):
    return segments.pruned(_zones(spark, d), 7, 3_000_000_000, 3_500_000_000).select("segment_no", "seg_seqno")


def zone_prune_time(spark, d):
    zones = segments.zone_map(segments.assigned(_tick_rows(spark, d), CHUNK))
    return segments.pruned(zones, None, 1_705_276_800, 1_705_363_199).select("segment_no", "seg_seqno")


def range_query_pruned(spark, d):
    return segments.pruned_range(stored(spark, d).rows, _zones(spark, d), 7, 3_000_000_000, 3_500_000_000)


def gc_quota(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return segments.quota(events(spark, d).select("event_id", at.alias("at_s")), QUOTA_S)


def recovery_prefix(spark, d):
    kept = recovery.prefix(_blocks(spark, d), _valid()).select("segment_no", "page_no")
    return stored(spark, d).rows.join(kept, ["segment_no", "page_no"], "left_semi").select("event_id", "segment_no", "ts_ms")


def crc_isolation(spark, d):
    return recovery.isolated(stored(spark, d).rows, _valid()).select("event_id", "segment_no", "ts_ms")


def crc_error_count(spark, d):
    bad = F.count_if(~_valid()).alias("crc_errors")
    return _blocks(spark, d).groupBy("series").agg(bad)


def snapshot_row(spark, d):
    return recovery.snapshot(segments.ring(_blocks(spark, d), RING), stored(spark, d).rows)


def snapshot_select(spark, d):
    rows = [("A", 1, 7, True), ("B", 1, 9, False), ("B", 1, 7, True), ("A", 0, 3, True)]
    return recovery.select_snapshot(spark.createDataFrame(rows, "slot string, epoch_id long, seg_seq_head long, valid boolean")).drop("valid")


def info_stats(spark, d):
    blocks = _blocks(spark, d)
    ring = segments.ring(blocks, RING).agg(F.max("seg_seqno").alias("seg_seq_head"), F.min("seg_seqno").alias("seg_seq_tail"))
    counts = blocks.agg(F.count("*").alias("blocks_written"), F.count_if(~_valid()).alias("crc_errors"))
    marks = segments.watermarks(_zones(spark, d)).agg(F.count_if("warn").alias("gc_warn_events"), F.count_if("busy").alias("gc_busy_events"))
    cut = recovery.truncations(blocks, _valid()).agg(F.count("*").alias("recovery_truncations"))
    one = F.lit(True)  # each side is one row
    return ring.join(counts, one).join(marks, one).join(cut, one)


def p99_nearest_rank(spark, d):
    w = Window.partitionBy("series").orderBy("value", "event_id")
    n = F.count("*").over(Window.partitionBy("series"))
    rows = samples(spark, d).select("series", "value", F.row_number().over(w).alias("rn"), n.alias("n"))
    return rows.where(F.col("rn") == F.floor(F.col("n") * 99 / 100) + 1).select("series", F.col("value").alias("p99"))


def command_parse(spark, d):
    ts = F.unix_millis(F.col("ts").cast("timestamp")).bitwiseAND(4294967295).cast("string")
    s, i = F.col("user_id").bitwiseAND(255).cast("string"), F.col("event_id").cast("string")
    kind, sp = F.col("event_type"), F.lit(" ")
    line = (
        F.when(kind == "click", F.concat(F.lit("w "), s, sp, ts, sp, i))
        .when(kind == "signup", F.lit("f"))
        .when(kind == "view", F.concat(F.lit("l "), s))
        .when(kind == "purchase", F.concat(F.lit("e "), s, F.lit(" 0 "), ts))
        .otherwise(F.lit("w x"))
    )
    return events(spark, d).select("event_id", line.alias("line")).select("event_id", *[c.alias(n) for n, c in io.parsed_commands(F.col("line")).items()])


QUERIES = {
    "samples_scan": lambda s, d: samples(s, d),
    "ingest_validate": ingest_validate,
    "range_query": lambda s, d: scan.series_range(samples(s, d), 7, 0, 2_000_000_000),
    "range_inverted": lambda s, d: scan.series_range(samples(s, d), 7, 1000, 500),
    "range_query_wrap": lambda s, d: scan.wrap_range(samples(s, d), 4_200_000_000, 100_000_000),
    "range_query_wrap_wide": lambda s, d: scan.wrap_range(samples(s, d), 0, 4_294_967_295).withColumn("win", F.lit("wide")).union(
        scan.wrap_range(samples(s, d), 1000, 500).withColumn("win", F.lit("inverted"))
    ),
    "full_scan": lambda s, d: scan.full_scan(samples(s, d), 1),
    "range_limit": range_limit,
    "latest_one": lambda s, d: scan.latest(samples(s, d), 7),
    "latest_all": lambda s, d: scan.latest(samples(s, d)),
    "latest_missing": lambda s, d: scan.latest(samples(s, d), 255),
    "epoch_unwrap": epoch_unwrap,
    "ts64_unwrapped": lambda s, d: epoch.unwrapped(samples(s, d), CHUNK).select("event_id", "epoch_id", "ts64"),
    "block_pack_fixed": lambda s, d: packing.fixed_blocks(samples(s, d), chunk=CHUNK).select("event_id", "series", "blk"),
    "block_pack_greedy": lambda s, d: packing.greedy_blocks(ticks(s, d), CHUNK).select("event_id", "series", "blk"),
    "block_pack_runs": block_pack_runs,
    "delta_encode": lambda s, d: _fixed(s, d).select("event_id", "series", "blk", "row_in_blk", "delta"),
    "delta_decode": delta_decode,
    "block_headers": lambda s, d: codec.headers(_fixed(s, d)),
    "quantize": lambda s, d: codec.with_values(_fixed(s, d)).select("event_id", "series", "blk", "qval"),
    "dequantize": lambda s, d: codec.with_values(_fixed(s, d)).select("event_id", "decoded"),
    "roundtrip_error": roundtrip_error,
    "block_sizes": block_sizes,
    "payload_encode": lambda s, d: _images(s, d).select("series", "blk", F.lower(F.hex("payload")).alias("payload_hex")),
    "payload_roundtrip": payload_roundtrip,
    "header_roundtrip": header_roundtrip,
    "block_checksum": lambda s, d: _images(s, d).select("series", "blk", "payload_crc"),
    "segment_assign": lambda s, d: _blocks(s, d).select("series", "blk", "block_no", "segment_no", "page_no", "seg_seqno"),
    "zone_map": zone_map,
    "sealed_segments": lambda s, d: zone_map(s, d).where(F.col("block_count") == segments.BLOCKS),
    "series_presence": lambda s, d: _blocks(s, d).select("segment_no", "series").distinct(),
    "zone_prune": zone_prune,
    "zone_prune_time": zone_prune_time,
    "range_query_pruned": range_query_pruned,
    "ring_retention": lambda s, d: segments.ring(_blocks(s, d), RING).select("series", "blk", "block_no", "seg_seqno"),
    "gc_watermarks": lambda s, d: segments.watermarks(_zones(s, d)),
    "gc_victims": lambda s, d: segments.victims(_zones(s, d)),
    "gc_quota": gc_quota,
    "recovery_prefix": recovery_prefix,
    "recovery_truncations": lambda s, d: recovery.truncations(_blocks(s, d), _valid()),
    "crc_isolation": crc_isolation,
    "crc_error_count": crc_error_count,
    "snapshot_row": snapshot_row,
    "snapshot_select": snapshot_select,
    "info_stats": info_stats,
    "export_csv": lambda s, d: io.csv_lines(samples(s, d), 7, 0, 2_000_000_000),
    "export_ndjson": lambda s, d: io.ndjson_lines(samples(s, d), 7, 0, 2_000_000_000),
    "export_clamped": lambda s, d: scan.series_range(samples(s, d), 7, *scan.clamped(23_675_985, 5)),
    "ingest_generate": lambda s, d: io.generated(s, 100),
    "retention_estimate": lambda s, d: s.range(1).select(F.lit(1024 * 64 * 15).cast("long").alias("rows"), F.round(F.lit(1024 * 64 * 15 / 86400), 4).alias("days")),
    "p99_nearest_rank": p99_nearest_rank,
    "command_parse": command_parse,
}

_S = """s AS (SELECT cast(user_id & 255 AS INTEGER) AS series, (epoch_us(ts) // 1000) & 4294967295 AS ts_ms,
  cast(value AS FLOAT) AS value, event_id FROM events)"""
_T = """t AS (SELECT cast(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS series,
  (epoch_us(ts) // 1000000) & 4294967295 AS ts_ms, cast(value AS FLOAT) AS value, event_id FROM events)"""
_E = _S + """, j AS (SELECT *, lag(ts_ms) OVER (ORDER BY event_id) AS p FROM s),
e AS (SELECT series, ts_ms, value, event_id, cast(sum(CASE WHEN ts_ms < p AND p - ts_ms > 2147483648 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS epoch_id FROM j),
u AS (SELECT *, epoch_id * 4294967296 + ts_ms AS ts64 FROM e),
f AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY event_id) - 1) // 56 AS blk FROM u)"""
_R = _E + """, r AS (SELECT *, row_number() OVER (PARTITION BY series, blk ORDER BY event_id) - 1 AS row_in_blk,
  coalesce((ts_ms - lag(ts_ms) OVER (PARTITION BY series, blk ORDER BY event_id)) & 4294967295, 0) AS delta FROM f)"""
_HEAD = """SELECT series, blk, count(*) AS cnt, arg_min(ts_ms, event_id) AS t0_ms, arg_max(ts_ms, event_id) AS t_last_ms,
  CASE WHEN max(delta) > 255 THEN 16 ELSE 8 END AS dt_bits, cast(cast(0.5 AS FLOAT) * (max(value) + min(value)) AS FLOAT) AS bias,
  CASE WHEN cast((max(value) - min(value)) / cast(65535 AS FLOAT) AS FLOAT) = 0 THEN cast(1e-9 AS FLOAT)
       ELSE cast((max(value) - min(value)) / cast(65535 AS FLOAT) AS FLOAT) END AS scale, max(event_id) AS last_event_id
  FROM {r} GROUP BY series, blk"""
_Q = """SELECT {r}.*, h.bias, h.scale, h.t0_ms, h.cnt, h.dt_bits, greatest(-32768, least(32767, cast(round(cast((value - bias) / scale AS FLOAT)) AS INTEGER))) AS qval
  FROM {r} JOIN h ON {r}.series = h.series AND {r}.blk = h.blk"""
_H = _R + ", h AS (" + _HEAD.format(r="r") + "), q AS (" + _Q.format(r="r") + "), v AS (SELECT *, cast(bias + scale * cast(qval AS FLOAT) AS FLOAT) AS decoded FROM q)"
_B = _E + """, b0 AS (SELECT series, blk, max(event_id) AS last_event_id, min(ts64) AS t_min, max(ts64) AS t_max FROM f GROUP BY series, blk),
b1 AS (SELECT *, row_number() OVER (ORDER BY last_event_id) - 1 AS block_no FROM b0),
b AS (SELECT *, block_no // 15 AS segment_no, block_no % 15 AS page_no, block_no // 15 + 1 AS seg_seqno, block_no % 37 <> 0 AS valid FROM b1)"""
_Z = _B + """, z AS (SELECT segment_no, max(seg_seqno) AS seg_seqno, min(t_min) AS t_min, max(t_max) AS t_max, count(*) AS block_count,
  count(DISTINCT series) AS n_series FROM b GROUP BY segment_no)"""
_W = _Z + """, w AS (SELECT segment_no, segment_no + 1 AS used, (SELECT count(*) FROM z) - segment_no - 1 AS free,
  ((SELECT count(*) FROM z) - segment_no - 1) * 100 < 10 * (SELECT count(*) FROM z) AS warn,
  ((SELECT count(*) FROM z) - segment_no - 1) * 100 < 5 * (SELECT count(*) FROM z) AS busy FROM z)"""
_RING = f"b WHERE seg_seqno > (SELECT max(seg_seqno) FROM b) - {RING}"
_CUT = "SELECT segment_no, min(page_no) FILTER (WHERE NOT valid) AS valid_pages FROM b GROUP BY segment_no HAVING min(page_no) FILTER (WHERE NOT valid) > 0"
_G = _T + """, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY event_id) AS rn, ts_ms - lag(ts_ms) OVER (PARTITION BY series ORDER BY event_id) AS dt FROM t),
g(series, rn, blk, cnt, wide) AS (
  SELECT series, rn, cast(0 AS BIGINT), cast(1 AS BIGINT), false FROM n WHERE rn = 1
  UNION ALL
  SELECT n.series, n.rn, CASE WHEN dt > 65535 OR dt < 0 OR (cnt + 1) * (CASE WHEN wide OR dt > 255 THEN 4 ELSE 3 END) > 224 THEN blk + 1 ELSE blk END,
    CASE WHEN dt > 65535 OR dt < 0 OR (cnt + 1) * (CASE WHEN wide OR dt > 255 THEN 4 ELSE 3 END) > 224 THEN 1 ELSE cnt + 1 END,
    CASE WHEN dt > 65535 OR dt < 0 OR (cnt + 1) * (CASE WHEN wide OR dt > 255 THEN 4 ELSE 3 END) > 224 THEN false ELSE wide OR dt > 255 END
  FROM g JOIN n ON n.series = g.series AND n.rn = g.rn + 1),
k AS (SELECT n.series, ts_ms, value, event_id, g.blk FROM n JOIN g ON n.series = g.series AND n.rn = g.rn)"""
_GR = _G + """, x AS (SELECT *, row_number() OVER (PARTITION BY series, blk ORDER BY event_id) - 1 AS row_in_blk,
  coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY series, blk ORDER BY event_id), 0) AS delta FROM k), h AS (""" + _HEAD.format(r="x") + ")"
_P = _GR + ", y AS (" + _Q.format(r="x") + """), p AS (SELECT series, blk,
    rpad(string_agg(CASE WHEN dt_bits = 8 THEN printf('%02x', delta) ELSE printf('%02x%02x', delta & 255, delta >> 8) END, '' ORDER BY row_in_blk)
      || string_agg(printf('%02x%02x', qval & 255, (qval >> 8) & 255), '' ORDER BY row_in_blk), 448, 'f') AS payload_hex FROM y GROUP BY series, blk)"""
_CRC = _P + """, d AS (SELECT series, blk, list_transform(range(0, 224), lambda i: cast('0x' || substr(payload_hex, cast(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM p)
  SELECT series, blk, xor(list_reduce(bytes, lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 517762881) ELSE x >> 1 END, xor(c, b)), cast(4294967295 AS BIGINT)), 4294967295) AS payload_crc FROM d"""
_WRAP = """CASE WHEN (({b} - {a}) & 4294967295) < 2147483648
  THEN ((ts_ms - {a}) & 4294967295) < 2147483648 AND (({b} - ts_ms) & 4294967295) < 2147483648
  ELSE ((ts_ms - {a}) & 4294967295) < 2147483648 OR (({b} - ts_ms) & 4294967295) < 2147483648 END"""
_LATEST = "SELECT series, arg_max(ts_ms, event_id) AS ts_ms, arg_max(value, event_id) AS value FROM s {w} GROUP BY series"
_C = _S + ", c AS (SELECT s.*, event_type FROM s JOIN events USING (event_id))"

SQL = {
    "samples_scan": f"WITH {_S} SELECT * FROM s",
    "ingest_validate": "SELECT CASE WHEN o_custkey BETWEEN 0 AND 255 THEN 'OK' ELSE 'EINVAL' END AS rc, count(*) AS n FROM orders GROUP BY 1",
    "range_query": f"WITH {_S} SELECT ts_ms, value FROM s WHERE series = 7 AND ts_ms BETWEEN 0 AND 2000000000",
    "range_inverted": f"WITH {_S} SELECT ts_ms, value FROM s WHERE series = 7 AND ts_ms BETWEEN 1000 AND 500",
    "range_query_wrap": f"WITH {_S} SELECT * FROM s WHERE {_WRAP.format(a=4200000000, b=100000000)}",
    "range_query_wrap_wide": f"WITH {_S} SELECT *, 'wide' AS win FROM s WHERE {_WRAP.format(a=0, b=4294967295)} UNION ALL SELECT *, 'inverted' AS win FROM s WHERE {_WRAP.format(a=1000, b=500)}",
    "full_scan": f"WITH {_S} SELECT ts_ms, value FROM s WHERE series = 1",
    "range_limit": f"WITH {_S} SELECT event_id, ts_ms, value FROM s WHERE series = 7 AND ts_ms BETWEEN 0 AND 2000000000 ORDER BY event_id LIMIT 10",
    "latest_one": f"WITH {_S} " + _LATEST.format(w="WHERE series = 7"),
    "latest_all": f"WITH {_S} " + _LATEST.format(w=""),
    "latest_missing": f"WITH {_S} " + _LATEST.format(w="WHERE series = 255"),
    "epoch_unwrap": f"WITH {_E} SELECT epoch_id, count(*) AS n FROM e GROUP BY epoch_id",
    "ts64_unwrapped": f"WITH {_E} SELECT event_id, epoch_id, ts64 FROM u",
    "block_pack_fixed": f"WITH {_E} SELECT event_id, series, blk FROM f",
    "block_pack_greedy": f"WITH RECURSIVE {_G} SELECT event_id, series, blk FROM k",
    "block_pack_runs": f"""WITH {_S}, a AS (SELECT *, CASE WHEN series IS DISTINCT FROM lag(series) OVER (ORDER BY event_id) THEN event_id END AS st FROM s),
      b AS (SELECT *, max(st) OVER (ORDER BY event_id) AS run_start FROM a)
      SELECT event_id, series, run_start, (row_number() OVER (PARTITION BY run_start ORDER BY event_id) - 1) // 56 AS blk FROM b""",
    "delta_encode": f"WITH {_R} SELECT event_id, series, blk, row_in_blk, delta FROM r",
    "delta_decode": f"WITH {_H} SELECT event_id, ts_ms, (t0_ms + cast(sum(delta) OVER (PARTITION BY series, blk ORDER BY row_in_blk) AS BIGINT)) & 4294967295 AS decoded_ts_ms FROM v",
    "block_headers": f"WITH {_H} SELECT * FROM h",
    "quantize": f"WITH {_H} SELECT event_id, series, blk, qval FROM v",
    "dequantize": f"WITH {_H} SELECT event_id, decoded FROM v",
    "roundtrip_error": f"""WITH {_H}, y AS (SELECT abs(cast(decoded AS DOUBLE) - cast(value AS DOUBLE)) / cast(scale AS DOUBLE) AS r FROM v)
      SELECT count(*) AS n, count(*) FILTER (WHERE r <= 0.5) AS within_half, round(max(r), 6) AS worst FROM y""",
    "block_sizes": f"WITH {_H} SELECT series, blk, cnt * (dt_bits // 8 + 2) AS used_bytes, 224 - cnt * (dt_bits // 8 + 2) AS slack_bytes, round(cast(256 AS DOUBLE) / (cast(10 AS DOUBLE) * cnt), 6) AS ratio FROM h",
    "payload_roundtrip": f"WITH RECURSIVE {_GR}, y AS (" + _Q.format(r="x") + ") SELECT series, blk, row_in_blk, ts_ms, qval FROM y",
    "payload_encode": f"WITH RECURSIVE {_P} SELECT series, blk, payload_hex FROM p",
    "block_checksum": f"WITH RECURSIVE {_CRC}",
    "header_roundtrip": f"WITH RECURSIVE {_GR} SELECT blk, series, cnt, t0_ms, dt_bits, bias, scale FROM h",
    "segment_assign": f"WITH {_B} SELECT series, blk, block_no, segment_no, page_no, seg_seqno FROM b",
    "zone_map": f"WITH {_Z} SELECT * FROM z",
    "sealed_segments": f"WITH {_Z} SELECT * FROM z WHERE block_count = 15",
    "series_presence": f"WITH {_B} SELECT DISTINCT segment_no, series FROM b",
    "zone_prune": f"WITH {_Z} SELECT segment_no, seg_seqno FROM z WHERE t_min <= 3500000000 AND t_max >= 3000000000 AND segment_no IN (SELECT segment_no FROM b WHERE series = 7)",
    "zone_prune_time": f"""WITH {_T}, f AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY event_id) - 1) // 56 AS blk FROM t),
      b AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi, row_number() OVER (ORDER BY max(event_id)) - 1 AS block_no FROM f GROUP BY series, blk)
      SELECT block_no // 15 AS segment_no, block_no // 15 + 1 AS seg_seqno FROM b GROUP BY ALL HAVING min(lo) <= 1705363199 AND max(hi) >= 1705276800""",
    "range_query_pruned": f"WITH {_E} SELECT event_id, ts64, value FROM u WHERE series = 7 AND ts64 BETWEEN 3000000000 AND 3500000000",
    "ring_retention": f"WITH {_B} SELECT series, blk, block_no, seg_seqno FROM {_RING}",
    "gc_watermarks": f"WITH {_W} SELECT * FROM w",
    "gc_victims": f"""WITH {_Z} SELECT segment_no, seg_seqno, row_number() OVER (ORDER BY seg_seqno) AS victim_rank FROM z
      QUALIFY (row_number() OVER (ORDER BY seg_seqno) - 1) * 100 < 10 * (SELECT count(*) FROM z)""",
    "gc_quota": f"""WITH a AS (SELECT event_id, (epoch_us(ts) // 1000000) // {QUOTA_S} AS slot FROM events),
      b AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY event_id) AS rank_in_window FROM a)
      SELECT event_id, slot, rank_in_window, CASE WHEN rank_in_window <= 2 THEN 'OK' ELSE 'EBUSY' END AS rc FROM b""",
    "recovery_prefix": f"""WITH {_B}, c AS (SELECT * FROM b WHERE page_no < coalesce((SELECT min(o.page_no) FROM b o WHERE o.segment_no = b.segment_no AND NOT o.valid), 15))
      SELECT f.event_id, c.segment_no, f.ts_ms FROM f JOIN c ON f.series = c.series AND f.blk = c.blk""",
    "recovery_truncations": f"WITH {_B} {_CUT}",
    "crc_isolation": f"WITH {_B} SELECT f.event_id, b.segment_no, f.ts_ms FROM f JOIN b ON f.series = b.series AND f.blk = b.blk WHERE valid",
    "crc_error_count": f"WITH {_B} SELECT series, count(*) FILTER (WHERE NOT valid) AS crc_errors FROM b GROUP BY series",
    "snapshot_row": f"""WITH {_B}, a AS (SELECT max(seg_seqno) AS seg_seq_head, min(seg_seqno) AS seg_seq_tail FROM {_RING})
      SELECT CASE WHEN seg_seq_head % 2 = 1 THEN 'A' ELSE 'B' END AS slot, (SELECT max(epoch_id) FROM u) AS epoch_id, seg_seq_head, seg_seq_tail FROM a""",
    "snapshot_select": """SELECT slot, epoch_id, seg_seq_head FROM (VALUES ('A', cast(1 AS BIGINT), cast(7 AS BIGINT), true), ('B', 1, 9, false), ('B', 1, 7, true), ('A', 0, 3, true)) v(slot, epoch_id, seg_seq_head, valid)
      WHERE valid ORDER BY seg_seq_head DESC, slot LIMIT 1""",
    "info_stats": f"""WITH {_W}, r AS (SELECT max(seg_seqno) AS hi, min(seg_seqno) AS lo FROM {_RING}), t AS ({_CUT})
      SELECT hi AS seg_seq_head, lo AS seg_seq_tail, (SELECT count(*) FROM b) AS blocks_written, (SELECT count(*) FROM b WHERE NOT valid) AS crc_errors,
        (SELECT count(*) FROM w WHERE warn) AS gc_warn_events, (SELECT count(*) FROM w WHERE busy) AS gc_busy_events, (SELECT count(*) FROM t) AS recovery_truncations FROM r""",
    "export_csv": f"WITH {_S} SELECT ts_ms || ',' || format('{{:.9g}}', cast(value AS DOUBLE)) AS line FROM s WHERE series = 7 AND ts_ms BETWEEN 0 AND 2000000000",
    "export_ndjson": f"WITH {_S} SELECT '{{\"ts_ms\":' || ts_ms || ',\"value\":' || format('{{:.9g}}', cast(value AS DOUBLE)) || '}}' AS line FROM s WHERE series = 7 AND ts_ms BETWEEN 0 AND 2000000000",
    "export_clamped": f"WITH {_S} SELECT ts_ms, value FROM s WHERE series = 7 AND ts_ms BETWEEN 23675985 AND greatest(23675985, 5)",
    "ingest_generate": "SELECT i * 100 AS ts_ms, cast(cast(25.0 AS DOUBLE) + cast(0.1 AS DOUBLE) * i AS FLOAT) AS value FROM range(100) t(i)",
    "retention_estimate": "SELECT cast(1024 * 64 * 15 AS BIGINT) AS rows, round(cast(1024 * 64 * 15 AS DOUBLE) / 86400, 4) AS days",
    "p99_nearest_rank": f"""WITH {_S}, a AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY series) AS n FROM s)
      SELECT series, value AS p99 FROM a WHERE rn = n * 99 // 100 + 1""",
    "command_parse": f"""WITH {_C} SELECT event_id, CASE event_type WHEN 'signup' THEN 'f' WHEN 'view' THEN 'l' WHEN 'purchase' THEN 'e' ELSE 'w' END AS verb,
      CASE WHEN event_type IN ('click', 'view', 'purchase') THEN series END AS series,
      CASE event_type WHEN 'click' THEN ts_ms WHEN 'purchase' THEN 0 END AS ts_ms, CASE event_type WHEN 'purchase' THEN ts_ms END AS t1_ms,
      CASE event_type WHEN 'click' THEN cast(event_id AS FLOAT) END AS value, CASE WHEN event_type IN ('click', 'signup', 'view', 'purchase') THEN 'OK' ELSE 'ERR' END AS rc FROM c""",
}
