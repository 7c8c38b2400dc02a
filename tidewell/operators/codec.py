"""Block headers, 16-bit quantization, and the byte images of blocks."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksum import checksums, each_checksum
from ..functions.shipping import ship
from ..plans.samples import U32
from .packing import PAYLOAD

#: Fixed values of the stored format.
BLOCK_MAGIC, FOOTER_MAGIC = 0x424C4B31, 0x53464731
HEADER = struct.Struct("<IHHIB3sffI")
FOOTER = struct.Struct("<IIIII32s")
SNAPSHOT = struct.Struct("<5I")
#: Blocks that a task encodes or decodes at a time, however many an Arrow batch holds.
SLICE = 1024


def _f(c: Column) -> Column:
    return c.cast("float")


def scale_of(low: Column, high: Column) -> Column:
    scale = _f(_f(high - low) / _f(F.lit(65535.0)))
    return F.when(scale == 0, _f(F.lit(1e-9))).otherwise(scale)


def bias_of(low: Column, high: Column) -> Column:
    return _f(_f(F.lit(0.5)) * _f(high + low))


def quantized(value: Column, bias: Column, scale: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(_f(_f(value - bias) / scale)).cast("int")))


def dequantized(qval: Column, bias: Column, scale: Column) -> Column:
    return _f(bias + _f(scale * _f(qval)))


def headers(rows: DataFrame) -> DataFrame:
    """One row per block of rows that have deltas."""
    return rows.groupBy("series", "blk").agg(
        F.count("*").alias("cnt"),
        F.min_by("ts_ms", "event_id").alias("t0_ms"),
        F.max_by("ts_ms", "event_id").alias("t_last_ms"),
        F.when(F.max("delta") > 255, 16).otherwise(8).alias("dt_bits"),
        bias_of(F.min("value"), F.max("value")).alias("bias"),
        scale_of(F.min("value"), F.max("value")).alias("scale"),
        F.max("event_id").alias("last_event_id"),
    )


def with_values(rows: DataFrame) -> DataFrame:
    """Rows with the block's t0_ms, bias, scale, and qval and decoded. One window, no join."""
    w = Window.partitionBy("series", "blk")
    low, high = F.min("value").over(w), F.max("value").over(w)
    out = rows.withColumns({"low": low, "high": high, "t0_ms": F.min_by("ts_ms", "event_id").over(w)})
    out = out.withColumns({"bias": bias_of(F.col("low"), F.col("high")), "scale": scale_of(F.col("low"), F.col("high"))}).drop("low", "high")
    out = out.withColumn("qval", quantized(F.col("value"), F.col("bias"), F.col("scale")))
    return out.withColumn("decoded", dequantized(F.col("qval"), F.col("bias"), F.col("scale")))


def encode_payload(dt_bits: int, deltas, qvals) -> bytes:
    """Delta lane, value lane, 0xFF padding."""
    lanes = np.asarray(deltas, "<u1" if dt_bits == 8 else "<u2").tobytes() + np.asarray(qvals, "<i2").tobytes()
    if len(lanes) > PAYLOAD:
        raise ValueError(f"{len(lanes)} bytes don't fit a block")
    return lanes.ljust(PAYLOAD, b"\xff")


def decode_payload(payload: bytes, dt_bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    width = dt_bits // 8
    return np.frombuffer(payload, f"<u{width}", count), np.frombuffer(payload, "<i2", count, width * count)


def pack_headers(series, count, t0, dt_bits, bias, scale, payload_crc) -> list[bytes]:
    """32-byte images; the last word is the checksum of the others."""
    rows = zip(series, count, t0, dt_bits, bias, scale, payload_crc)
    heads = [HEADER.pack(BLOCK_MAGIC, s, n, t, d, b"\xff" * 3, b, c, p) for s, n, t, d, b, c, p in rows]
    if not heads:
        return []
    crcs = checksums(np.frombuffer(b"".join(heads), "u1").reshape(-1, HEADER.size))
    return [h + struct.pack("<I", c) for h, c in zip(heads, crcs.tolist())]


def is_blank(page: Column) -> Column:
    """Whether a stored page is erased: 256 bytes, all 0xFF."""
    return page == F.unhex(F.repeat(F.lit("FF"), 256))


def blank(page: bytes) -> bool:
    return not page.strip(b"\xff")


def unpack_headers(images: list[bytes]) -> list[dict | None]:
    """Fields of each image, or None where its magic or checksum is wrong."""
    out = []
    for image, crc in zip(images, each_checksum([i[:28] for i in images]).tolist()):
        magic, series, count, t0, dt_bits, _, bias, scale, payload_crc = HEADER.unpack(image[:28])
        good = magic == BLOCK_MAGIC and struct.unpack("<I", image[28:32])[0] == crc
        out.append({"series": series, "cnt": count, "t0_ms": t0, "dt_bits": dt_bits, "bias": bias, "scale": scale, "payload_crc": payload_crc} if good else None)
    return out


def unpack_header(image: bytes) -> dict | None:
    return unpack_headers([image])[0]


def sliced(batches):
    """The rows of Arrow batches, SLICE at a time, so what Python makes of them doesn't grow with the batch."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _sealed(body: bytes) -> bytes:
    """body and the checksum of body followed by four zero bytes."""
    crc = int(checksums(np.frombuffer(body + bytes(4), "u1").reshape(1, -1))[0])
    return body + struct.pack("<I", crc)


def pack_footer(seqno: int, t_min: int, t_max: int, block_count: int, series_set) -> bytes:
    bitmap = bytearray(32)
    for s in series_set:
        bitmap[s >> 3] |= 1 << (s & 7)
    return _sealed(FOOTER.pack(FOOTER_MAGIC, seqno, t_min, t_max, block_count, bytes(bitmap)))


def unpack_footer(image: bytes) -> dict | None:
    body = image[: FOOTER.size]
    magic, seqno, t_min, t_max, count, bitmap = FOOTER.unpack(body)
    if magic != FOOTER_MAGIC or _sealed(body) != image[: FOOTER.size + 4]:
        return None
    return {"seg_seqno": seqno, "t_min": t_min, "t_max": t_max, "block_count": count, "series_set": [s for s in range(256) if bitmap[s >> 3] >> (s & 7) & 1]}


def packed_footers(zones: DataFrame) -> DataFrame:
    """seg_seqno and footer image of zones (seg_seqno, t_min, t_max on the 32-bit clock, block_count, series_set)."""
    ship(zones.sparkSession)

    def pack(batches):
        import pyarrow as pa

        names = ("seg_seqno", "t_min", "t_max", "block_count", "series_set")
        for b in batches:
            images = [pack_footer(*row) for row in zip(*(b.column(n).to_pylist() for n in names))]
            yield pa.RecordBatch.from_arrays([b.column("seg_seqno"), pa.array(images, pa.binary())], names=["seg_seqno", "footer"])

    return zones.select("seg_seqno", "t_min", "t_max", "block_count", "series_set").mapInArrow(pack, "seg_seqno long, footer binary")


def read_footers(footers: DataFrame) -> DataFrame:
    """Fields of the footers whose magic and checksum hold: the footer scan."""
    ship(footers.sparkSession)

    def read(batches):
        import pyarrow as pa

        names = ("seg_seqno", "t_min", "t_max", "block_count")
        for b in batches:
            got = [f for f in map(unpack_footer, b.column("footer").to_pylist()) if f]
            cols = [pa.array([f[n] for f in got], pa.int64()) for n in names] + [pa.array([f["series_set"] for f in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "series_set"])

    return footers.select("footer").mapInArrow(read, "seg_seqno long, t_min long, t_max long, block_count long, series_set array<int>")


def checked(blocks: DataFrame) -> DataFrame:
    """blocks (header, payload) with ok: whether magic and both checksums hold."""
    ship(blocks.sparkSession)
    kept = [f for f in blocks.schema.fields]

    def check(batches):
        import pyarrow as pa

        for b in sliced(batches):
            heads = unpack_headers(b.column("header").to_pylist())
            crcs = each_checksum(b.column("payload").to_pylist()).tolist()
            ok = pa.array([h is not None and h["payload_crc"] == c for h, c in zip(heads, crcs)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, ok], names=[*b.schema.names, "ok"])

    from pyspark.sql.types import BooleanType, StructField, StructType

    return blocks.mapInArrow(check, StructType([*kept, StructField("ok", BooleanType())]))


def pack_snapshot(epoch_id: int, head: int, tail: int, head_addr: int, version: int = 1) -> bytes:
    return _sealed(SNAPSHOT.pack(version, epoch_id, head, tail, head_addr))


def unpack_snapshot(image: bytes) -> dict | None:
    if _sealed(image[: SNAPSHOT.size]) != image[: SNAPSHOT.size + 4]:
        return None
    return dict(zip(("version", "epoch_id", "seg_seq_head", "seg_seq_tail", "head_addr"), SNAPSHOT.unpack(image[: SNAPSHOT.size])))


def block_images(rows: DataFrame) -> DataFrame:
    """One row per block: header fields, payload, payload_crc and header image. `rows` hold deltas and values."""
    ship(rows.sparkSession)
    lanes = rows.groupBy("series", "blk").agg(
        F.count("*").alias("cnt"),
        F.min("t0_ms").alias("t0_ms"),
        F.when(F.max("delta") > 255, 16).otherwise(8).alias("dt_bits"),
        F.first("bias").alias("bias"),
        F.first("scale").alias("scale"),
        F.max("event_id").alias("last_event_id"),
        F.sort_array(F.collect_list(F.struct("row_in_blk", "delta", "qval"))).alias("lane"),
    )
    lanes = lanes.select("*", F.col("lane.delta").alias("deltas"), F.col("lane.qval").alias("qvals")).drop("lane")

    def image(batches):
        import pyarrow as pa

        for b in sliced(batches):
            get = {n: b.column(n).to_pylist() for n in b.schema.names}
            payloads = [encode_payload(d, x, q) for d, x, q in zip(get["dt_bits"], get["deltas"], get["qvals"])]
            crcs = each_checksum(payloads).tolist()
            heads = pack_headers(*(get[n] for n in ("series", "cnt", "t0_ms", "dt_bits", "bias", "scale")), crcs)
            kept = [n for n in b.schema.names if n not in ("deltas", "qvals")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in kept), pa.array(payloads, pa.binary()), pa.array(crcs, pa.int64()), pa.array(heads, pa.binary())],
                names=[*kept, "payload", "payload_crc", "header"],
            )

    schema = "series int, blk long, cnt long, t0_ms long, dt_bits int, bias float, scale float, last_event_id long, payload binary, payload_crc long, header binary"
    return lanes.mapInArrow(image, schema)


def read_images(blocks: DataFrame) -> DataFrame:
    """Rows of the blocks (blk, header, payload) whose header and payload checksums hold: series, blk, row_in_blk, ts_ms,
    qval, decoded. Bad blocks are left out, their neighbours are not."""

    ship(blocks.sparkSession)

    def read(batches):
        import pyarrow as pa

        for b in sliced(batches):
            payloads = b.column("payload").to_pylist()
            heads, crcs = unpack_headers(b.column("header").to_pylist()), each_checksum(payloads).tolist()
            good = [i for i, (h, c) in enumerate(zip(heads, crcs)) if h is not None and h["payload_crc"] == c]
            if not good:
                continue
            lanes = [decode_payload(payloads[i], heads[i]["dt_bits"], heads[i]["cnt"]) for i in good]
            counts = [len(q) for _, q in lanes]

            def spread(name, kind):
                return np.repeat(np.array([heads[i][name] for i in good], kind), counts)

            q = np.concatenate([q for _, q in lanes])
            row = np.concatenate([np.arange(n) for n in counts])
            ts = (spread("t0_ms", "i8") + np.concatenate([np.cumsum(d, dtype="i8") for d, _ in lanes])) & U32
            value = spread("bias", "f4") + spread("scale", "f4") * q.astype("f4")
            cols = (spread("series", "i4"), b.column("blk").take(pa.array(np.repeat(good, counts))), row, ts, q, value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds)], names=["series", "blk", "row_in_blk", "ts_ms", "qval", "decoded"])

    return blocks.select("blk", "header", "payload").mapInArrow(read, "series int, blk long, row_in_blk long, ts_ms long, qval int, decoded float")
