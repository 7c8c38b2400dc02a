"""Media columns: content-defined chunks in a deduplicated store.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of 64, taken as 8-bit samples. A
rolling gear hash over the last 32 samples cuts it where the low bits vanish, so equal passages give equal
chunks wherever they stand. Spark joins find one owner for each chunk digest; the store keeps a chunk's samples
in its owner's row only, and an ordered chunk list for every different payload. Reading back joins the few
foreign chunks to the lists, verifies every digest and puts the payloads together again.

The stored form of a media object, which media_bytes and media_sha256 describe, is its row of the store: the ordered chunk
list (magic, unpadded size, then digest and length of each chunk) followed by the samples of the chunks it owns, in
order. It is hashed as it is read back.

Defined cases
* null or empty text: 64 zero samples. Equal texts give equal values in every column but doc_id.
* repeated rows and null ids: every row is returned; payloads are told apart by digest, never by id.
* empty table: no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_rows, table, written

UNIT = 64
MIN_CHUNK, MAX_CHUNK = 2048, 32768
#: A cut where these bits of the gear hash vanish: every 4096 samples on average.
CUT_MASK = np.uint32(0xFFF00000)
MAGIC = b"CDC1"
#: Compression of payloads while they are shuffled and in the store.
LEVEL = 9


def gear_table() -> np.ndarray:
    """A random-looking 32-bit number per byte, from the digest of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], "uint32")


def gear_hashes(samples: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[s[i-k]] << k over the last 32 samples, by doubling the span five times."""
    h = gear[samples]
    for span in (1, 2, 4, 8, 16):
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h = more
    return h


def cuts(payload: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    n = len(payload)
    if n <= MIN_CHUNK:
        return [n]
    marks = np.flatnonzero(gear_hashes(np.frombuffer(payload, "u1"), gear) & CUT_MASK == 0) + 1
    out, at = [], 0
    while n - at > MIN_CHUNK:
        k = np.searchsorted(marks, at + MIN_CHUNK)
        end = min(int(marks[k]) if k < len(marks) else n, at + MAX_CHUNK, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw)


def chunk_list(payload: bytes, n_bytes: int, gear: np.ndarray) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """(stored list, [(digest, samples)])."""
    chunks, at = [], 0
    for end in cuts(payload, gear):
        part = payload[at:end]
        chunks.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        at = end
    return MAGIC + struct.pack("<QI", n_bytes, len(chunks)) + b"".join(d + struct.pack("<I", len(p)) for d, p in chunks), chunks


def parse_list(stored: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    if stored[:4] != MAGIC:
        raise ValueError("not a chunk list")
    n_bytes, n = struct.unpack_from("<QI", stored, 4)
    return n_bytes, [(stored[16 + 20 * k : 32 + 20 * k], struct.unpack_from("<I", stored, 32 + 20 * k)[0]) for k in range(n)]


def feature_of(payload: bytes) -> str:
    """Mean, deviation and zero-crossing count of the samples around 128, and the entropy of their histogram."""
    x = np.frombuffer(payload, "u1")
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff((x >= 128).astype("i1"))))
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={crossings};entropy={-(p * np.log2(p)).sum():.4f}"


class MediaStore:
    """`media`: media_id, stored (the chunk list), digests and samples of the chunks it owns, the digests it lends
    and borrows. `members`: doc_id, media_id. Both are tables in the shared folder."""

    def __init__(self, media: DataFrame, members: DataFrame):
        self.media, self.members = media, members


def _media_id(stored: bytes) -> bytes:
    return hashlib.blake2b(stored, digest_size=16).digest()


def write_media(docs: DataFrame) -> MediaStore:
    """Cut every text, find one owner for each chunk, and store it there."""

    def lists():
        gear = gear_table()

        def run(doc_id, text):
            stored, chunks = chunk_list(*payload_of(text), gear)
            yield doc_id, _media_id(stored), [d for d, _ in chunks]

        return run

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    listed = written(map_rows(docs, lists, "doc_id long, media_id binary, digests array<binary>"), "media-lists")
    refs = (
        listed.groupBy("media_id")
        .agg(F.first("digests").alias("digests"))
        .select("media_id", F.explode(F.array_distinct("digests")).alias("digest"))
    )
    common = refs.groupBy("digest").agg(F.min("media_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    # a table of its own, so that the join is free to split hot chunks
    common = written(common.select("digest", "owner"), "common-chunks")
    roles = refs.join(common, "digest").select(
        "media_id",
        F.when(F.col("owner") == F.col("media_id"), F.col("digest")).alias("lent"),
        F.when(F.col("owner") != F.col("media_id"), F.col("digest")).alias("borrowed"),
    )
    roles = roles.groupBy("media_id").agg(F.collect_set("lent").alias("lent"), F.collect_set("borrowed").alias("borrowed"))

    def packed():
        import zstandard

        gear, squeeze = gear_table(), zstandard.ZstdCompressor(level=LEVEL)

        def run(text):
            payload, n_bytes = payload_of(text)
            yield _media_id(chunk_list(payload, n_bytes, gear)[0]), n_bytes, squeeze.compress(payload)

        return run

    # The one shuffle of payloads: compressed, and each different payload once per task at most.
    payloads = map_rows(docs.select("text"), packed, "media_id binary, n_bytes long, payload binary")
    payloads = payloads.groupBy("media_id").agg(F.first("n_bytes").alias("n_bytes"), F.first("payload").alias("payload"))
    none = F.array().cast("array<binary>")
    joined = payloads.join(roles, "media_id", "left").select(
        "media_id", "n_bytes", "payload", F.coalesce("lent", none).alias("lent"), F.coalesce("borrowed", none).alias("borrowed")
    )

    def stores():
        import zstandard

        gear, expand = gear_table(), zstandard.ZstdDecompressor()

        def run(media_id, n_bytes, payload, lent, borrowed):
            stored, chunks = chunk_list(expand.decompress(payload), n_bytes, gear)
            foreign = set(borrowed)
            own = {d: p for d, p in chunks if d not in foreign}
            yield media_id, stored, list(own), list(own.values()), lent, borrowed

        return run

    schema = "media_id binary, stored binary, digests array<binary>, samples array<binary>, lent array<binary>, borrowed array<binary>"
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "media-store")
    held = map_rows(joined, stores, schema)
    held.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVEL)).parquet(path)
    return MediaStore(spark.read.schema(held.schema).parquet(path), listed.select("doc_id", "media_id"))


def read_media(store: MediaStore) -> DataFrame:
    """One row per document: what its stored media gives when read back and verified."""
    media = store.media
    lent = (
        media.filter(F.size("lent") > 0)
        .select("lent", F.inline(F.arrays_zip("digests", "samples")).alias("digest", "sample"))
        .filter(F.array_contains("lent", F.col("digest")))
        .select("digest", "sample")
    )
    wanted = media.filter(F.size("borrowed") > 0).select("media_id", F.explode("borrowed").alias("digest"))
    foreign = wanted.join(lent, "digest").groupBy("media_id").agg(
        F.collect_list("digest").alias("d"), F.collect_list("sample").alias("s")
    )

    def features():
        def run(stored, digests, samples, more_digests, more_samples):
            have = dict(zip(digests, samples)) | dict(zip(more_digests or [], more_samples or []))
            n_bytes, chunks = parse_list(stored)
            parts = []
            for digest, length in chunks:
                part = have[digest]
                if len(part) != length or hashlib.blake2b(part, digest_size=16).digest() != digest:
                    raise ValueError("a stored chunk doesn't match its digest")
                parts.append(part)
            payload, own = b"".join(parts), b"".join(samples)
            yield (
                _media_id(stored),
                n_bytes,
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-UNIT:]),
                len(stored) + len(own),
                hashlib.sha256(stored + own).hexdigest(),
                feature_of(payload),
            )

        return run

    schema = "media_id binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    none = F.lit(None).cast("array<binary>")
    whole = media.filter(F.size("borrowed") == 0).select("stored", "digests", "samples", none.alias("d"), none.alias("s"))
    parts = media.filter(F.size("borrowed") > 0).join(foreign, "media_id").select("stored", "digests", "samples", "d", "s")
    return store.members.join(map_rows(whole.unionByName(parts), features, schema), "media_id").drop("media_id")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
