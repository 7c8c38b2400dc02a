"""Shared helpers: whole-table readers, the shared folder, character classes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.shared import delete, fresh_path, written  # noqa: F401

#: The white space and letters that the contracts name.
WS = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a hasher remembers, of at most so many bytes each.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    t = F.coalesce(c, F.lit(""))
    for space in WS[1:]:
        t = F.replace(t, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")  # one plain character is split at without a pattern


def with_text_key(df: DataFrame) -> DataFrame:
    """df with c1, c2: 128 bits that stand for its text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({"c1": F.xxhash64(text), "c2": F.xxhash64(F.lit("tidewell"), text)})


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Words -> 64-bit hashes; those of short words are remembered."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, out = self.memo, []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            h = memo.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= MEMO_BYTES:
                    memo[w] = h
            out.append(h)
        return np.array(out, "u8")


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """Python over Arrow batches. `make()` runs once a task and gives a generator function from one row's
    values (in the order of df's columns) to output tuples. Longs keep all bits beside nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    ship(df.sparkSession)

    def run(batches):
        fn, out_schema = make(), to_arrow_schema(spark_schema)
        rows, size = [], 0

        def batch():
            cols = zip(*rows) if rows else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for out in fn(*row):
                    rows.append(out)
                    size += sum(len(x) for x in out if isinstance(x, (bytes, str)))
                    if len(rows) >= 4096 or size > 16_000_000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return df.mapInArrow(run, spark_schema)
