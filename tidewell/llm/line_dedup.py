"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

State: a log-structured set of runs. A run is a table bucketed and sorted by line hash with one
row (h1, h2, n_docs, last_doc) per key. Every batch of documents is counted and then led past the runs, newest first: keys
that a run holds are merge-joined with it and take its totals up, the others are merge-anti-joined with it and go on to
the next older run; what no run holds is new. Known and new keys make the batch's own run. So the newest run that holds a key
has its totals over all batches so far, and when a level holds `fanout` runs they are compacted into one run of
the next level in which the newest row of a key wins. Because every run is bucketed alike, these joins and merges read
bucket against bucket without a shuffle of the state.

Defined cases
* null or empty text: one empty line. Keys under `min_chars` code points are never dropped.
* rows that repeat a doc_id count as one document; each row is filtered by itself.
* a null doc_id is a document that sorts before all others.
* empty table: empty result. Columns of the input other than doc_id and text are carried untouched
  by `dedup_lines`; whatever they are called, they can't clash, since work columns are kept apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, delete, fresh_path, table, with_text_key, written

#: Rows of the drop set up to which it is broadcast (24 bytes each); beyond it, a skew-aware sort-merge join.
BROADCAST_ROWS = 200_000
_LOWEST = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hashes(text: Column, min_chars: int) -> Column:
    """(h1, h2, pos) of every line whose key is long enough. 128 bits, so that no two keys of a 100 TB corpus are expected to meet."""
    keys = F.transform(_lines(text), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    long_ = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    return F.transform(long_, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit("tidewell"), k["key"]).alias("h2"), k["pos"].alias("pos")))


class LineRuns:
    """The levels of runs of one deduplication state."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self._made, self._paths = 0, {}

    def _write(self, *parts: DataFrame) -> str:
        """Write a run bucketed and sorted by hash; the files lie in the shared folder. Each part is dealt by itself:
        what comes from runs lies in its bucket already."""
        self._made += 1
        name = f"{self.name}_{self._made}"
        self._paths[name] = fresh_path(self.spark, name)
        for part in parts:
            (
                part.repartition(self.buckets, "h1", "h2")
                .write.mode("append")
                .bucketBy(self.buckets, "h1", "h2")
                .sortBy("h1", "h2")
                .option("path", self._paths[name])
                .option("compression", "zstd")
                .saveAsTable(name)
            )
        return name

    def runs(self) -> list[DataFrame]:
        """Newest first."""
        return [self.spark.table(t) for level in self.levels for t in reversed(level)]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs, newest first, as one: bucket by bucket, the newest row of a key wins."""
        out = runs[0]
        for run in runs[1:]:
            older = run.select("h1", "h2", F.col("n_docs").alias("n_old"), F.col("last_doc").alias("last_old"))
            out = out.hint("merge").join(older, ["h1", "h2"], "full").select(
                "h1", "h2", F.coalesce("n_docs", "n_old").alias("n_docs"), F.coalesce("last_doc", "last_old").alias("last_doc")
            )
        return out

    def add(self, batch: DataFrame) -> None:
        """Add the run of a batch (doc, h1, h2) of documents that no other batch holds; compact full levels."""
        counts = self._write(
            batch.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("last_doc")).select("h1", "h2", "n_docs", "last_doc")
        )
        new, parts = self.spark.table(counts), []
        for run in self.runs():
            parts.append(self.known(new, run))
            new = self.unseen(new, [run])
        self.levels[0].append(self._write(*parts, new) if parts else counts)
        if parts:
            self._forget([counts])
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged([self.spark.table(t) for t in reversed(self.levels[level])]))
            self._forget(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    @staticmethod
    def known(counts: DataFrame, run: DataFrame) -> DataFrame:
        """Counted keys that a run holds, with its totals taken up: the merge-join."""
        run = run.select("h1", "h2", F.col("n_docs").alias("n_old"), F.col("last_doc").alias("last_old"))
        return counts.join(run.hint("merge"), ["h1", "h2"]).select(
            "h1", "h2", (F.col("n_docs") + F.col("n_old")).alias("n_docs"), F.greatest("last_doc", "last_old").alias("last_doc")
        )

    @staticmethod
    def unseen(counts: DataFrame, runs: list[DataFrame]) -> DataFrame:
        """Counted keys that no run holds: the merge-anti-join of each run in turn."""
        for run in runs:
            counts = counts.join(run.hint("merge").select("h1", "h2"), ["h1", "h2"], "left_anti")
        return counts

    def _forget(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            delete(self.spark, self._paths.pop(t))

    def drop(self) -> None:
        """Take the runs out of the catalog and the shared folder."""
        for level in self.levels:
            self._forget(level)
        self.levels = [[]]

    def frequent(self, min_docs: int) -> DataFrame:
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs)


def _drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(doc, c1, c2, gone: sorted places of the lines to drop) for texts that lose lines."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    lines = written(
        with_text_key(docs.select(doc.alias("doc"), "text"))
        .select("doc", "c1", "c2", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"), _line_hashes(F.col("text"), min_chars).alias("hs"))
        .filter(F.size("hs") > 0),
        "line-hashes",
        ("batch",),
    )
    flat = lines.select("doc", "c1", "c2", "batch", F.inline("hs").alias("h1", "h2", "pos"))
    state = LineRuns(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(batches):
        state.add(flat.filter(F.col("batch") == b).select("doc", "h1", "h2"))
    frequent = written(state.frequent(min_docs), "line-frequent")
    state.drop()
    small = frequent.count() <= BROADCAST_ROWS
    hit = flat.join(F.broadcast(frequent) if small else frequent.hint("merge"), ["h1", "h2"])
    gone = F.sort_array(F.collect_set("pos"))  # a set: rows may be repeated
    return hit.filter(F.col("doc") < F.col("last_doc")).groupBy("doc", "c1", "c2").agg(gone.alias("gone"))


def filtered_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """Every row with (row: its columns, lines, kept_lines)."""
    drops = _drops(docs, min_chars, min_docs, batches)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    row = with_text_key(row).withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LOWEST)))
    lines = _lines(F.col("row.text"))
    # the stretches between dropped lines, so the work is linear in lines and drops
    after = F.concat(F.array(F.lit(-1)), F.col("gone"))
    until = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(after.alias("a"), until.alias("b")), lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1)))
    out = row.join(drops, ["doc", "c1", "c2"], "left").select("row", lines.alias("lines"), "gone")
    return out.select("row", "lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept).alias("kept_lines"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """The input with repeated lines taken out of `text`; same columns, every row kept."""
    out = filtered_lines(docs, min_chars, min_docs, batches)
    text = F.when(F.size("kept_lines") == F.size("lines"), F.col("row.text")).otherwise(F.array_join("kept_lines", "\n"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return filtered_lines(docs).select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l
), f AS (
  SELECT line_key, max(doc_id) AS last_doc FROM k WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, f.last_doc IS NOT NULL AND k.doc_id < f.last_doc AS gone
  FROM k LEFT JOIN f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
