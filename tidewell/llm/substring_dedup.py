"""Substring dedup by greedy relative Lempel-Ziv parsing against an index of the whole corpus.

Every text is cut into reference blocks of `PASSAGE` words (and the words that its last windows need). The index
names, for a window of 35 words (128-bit hash), the least and the greatest block in which it starts anywhere. Only windows
near a shared entry are indexed: entries are the winnowed hashes of 18-word runs (in each stretch of 18 successive
runs the least hash, all of equals), a window holds exactly one such stretch, so equal windows share an entry at the
same place and no repeated window is missed.

Words are hashed all at once: a text's words are joined by single spaces, prefix sums of its bytes' numbers times powers of an odd
base are taken, and a word's hash is the difference at its ends times the power that moves it to the front.

A document is joined to the blocks that the index names for its windows: to a block other than the one the window stands
in, where there is one. Its words are then parsed greedily: at each place the longest match of at least 35 words in those
blocks, compared word by word and not with itself, becomes a factor. The next place looked at is the first window
that reaches beyond the factor, so windows across a factor's boundary are checked like all others. The words of the
factors are the duplicate spans; hashes only bring documents and blocks together.

Equal texts are folded into one with a number of copies; two copies make all their windows repeated.

Defined cases
* null or blank text: no words, nothing removed. Under 35 words: nothing removed.
* rows that repeat a doc_id, and null ids: texts are told apart by digest, so every row counts as a document.
* ties: of equally long matches the first found makes the factor; the spans don't depend on it. Empty table: no rows.
* columns other than doc_id and text are not read by `parsed` and carried untouched by `drop_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, mix, table, with_text_key, written

MIN_WORDS = 35
#: Words of a reference block. Words that one more window each would need are stored with it.
PASSAGE = 128
_U = np.uint64
_P1, _P2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Bytes hashed at a time, cut between words, and the longest word that is hashed so.
PIECE = 1 << 16
_BYTES = mix(np.arange(1, 257, dtype="u8") * _P1)
_THERE, _BACK = (np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(PIECE, x, "u8"))]) for x in (_P2, _U(pow(int(_P2), -1, 1 << 64))))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() knows exactly the six white-space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the words of a text that single spaces join."""
    spaces = np.flatnonzero(np.frombuffer(text, "u1") == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(text)]])


class WordHasher:
    """Words -> 64-bit hashes, which depend on a word's bytes alone."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.of(b" ".join(words))

    def of(self, text: bytes) -> np.ndarray:
        """Of the words of a text that single spaces join."""
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at, at + PIECE + 1)
            if end < 0:  # a longer word
                end = text.find(b" ", at)
                end = len(text) if end < 0 else end
                out.append(np.array([xxhash.xxh64_intdigest(memoryview(text)[at:end])], "u8"))
            else:
                piece = text[at:end]
                first, last = bounds(piece)
                sums = np.zeros(len(piece) + 1, "u8")
                np.cumsum(_BYTES[np.frombuffer(piece, "u1")] * _THERE[: len(piece)], out=sums[1:])
                out.append(mix((sums[last] - sums[first]) * _BACK[first]))
            at = end + 1
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, "u8"), *out])


def run_hashes(words: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of k words: a polynomial, built from runs of powers of two."""
    power, span, runs, done, out = base, 1, words, 0, None
    while True:
        if k & span:
            n = len(words) - (done + span) + 1
            out = runs[:n] if out is None else out[:n] * power + runs[done : done + n]
            done += span
        if done == k:
            return mix(out)
        runs = runs[: len(runs) - span] * power + runs[span:]
        power, span = _U(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), span * 2


def _sliding(x: np.ndarray, k: int, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of every k successive numbers, from those of powers of two."""
    span = 1
    while span * 2 <= k:
        x, span = least(x[: len(x) - span], x[span:]), span * 2
    return least(x[: len(x) - (k - span)], x[k - span :])


def index_places(runs: np.ndarray, stretch: int) -> np.ndarray:
    """Places of the winnowed entries: those that are the least of a stretch that holds them."""
    least = np.zeros(len(runs) + stretch - 1, "u8")
    least[stretch - 1 : len(runs)] = _sliding(runs, stretch, np.minimum)
    return np.flatnonzero(_sliding(least, stretch, np.maximum) == runs)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view("i8")


def block_ids(c1: int, numbers: np.ndarray) -> np.ndarray:
    """Ids of a text's blocks. The text's own bits come first, so least and greatest blocks seldom change within
    a passage; ids that clash only bring more blocks to a document."""
    low = _U((1 << 20) - 1)
    text = _U(c1 & 0xFFFFFFFFFFFFFFFF)
    return _signed((text & ~low) | (mix(numbers.astype("u8") ^ text) & low))


def greedy_factors(words: list[bytes], blocks: list[tuple[int, list[bytes]]], hasher: WordHasher, window: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, block, place in the block) of the longest matches from left to right. A block is
    (place in this very text or -1 for another text, words); a stretch never matches itself."""
    n = len(words) - window + 1
    if n < 1 or not blocks:
        return []
    mine, theirs = hasher(words), hasher([w for _, r in blocks for w in r])
    if len(theirs) < window:
        return []
    sizes = np.array([len(r) for _, r in blocks])
    start = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(blocks)), sizes)
    place = np.arange(len(theirs)) - start[block]
    whole = np.flatnonzero(place <= sizes[block] - window)  # windows within one block
    block, place, keys = block[whole], place[whole], run_hashes(theirs, window, _P1)[whole]
    order = np.argsort(keys, kind="stable")
    own = run_hashes(mine, window, _P1)
    low, high = np.searchsorted(keys[order], own, "left"), np.searchsorted(keys[order], own, "right")
    hits = np.flatnonzero(high > low)
    out, at = [], 0
    while (k := int(np.searchsorted(hits, at))) < len(hits):
        s = int(hits[k])
        best = (0, 0, 0)
        for j in order[low[s] : high[s]].tolist():
            b, t = int(block[j]), int(place[j])
            base, r = blocks[b]
            most = min(len(words) - s, len(r) - t)
            if most <= best[0] or base >= 0 and base + t == s:
                continue
            same = mine[s : s + most] == theirs[start[b] + t : start[b] + t + most]
            long = most if same.all() else int(same.argmin())
            if words[s : s + long] != r[t : t + long]:  # words whose hashes clash
                long = next(i for i in range(long) if words[s + i] != r[t + i])
            if long >= window and long > best[0]:
                best = (long, b, t)
        if best[0]:
            out.append((s, *best))
            at = s + best[0] - window + 1  # the first window that the factor doesn't hold
        else:
            at = s + 1
    return out


def parsed(docs: DataFrame, window: int = MIN_WORDS, with_text: bool = False) -> DataFrame:
    """One row per different text: c1, c2 (its digest), n_words, n_removed, kept_sha256, kept_text (null unless asked
    for and changed), factors (first word, words, source text, place in it) of texts that stand once."""
    run = (window + 1) // 2
    stretch = window - run + 1
    keyed = with_text_key(docs.select("text"))

    def indexed():
        hasher = WordHasher()

        def go(text, c1, c2):
            joined = b" ".join(words_of(text))
            h, entries = hasher.of(joined), np.zeros(0, "i8")
            if len(h) >= window:
                runs = run_hashes(h, run, _P1)
                entries = _signed(runs[index_places(runs, stretch)])
            yield c1, c2, len(h), hashlib.sha256(joined).hexdigest(), entries

        return go

    schema = "c1 long, c2 long, n_words long, kept_sha256 string, entries array<long>"
    blocks = written(
        map_rows(keyed, indexed, schema)
        .groupBy("c1", "c2")
        .agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_words", "kept_sha256", "entries"))),
        "blocks",
    )
    index = blocks.filter(F.size("entries") > 0).select("c1", "copies", F.explode("entries").alias("entry"))
    # a table of its own, so that the join is free to split hot entries
    shared = written(index.groupBy("entry").agg(F.sum("copies").alias("n")).filter("n > 1").select("entry"), "shared-entries")
    touched = index.select("c1", "entry").join(shared, "entry").groupBy("c1").agg(F.collect_set("entry").alias("entries"))
    touched = touched.join(blocks.select("c1", "c2", "copies", "n_words"), "c1")

    def squeezed():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        return lambda text, c1, c2: iter([(c1, c2, squeeze.compress(b" ".join(words_of(text))))])

    texts = map_rows(keyed, squeezed, "c1 long, c2 long, z binary").groupBy("c1", "c2").agg(F.first("z").alias("z"))
    open_ = written(texts.join(touched, ["c1", "c2"]), "touched")

    def near(h, entries):
        """Starts of the windows around the entries."""
        runs = run_hashes(h, run, _P1)
        at = index_places(runs, stretch)
        at = at[np.isin(_signed(runs[at]), np.array(entries, "i8"))]
        opened = np.bincount(np.maximum(at - (stretch - 1), 0), minlength=len(h) + 1)
        closed = np.bincount(np.minimum(at, len(h) - window) + 1, minlength=len(h) + 1)
        return np.flatnonzero(np.cumsum(opened - closed)[: len(h) - window + 1] > 0)

    def windowed():
        import zstandard

        hasher, expand = WordHasher(), zstandard.ZstdDecompressor()

        def go(c1, copies, z, entries):
            h = hasher.of(expand.decompress(z))
            s = near(h, entries)
            one, two = run_hashes(h, window, _P1)[s], run_hashes(h, window, _P2)[s]
            yield c1, copies, _signed(one), _signed(two), block_ids(c1, s // PASSAGE)

        return go

    def windows(texts):
        arrays = "one array<long>, two array<long>, block array<long>"
        flat = map_rows(texts.select("c1", "copies", "z", "entries"), windowed, f"c1 long, copies long, {arrays}")
        return flat.select("c1", "copies", F.inline(F.arrays_zip("one", "two", "block")))

    repeated = windows(open_).groupBy("one", "two").agg(F.sum("copies").alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
    repeated = written(repeated.filter("n > 1").select("one", "two", "least", "most"), "index")
    alone = open_.filter("copies = 1")
    other = F.when(F.col("least") != F.col("block"), F.col("least")).otherwise(F.col("most"))
    wanted = windows(alone).select("c1", "one", "two", "block").join(repeated, ["one", "two"]).select("c1", other.alias("block")).distinct()

    def blocked():
        import zstandard

        hasher, expand, squeeze = WordHasher(), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)

        def go(c1, c2, z, entries):
            text = expand.decompress(z)
            first, last = bounds(text)
            numbers = np.unique(near(hasher.of(text), entries) // PASSAGE)
            for k, block in zip(numbers.tolist(), block_ids(c1, numbers).tolist()):
                at = k * PASSAGE
                end = min(at + PASSAGE + window - 1, len(last))
                yield block, c1, c2, at, squeeze.compress(text[first[at] : last[end - 1]])

        return go

    blocks_of = map_rows(open_.select("c1", "c2", "z", "entries"), blocked, "block long, b1 long, b2 long, base long, words binary")
    given = wanted.join(blocks_of, "block").groupBy("c1").agg(F.collect_list(F.struct("b1", "b2", "base", "words")).alias("given"))
    given = given.select("c1", *(F.col(f"given.{c}").alias(c) for c in ("b1", "b2", "base", "words")))

    def cut():
        import zstandard

        hasher, expand = WordHasher(), zstandard.ZstdDecompressor()

        def go(c1, c2, z, b1, b2, base, packed):
            w = expand.decompress(z).split()
            given = [(at if (x, y) == (c1, c2) else -1, expand.decompress(r).split()) for x, y, at, r in zip(b1, b2, base, packed)]
            spans = greedy_factors(w, given, hasher, window)
            gone = np.zeros(len(w) + 1, "i4")
            for at, n, _, _ in spans:
                gone[at] += 1
                gone[at + n] -= 1
            stay = np.cumsum(gone)[: len(w)] == 0
            kept = b" ".join([x for x, k in zip(w, stay) if k])
            text = kept.decode("utf-8", "surrogatepass") if with_text and spans else None
            shown = [[at, n, b1[b], base[b] + t] for at, n, b, t in spans]
            yield c1, c2, int(len(w) - stay.sum()), hashlib.sha256(kept).hexdigest(), text, shown

        return go

    done = map_rows(
        alone.select("c1", "c2", "z").join(given, "c1"),
        cut,
        "c1 long, c2 long, cut_words long, cut_sha256 string, cut_text string, factors array<array<long>>",
    )
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return blocks.drop("entries").join(done, ["c1", "c2"], "left").select(
        "c1",
        "c2",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"),
        "factors",
    )


def drop_repeats(docs: DataFrame, window: int = MIN_WORDS) -> DataFrame:
    """The same rows; where words were removed, text holds the others joined by one space."""
    # a table of its own, so that the join is free to split hot texts
    found = written(parsed(docs, window, with_text=True).filter("n_removed > 0").select("c1", "c2", "kept_text"), "kept-texts")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    out = with_text_key(row).join(found, ["c1", "c2"], "left")
    return out.select(*[(F.coalesce("kept_text", "row.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = with_text_key(docs).select("doc_id", "c1", "c2")
    found = written(parsed(docs).select("c1", "c2", "n_words", "n_removed", "kept_sha256"), "parsed")  # so that hot texts can be split
    return keyed.join(found, ["c1", "c2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM w WHERE len(w) >= 35)
), h AS (
  SELECT win FROM s GROUP BY win HAVING count(*) > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM s WHERE win IN (SELECT win FROM h)
), a AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w
), k AS (
  SELECT a.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY a.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
