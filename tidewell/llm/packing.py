"""Best-fit packing by swap-based local search over classes of equal bins.

A sequence holds at most 1024 tokens, so there are at most 1024 different piece lengths. The plan is made on
the histogram of lengths, which has that size whatever the corpus: bins with the same lengths are one class
with a multiplicity. Every piece starts in a bin of its own. Local search then empties bins: the fullest underfull bin
is given a piece of a bin with less in it, or exchanges pieces with one, one for one, two for one or one for two, whichever leaves it
the least room. Every step increases the sum of squared fills, which bounds the number of steps. It ends when as
few bins are left as the tokens need, or when no underfull bin has a step left. Documents take their places by rank within
their length, which is counted in salted groups, so no length is ever gathered in one task and nothing but the histogram
reaches the driver.

Defined cases
* null or empty text: one piece of one token (the separator).
* rows that repeat a doc_id are documents of their own; a null doc_id is packed like any other.
* empty table: no rows. Other columns are not read, so their names can't clash.
* equal lengths: places go by (doc_id, piece, crc) within a salt group; any order is valid.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import map_rows, table, written

CAPACITY = 1024
END_ID = 2
#: Salt groups a length is ranked in.
MAX_SALTS = 1024
#: Pieces that are planned at a time.
PLAN_PIECES = 1 << 20
MEMO_WORDS, MEMO_CHARS = 400_000, 64
#: Fixed value: the word pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with these take the pattern's own way.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\0")
_ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters outside these blocks, which are old, may be unknown to the pattern of one library and known to another's.
_NEW = re.compile("[^\0-\u02ff\u0370-\u0377\u0386-\u03ff\u0400-\u052f\u05d0-\u05ea\u0621-\u064a\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit bytes; words are encoded once and remembered.

    The vocabulary file is a tokenizers one; its merges run in tiktoken, which gives the same ids faster. Words with
    characters of newer blocks are split off by the library's own pattern."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    # in this kind of vocabulary the order of ids is the order of merges
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(PATTERN, regex.V1).findall
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def merged(word: str) -> bytes:
        return np.array(merges.encode_ordinary(word), "<u4").tobytes()

    class Memo(dict):
        def __missing__(self, word):
            out = merged(word)
            if len(word) <= MEMO_CHARS:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[word] = out
            return out

    memo = Memo()
    get = memo.__getitem__

    def find(text: str) -> list[str]:
        """Parts of a text that the pattern never spans: with single spaces and line ends between words, words with the
        space before them, and line ends; else what the pattern itself finds."""
        if any(x in text for x in _UNEVEN) or _ODD_SPACE.search(text):
            return pattern(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def new(text: str) -> bytes:
        words = (bytes([byte_of[c] for c in w]) for w, _ in split(text))
        return np.array([i for w in words for i in merges._encode_single_piece(w)], "<u4").tobytes()

    def plain(text: str) -> bytes:
        return new(text) if not text.isascii() and _NEW.search(text) else b"".join(map(get, find(text)))

    def encode(text: str) -> bytes:
        if "<|" in text and len(parts := cut.split(text)) > 1:
            return b"".join(np.uint32(special[p]).tobytes() if k % 2 else plain(p) for k, p in enumerate(parts))
        return plain(text)

    return encode


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.uint32(END_ID).tobytes()

    def make():
        encode = encoder(path)

        def cut(doc_id, text):
            ids = encode(text or "") + end
            n = len(ids) // 4
            bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                yield doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])

        return cut

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Classes of equal bins: (lengths, longest first) -> number; and which underfull ones can give what."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.number: Counter = Counter()
        #: underfull classes by fill
        self.by_fill: list[dict[tuple, None]] = [{} for _ in range(capacity)]
        #: tokens -> {(class, one or two pieces of so many tokens)}, of underfull classes
        self.gives: dict[int, dict[tuple, None]] = defaultdict(dict)
        self.bins = self.waste = 0

    @staticmethod
    def parts(bin_: tuple) -> set[tuple]:
        """Every single piece and every two pieces of a bin, by length."""
        return {(x,) for x in bin_} | {(x, y) for i, x in enumerate(bin_) for y in bin_[i + 1 :]}

    def put(self, bin_: tuple, n: int) -> None:
        if not bin_ or not n:
            return
        bin_ = tuple(sorted(bin_, reverse=True))
        fill = sum(bin_)
        self.bins += n
        self.waste += n * (self.capacity - fill)
        if bin_ not in self.number and fill < self.capacity:
            self.by_fill[fill][bin_] = None
            for give in self.parts(bin_):
                self.gives[sum(give)][bin_, give] = None
        self.number[bin_] += n

    def take(self, bin_: tuple, n: int) -> None:
        fill = sum(bin_)
        self.bins -= n
        self.waste -= n * (self.capacity - fill)
        self.number[bin_] -= n
        if not self.number[bin_]:
            del self.number[bin_]
            if fill < self.capacity:
                del self.by_fill[fill][bin_]
                for give in self.parts(bin_):
                    del self.gives[sum(give)][bin_, give]


def best_step(bins: Bins, target: tuple) -> tuple | None:
    """(source, pieces given, pieces taken back) that leaves the target least room; of equal ones that with the fewest pieces, then
    with the emptiest source."""
    fill = sum(target)
    backs = [(0, ()), *sorted((sum(p), p) for p in bins.parts(target))]
    for room in range(bins.capacity - fill):
        moved = bins.capacity - fill - room
        found = None
        for held, back in backs:
            for source, give in bins.gives.get(held + moved, ()):
                pieces = len(give) + len(back)
                # more moves than the source is ahead, so the squares grow; two for two is no step
                if pieces > 3 or moved <= sum(source) - fill or (source == target and bins.number[target] < 2):
                    continue
                key = (pieces, sum(source), source, give, back)
                if found is None or key < found:
                    found = key
        if found:
            return found[2:]
    return None


def local_search(bins: Bins) -> int:
    """Fill the fullest bins and empty the others until no fewer bins can hold the tokens, or no step is left; returns the
    number of steps (each over as many equal bins as there are)."""
    steps = tried = 0
    stuck: set[tuple] = set()  # bins without a step when last looked at
    top = bins.capacity - 1
    while bins.waste >= bins.capacity:
        target = found = None
        while top > 0 and not found:
            target = next((b for b in bins.by_fill[top] if b not in stuck), None)
            if target is None:
                top -= 1
            elif not (found := best_step(bins, target)):
                stuck.add(target)
        if not found:
            if tried == steps:
                break
            tried, top = steps, bins.capacity - 1
            stuck.clear()  # other bins have changed meanwhile
            continue
        source, give, back = found
        n = bins.number[target] // 2 if target == source else min(bins.number[source], bins.number[target])
        bins.take(source, n)
        bins.take(target, n)
        for old, out, into in ((source, give, back), (target, back, give)):
            rest = list(old)
            for x in out:
                rest.remove(x)
            bins.put((*rest, *into), n)
            top = max(top, min(sum(rest) + sum(into), bins.capacity - 1))
        steps += 1
    return steps


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Classes of bins (lengths, number) that hold exactly the lengths of the histogram. Larger corpora are planned as a
    multiple of a smaller one of the same shape, and the remainder by itself."""
    scale = -(-sum(histogram.values()) // PLAN_PIECES)
    if scale <= 1:
        bins = Bins(capacity)
        for length, n in histogram.items():
            bins.put((length,), n)
        local_search(bins)
        return sorted(bins.number.items())
    number: Counter = Counter()
    for lengths, n in plan({x: n // scale for x, n in histogram.items() if n // scale}, capacity):
        number[lengths] += n * scale
    for lengths, n in plan({x: n % scale for x, n in histogram.items() if n % scale}, capacity):
        number[lengths] += n
    return sorted(number.items())


def places(classes: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): ranks from there on take that place in successive bins."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for lengths, n in classes:
        offset = 0
        for size in lengths:
            out.append((size, rank[size], sequence, offset))
            rank[size] += n
            offset += size
        sequence += n
    return sorted(out)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    salts = min(MAX_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = written(
        pieces_of(docs, path, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces"
    )
    # at most capacity x salts rows
    counts = [(r.length, r.salt, r.n) for r in pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()]
    histogram: Counter = Counter()
    before = {}
    for length, salt, n in sorted(counts):
        before[length, salt] = histogram[length]
        histogram[length] += n
    where = np.array(places(plan(histogram, capacity)) or np.zeros((0, 4)), "int64").reshape(-1, 4)
    offsets = np.zeros((capacity + 1, salts), "int64")
    for (length, salt), n in before.items():
        offsets[length, salt] = n
    shared = spark.sparkContext.broadcast((where, offsets))  # (bin classes x their places) + capacity x salts numbers
    ranked = pieces.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank")

    def placed(batches):
        import pyarrow as pa

        where, offsets = shared.value
        big = 1 << 44
        keys = where[:, 0] * big + where[:, 1]
        for b in batches:
            length, salt, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            rank = rank + offsets[length, salt]
            k = np.searchsorted(keys, length * big + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(where[k, 2] + rank - where[k, 1]), pa.array(where[k, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
