"""MinHash near-dedup over SetSketch registers.

A document's shingle set is sketched into 160 registers: per register the least of its elements' exponential
variates, kept as a truncated power of b (registers of a union are the larger registers of the parts). Equal
sets are folded into one representative. Representatives that agree on all five registers of one of 32 bands are
candidates; at a similarity of 0.85 a pair misses every band with a probability below 1e-8.

Links are confirmed in two steps, so that no bucket is expanded into pairs:
1. every member of a bucket against the bucket's least member (linear in the members);
2. in buckets whose members are still in several components (of buckets with the same members, in one): all members outside the
   bucket's largest component against every member of other components, in blocks of bounded bytes. Blocks
   give at most a spanning forest of the links they find.
In both steps a pair whose registers make the threshold implausible under the joint likelihood of the registers
(given both set sizes) is left out; all others are confirmed on the full shingle sets.
Components come from alternating large-star and small-star steps on tables; nothing is gathered on the driver.

Defined cases
* null or blank text: empty set, linked with nothing, kept, its own component (that of its id, if other rows repeat it).
* fewer words than a shingle has: the whole sequence is the one shingle.
* rows that repeat a doc_id are one document: their links add up; each row gets its own n_shingles.
* rows without an id link with nothing; component_id is null and kept is true.
* ties: the least doc_id stands for equal sets. Empty table: no rows. Columns other than doc_id and text
  are not read by `near_duplicates` and carried untouched by `drop_near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, map_rows, mix, ship, table, written

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Log-likelihood that a pair may lose at the threshold against its best similarity before it is left out.
SLACK = 18.0
BLOCK_BYTES = 3_000_000

_U = np.uint64


def register_seeds() -> np.ndarray:
    """Odd multipliers, one per register."""
    return mix(np.arange(1, REGISTERS + 1, dtype="u8") * _U(0x9E3779B97F4A7C15)) | _U(1)


class Shingler:
    """text -> sorted distinct 64-bit shingle hashes of the ASCII-lower-cased words."""

    def __init__(self, size: int):
        self.size, self.hasher = size, WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know exactly A-Z and the six white-space bytes
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not w:
            return np.zeros(0, "u8")
        a = self.hasher(w)
        k = min(self.size, len(a))
        out = np.full(len(a) - k + 1, k, "u8")
        for j in range(k):
            out = mix(out + a[j : len(a) - k + 1 + j]) + _U(0x9E3779B97F4A7C15)
        return np.unique(out)


def registers(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Truncated minima of exponential variates, as 16-bit powers of BASE."""
    least = np.full(len(seeds), np.iinfo("u8").max, "u8")
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, np.multiply.outer(shingles[at : at + 2048], seeds).min(axis=0))
    variate = -np.log1p(-(least.astype("f8") + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype("u2")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def plausible(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of at least `threshold` can't be ruled out.

    more, less: how many registers of a are above and below those of b. Under similarity J a register of a is
    above with probability p(u - vJ), below with p(v - uJ), where u and v are the shares of the set sizes.
    """
    if len(more) > 4096:
        cuts = range(4096, len(more), 4096)
        return np.concatenate([plausible(*part, threshold) for part in zip(*(np.split(x, cuts) for x in (more, less, n_a, n_b)))])
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.append(np.linspace(0.01, 0.999, 60), threshold)[:, None]  # similarities by pairs
    a, b = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-9), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-9)
    ll = more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, 1e-9))
    ll = np.where(j <= np.minimum(n_a, n_b) / np.maximum(n_a, n_b) + 0.02, ll, -np.inf)
    return ll[j[:, 0] >= threshold].max(axis=0) >= ll.max(axis=0) - SLACK


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    def make():
        shingler, seeds = Shingler(size), register_seeds()

        def run(doc_id, text):
            s = shingler(text)
            if not len(s) or doc_id is None:
                yield doc_id, len(s), None, None
                return
            r = registers(s, seeds)
            bands = [xxhash.xxh64_intdigest(r[k * ROWS : k * ROWS + ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]
            yield doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), bands

        return run

    return map_rows(docs, make, "doc_id long, n_shingles long, same binary, bands array<long>")


def _confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among pairs (a, n_a, r_a, z_a, b, n_b, r_b, z_b)."""

    def make():
        import zstandard

        shingler, expand, sets = Shingler(size), zstandard.ZstdDecompressor(), {}

        def of(key, z):
            s = sets.get(key)
            if s is None:
                if len(sets) >= 256:
                    sets.clear()
                s = sets[key] = shingler(expand.decompress(z).decode("utf-8", "surrogatepass"))
            return s

        def run(a, n_a, r_a, z_a, b, n_b, r_b, z_b):
            if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
                return
            x, y = np.frombuffer(r_a, "u2"), np.frombuffer(r_b, "u2")
            one = [np.array([v], "f8") for v in ((x > y).sum(), (x < y).sum(), n_a, n_b)]
            if plausible(*one, percent / 100)[0] and linked(of(z_a, z_a), of(z_b, z_b), percent):
                yield a, b

        return run

    return map_rows(pairs, make, "a long, b long")


def _blocks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning links between components within each block (g, i, j): stray rows against member rows."""
    ship(rows.sparkSession)

    def run(part):
        import pyarrow as pa
        import zstandard

        shingler, expand, sets = Shingler(size), zstandard.ZstdDecompressor(), {}
        ids, comp, n, stray, z = (part.column(c).to_pylist() for c in ("rep", "comp", "n", "stray", "z"))
        regs = np.array([np.frombuffer(r, "u2") for r in part.column("registers").to_pylist()])
        n = np.array(n, "f8")
        root: dict[int, int] = {}

        def top(c):
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        def of(k):
            s = sets.get(k)
            if s is None:
                s = sets[k] = shingler(expand.decompress(z[k]).decode("utf-8", "surrogatepass"))
            return s

        members = np.array([k for k in range(len(ids)) if not stray[k]], "i8")
        found = []
        for s in (k for k in range(len(ids)) if stray[k]):
            if not len(members):
                break
            fit = members[100 * np.minimum(n[s], n[members]) >= percent * np.maximum(n[s], n[members])]
            fit = fit[[top(comp[k]) != top(comp[s]) for k in fit]] if len(fit) else fit
            if not len(fit):
                continue
            more, less = (regs[fit] < regs[s]).sum(1), (regs[fit] > regs[s]).sum(1)
            ok = plausible(more, less, np.full(len(fit), n[s]), n[fit], percent / 100)
            for k in fit[ok][np.argsort(more[ok] + less[ok], kind="stable")]:
                if top(comp[k]) != top(comp[s]) and linked(of(s), of(k), percent):
                    root[max(top(comp[k]), top(comp[s]))] = min(top(comp[k]), top(comp[s]))
                    found.append((ids[s], ids[k]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, for every node of edges (a, b)."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of u moves to the least neighbour of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, move to the least of them
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        tally = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (now, after)]
        now = after
        if tally[0] == tally[1]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = written(_sketched(docs, size), "sketches")
    reps = seen.filter("same is not null").groupBy("same").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    # tables of their own, so that the joins are free to split hot buckets
    flat = reps.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket"))
    buckets = flat.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    buckets = written(buckets.select("bucket", "lead"), "buckets")
    members = written(flat.join(buckets, "bucket").select("bucket", "lead", "rep"), "members")
    stars = written(members.select("lead", "rep").filter("lead <> rep").distinct(), "stars")
    nodes = written(stars.select(F.col("lead").alias("rep")).union(stars.select("rep")).distinct(), "nodes")

    def squeezed():
        import zstandard

        shingler, seeds, squeeze = Shingler(size), register_seeds(), zstandard.ZstdCompressor(level=3)

        def run(rep, text):
            s = shingler(text)
            if len(s):
                yield rep, len(s), registers(s, seeds).tobytes(), squeeze.compress(text.encode("utf-8", "surrogatepass"))

        return run

    # sketched anew: only candidates need their registers, and rows that repeat an id have their own
    # by a shuffle of the texts at any size, since candidates grow with the corpus
    texts = docs.withColumnRenamed("doc_id", "rep").join(nodes.hint("merge"), "rep", "left_semi")
    texts = written(map_rows(texts.select("rep", "text"), squeezed, "rep long, n long, registers binary, z binary"), "texts")
    side = lambda s: texts.select(*[F.col(c).alias(f"{d}_{s}" if d else s) for c, d in (("rep", ""), ("n", "n"), ("registers", "r"), ("z", "z"))])
    pairs = stars.select(F.col("lead").alias("a"), F.col("rep").alias("b")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select("a", "n_a", "r_a", "z_a", "b", "n_b", "r_b", "z_b")
    links = written(_confirmed(pairs, size, percent), "links")
    comp = written(components(links), "components")
    placed = members.select("bucket", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(placed.select("bucket", "rep", F.coalesce("comp", "rep").alias("comp")), "placed")
    sizes = placed.groupBy("bucket", "comp").agg(
        F.count("*").alias("k"), *(F.bit_xor(F.xxhash64(F.lit(seed), "rep")).alias(f"x{seed}") for seed in (1, 2))
    )
    main = sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("k"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")
    )
    main = main.filter("parts > 1").groupBy("k", "x1", "x2").agg(F.min_by("bucket", "bucket").alias("bucket"), F.min_by("main", "bucket").alias("main"))
    main = written(main.select(F.col("bucket").alias("g"), "main"), "open-buckets")
    open_ = placed.withColumnRenamed("bucket", "g").join(main, "g").join(texts, "rep").withColumn("stray", F.col("comp") != F.col("main"))
    open_ = written(open_.select("g", "rep", "comp", "n", "registers", "z", "stray"), "open")
    weight = F.lit(400) + 12 * F.col("n")
    count = open_.groupBy("g").agg(
        F.ceil(F.sum(F.when(F.col("stray"), weight)) / BLOCK_BYTES).cast("int").alias("rows"), F.ceil(F.sum(weight) / BLOCK_BYTES).cast("int").alias("cols")
    )
    count = written(count, "block-counts")
    open_ = open_.join(count, "g")
    spread = lambda df, own, n_own, other, n_other, stray: df.select(
        "g", F.pmod(F.xxhash64("rep"), F.col(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other), "rep", "comp", "n", "registers", "z", F.lit(stray).alias("stray")
    )
    rows = spread(open_.filter("stray"), "i", "rows", "j", "cols", True).unionByName(spread(open_, "j", "cols", "i", "rows", False))
    more = _blocks(rows, size, percent)
    # rows that repeat an id are one document, which joins the representatives of its sets
    repeated = seen.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    repeated = written(repeated, "repeated-ids")
    own = seen.join(repeated, "doc_id", "left_semi").join(reps.select("same", "rep"), "same").filter("rep <> doc_id")
    final = written(components(links.union(more).union(own.select("rep", "doc_id").distinct())), "final")
    of_id = repeated.join(final.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("comp").alias("of_id"))
    of_set = reps.select("same", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("comp", "rep").alias("component"))
    of_set = written(of_set, "components-of-sets")  # so that large groups of copies can be split
    out = seen.select("doc_id", "n_shingles", "same").join(of_set, "same", "left")
    out = out.join(of_id, "doc_id", "left")
    component = F.coalesce("component", "of_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that aren't the least of their component; all columns."""
    gone = near_duplicates(docs, size, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(written(gone, "gone").hint("merge"), docs["doc_id"] == F.col("__gone"), "left_anti")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, hop) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.hop = e.x
), c AS (
  SELECT doc_id, min(hop) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
