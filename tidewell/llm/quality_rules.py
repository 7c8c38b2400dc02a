"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio (DataFrame functions only).

Words and word pairs fall into hash buckets, whose number grows with the square root of the corpus as its distinct words do. Two multinomials are counted: the raw corpus over
all documents, and the trusted target over labelled documents (quality 1, not toxic; at most `TARGET_DOCS`
of them, those of the least id hash, which bounds what is broadcast). A document's score is the sum over its
n-grams of log(p_target / p_raw), divided by their number. Bucket weights are rounded to integers, so sums
don't depend on the order of rows and the threshold decides every document the same way in every run.

Half of the labelled documents, by id hash, make the target; the other half choose the threshold: of the scores, in
steps of 1 / `STEPS` nats, those that best tell held-out trusted documents from held-out documents of quality 0 (share of the
former kept less share of the latter kept), the middle of the lowest such stretch. Without either kind it is `THRESHOLD`.

Defined cases
* null or blank text: no words, all counts 0, base_failed, not kept.
* repeated doc_id: every row is judged by itself; null doc_id: judged, never trusted.
* no labels or no trusted documents: every weight is 0, so only the base rules decide.
* labels given more than once count as trusted only if all their rows say so, as of quality 0 if all do.
* empty table: empty result. Other columns, whatever their names, are carried by `reject_documents` untouched.
* texts of any length: the repeated windows of a text are found by as many hash bits as its positions leave free; where two
  different windows share them, by the words themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_text_key, words, written

#: Hash buckets: a power of two, of at least so many times the square root of the corpus's words (of six bytes); the least and the most,
#: which bounds what is broadcast (the most is reached at about 25 terabytes of text).
BUCKETS_A_ROOT, LEAST_BUCKETS, MOST_BUCKETS = 2, 1 << 14, 1 << 22
TARGET_DOCS = 50_000
#: Weights are kept as multiples of 1 / SCALE.
SCALE = 1 << 20
#: Steps of a nat in which the threshold is chosen; the threshold (least mean log ratio of a kept document, in nats) where labels can't choose one.
STEPS, THRESHOLD = 1024, -0.09
#: Pseudo-count by which both multinomials are smoothed.
PSEUDO = 5.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Hash bits given up besides those that a text's positions take (tests raise it).
SPARE_BITS = 0


def _hash(w: Column, i: Column) -> Column:
    """Of the 3-word window at i; 63 bits, so that two hashes' exclusive or is never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 1)


def _windows(hashes: Column, low: Column) -> Column:
    """All windows as (hash, position) packed into one long, sorted; `low` has the bits of positions."""
    return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))


def _same(w: Column, a: Column, b: Column, low: Column) -> Column:
    """Whether two packed windows hold the same words."""
    i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
    return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))


def _repeated_exactly(w: Column) -> Column:
    """Positions of repeated windows, by sorting the words themselves."""
    rows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("at"))))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    # the neighbours stand beside each row, so that rows aren't sorted anew for each
    beside = F.arrays_zip(rows.alias("x"), F.concat(F.array(F.lit(None)), rows).alias("y"), F.concat(F.slice(rows, 2, F.size(w)), F.array(F.lit(None))).alias("z"))
    found = F.filter(beside, lambda r: r["x"].isNotNull() & (same(r["x"], r["y"]) | same(r["x"], r["z"])))
    return F.transform(found, lambda r: r["x"]["at"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """docs (with `w`, the words) and `starts`, the sorted positions of the 3-word windows that stand more than once. Hash bits
    beside the position; where two windows have the same bits but other words, the words decide. Texts whose hashes all differ
    have none and go no further. Lambdas are interpreted, so each walks over all windows as seldom and as plainly as can be."""
    w, none = F.col("w"), F.array().cast("array<bigint>")
    hashes = F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: _hash(w, i))).otherwise(none)
    out = docs.withColumn("hashes", hashes).withColumn("low", F.expr(f"shiftleft(1L, length(bin(size(w))) + {SPARE_BITS}) - 1"))
    h, p, low, later = F.col("hashes"), F.col("packed"), F.col("low"), F.col("later")
    some = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn("packed", F.when(some, _windows(h, low)).otherwise(none))
    # places in `packed` of windows whose hash bits are those of the one before
    alike = F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.get(p, k).bitwiseXOR(F.get(p, k - 1)) <= low)
    out = out.withColumn("later", F.when(F.size(p) > 1, alike).otherwise(F.array().cast("array<int>")))
    clash = F.exists(later, lambda k: ~_same(w, F.get(p, k - 1), F.get(p, k), low))
    at = lambda k: F.get(p, k).bitwiseAND(low)
    fast = F.array_distinct(F.concat(F.transform(later, at), F.transform(later, lambda k: at(k - 1))))
    return out.withColumn("starts", F.sort_array(F.when(clash, _repeated_exactly(w)).otherwise(fast))).drop("hashes", "low", "packed", "later")


def base_features(docs: DataFrame) -> DataFrame:
    """docs (with `text`) and the base columns; `w` holds the words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("w", words(F.col("text")))
    filled = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        filled.alias("filled"),
    )
    out = repeated_windows(out)
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    out = out.select(
        *docs.columns,
        "w",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def buckets_for(docs: DataFrame) -> int:
    """From the bytes of all texts."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(BUCKETS_A_ROOT * math.sqrt(n / 6 + 1)))))


def _bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def _buckets(w: Column, buckets: int = LEAST_BUCKETS) -> Column:
    """Hash buckets of all words and word pairs. `w` must be a column by itself: an expression would be
    evaluated anew for every word."""
    one = F.transform(w, lambda x: _bucket(buckets, x))
    two = F.transform(w, lambda x, i: F.when(i > 0, _bucket(buckets, F.get(w, i - 1), x)))
    return F.array_compact(F.concat(one, two))


def gram_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (with `w`, the words): instead of `w` a row per word with `one`, its bucket, and `two`, that of the pair it ends, or
    null. One row with two nulls where there are no words. The same buckets as `_buckets`, in compiled code."""
    w, rest = F.col("w"), [F.col(f"`{c}`") for c in docs.columns if c != "w"]
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), w), F.lit(1), F.size(w))
    rows = docs.select(*rest, F.inline_outer(F.arrays_zip(before.alias("before_"), w.alias("word_"))))
    one = F.when(F.col("word_").isNotNull(), _bucket(buckets, F.col("word_")))
    two = F.when(F.col("before_").isNotNull(), _bucket(buckets, F.col("before_"), F.col("word_")))
    return rows.select(*rest, one.alias("one"), two.alias("two"))


def judged(labels: DataFrame) -> DataFrame:
    """label_id, fits (makes the target, or is held out), kind (1: trusted, 0: of quality 0, else null)."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    out = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(good).alias("good"), F.min(poor).alias("poor"))
    return out.select("label_id", (F.pmod(F.xxhash64("label_id"), F.lit(2)) == 0).alias("fits"), F.when(F.col("good"), 1).when(F.col("poor"), 0).alias("kind"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = judged(labels).filter("fits and kind = 1")
    return good.orderBy(F.xxhash64(F.lit("target"), "label_id"), "label_id").limit(TARGET_DOCS).select(F.col("label_id").alias("trusted_id"))


def best_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """From the held-out labels; at most as many rows as there are steps between the scores come back."""
    held = written(judged(labels).filter("not fits and kind is not null").select("label_id", "kind"), "held-labels")
    rows = scored.filter("not base_failed").select("doc_id", F.floor(F.col("score") * STEPS).alias("step"))
    counts = rows.join(held, F.col("doc_id") == F.col("label_id")).groupBy("step").agg(F.sum("kind").alias("good"), F.count("*").alias("n")).orderBy("step").collect()
    good, poor = sum(r.good for r in counts), sum(r.n - r.good for r in counts)
    if not good or not poor:
        return THRESHOLD
    # documents below a step are rejected; gain: poor ones rejected less good ones rejected, in integers
    gain, best = 0, (0, counts[0].step, counts[0].step)
    for k, r in enumerate(counts):
        gain += (r.n - r.good) * good - r.good * poor
        if gain > best[0]:
            best = (gain, r.step + 1, counts[k + 1].step if k + 1 < len(counts) else r.step + 1)
    return (best[1] + best[2]) / 2 / STEPS


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(bucket, weight long): at most `buckets` rows."""
    ids = F.broadcast(trusted_ids(labels))  # at most TARGET_DOCS rows
    grams = (
        docs.join(ids, docs["doc_id"] == ids["trusted_id"], "left")
        .select(F.col("trusted_id").isNotNull().cast("long").alias("t"), words(F.col("text")).alias("w"))
    )
    grams = gram_rows(grams, buckets).select("t", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = written(counts, "gram-counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = raw or 0, target or 0
    # shrunk towards 0 where counts are small: target against its expectation under the raw multinomial
    expected = F.col("raw") * F.lit(target / max(raw, 1))
    ratio = F.log((F.col("target") + PSEUDO) / (expected + PSEUDO))
    return counts.select("bucket", F.round((ratio if target else F.lit(0.0)) * SCALE).cast("long").alias("weight"))


def scored(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """Per row of docs (doc_id, text and `carry`): doc_id, carry, base columns, score, kept."""
    buckets = buckets_for(docs)
    weights = F.broadcast(bucket_weights(docs.select("doc_id", "text"), labels, buckets))  # at most MOST_BUCKETS rows of 12 bytes
    base = base_features(docs.select(*carry, F.col("doc_id").cast("long"), "text")).drop("text").withColumn("rid", F.monotonically_increasing_id())
    grams = gram_rows(base, buckets)
    keys = ["rid", *(c for c in base.columns if c not in ("w", "rid"))]
    for n in ("one", "two"):
        grams = grams.join(weights.select(F.col("bucket").alias(n), F.col("weight").alias(f"weight_{n}")), n, "left")
    total = sum((F.coalesce(f"weight_{n}", F.lit(0)) for n in ("one", "two")), F.lit(0))
    out = grams.groupBy(*keys).agg(F.sum(total).alias("total"), (F.count("one") + F.count("two")).alias("grams"))
    out = written(out.withColumn("score", F.col("total") / SCALE / F.greatest("grams", F.lit(1))).drop("rid"), "scores")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= best_threshold(out, labels)))


def reject_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The verdict depends on the text alone."""
    named = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "text")
    keyed = with_text_key(named)
    kept = scored(keyed.select("doc_id", "text", "c1", "c2"), labels, ["c1", "c2"]).filter("kept")
    # a table of its own, so that the join is free to split hot texts
    kept = written(kept.select("c1", "c2").distinct(), "kept-texts")
    out = keyed.join(kept, ["c1", "c2"], "left_semi")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), [])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
