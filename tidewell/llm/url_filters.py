"""URL filters: host rules first, then a tree of path templates (DataFrame functions only).

Per host, urls are grown into templates one path segment at a time. Under a template a segment that is a number or a
code (digits mixed in) becomes the wildcard `*`. Sibling branches are then compared by two-sample tests on their
labelled bad shares: a branch against all its siblings, which tells branches that are worse, better or alike; and each
worse (better) branch against the other worse (better) ones. Branches that are alike, and rare ones, are merged into `*`,
worse ones that don't differ from each other into `(+)`, better ones into `(-)`; a branch by itself keeps its segment.
Where fewer urls go on than a branch needs, they make one last wildcard; else paths are grown to their last segment.

A merged branch that differs from its siblings decides by its own labels, others go by their parent. Its share of bad labels is
smoothed towards its parent's, that of a host towards the share of all labels. A url is blocked where this share reaches
the threshold. Half of the labelled documents, by id hash, make the tree; the other half choose the threshold: the least of
`STEPS` of the way from the share of all labels to 1 that the held-out labels of the urls blocked by it confirm (their share,
smoothed alike, reaches it as well). Where they confirm none, the tree blocks nothing.

Rules are (host suffix, path prefix, verdict); the longest host, then the longest path wins. They are few and fixed.

Defined cases
* null url or one without `://`: host, path and rule are empty or null; judged by the (empty) template, thus allowed
  unless its labels say otherwise.
* a url's labels are those of the document whose number its last segment gives; urls without one are unlabelled.
* repeated or null page_id: every row is judged by itself. No labels: all allowed.
* ties: shares that equal the threshold block; branches that equal the needed difference are alike.
* hosts differ by case only in A-Z; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_path, table, written

#: The rules of the contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: A branch stays a segment of its own from so many urls.
MIN_BRANCH = 5
#: Smoothing weight (in labelled urls), and standard errors by which branches must differ.
PRIOR, Z = 10.0, 2.0
#: Candidate thresholds, as parts of the way from the share of all labels to 1.
STEPS = (0.125, 0.25, 0.5, 0.75)
SALTS = 32


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, up to `/`, `?`, `#`; then up to `?`, `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as `host` + `path`, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """urls, labelled and bad (of the labels that make the tree) per key; salted, so that one host is counted in many tasks."""
    salted = rows.groupBy(*keys, F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).alias("salt"))
    part = salted.agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.sum(F.coalesce("bad", F.lit(0))).alias("b"))
    return part.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "l", "b")))


def _differs(l: Column, b: Column, more_l: Column, more_b: Column, share: float) -> Column:  # noqa: E741
    """+1, -1 or 0: whether the bad share of (l, b) is above, below or like that of the others (more_l, more_b), both smoothed."""
    p = (b + more_b + PRIOR * share) / (l + more_l + PRIOR)
    gap = (b + PRIOR * p) / (l + PRIOR) - (more_b + PRIOR * p) / (more_l + PRIOR)
    error = Z * F.sqrt(p * (1 - p) * (1 / (l + PRIOR) + 1 / (more_l + PRIOR)))
    return F.when((l == 0) | (more_l == 0), 0).when(gap > error, 1).when(gap < -error, -1).otherwise(0)


def _branches(counts: DataFrame, share: float) -> DataFrame:
    """host, template, seg -> to (the merged branch), l and b of it, side (its difference from its siblings), visits."""
    at = ["host", "template"]
    family = counts.groupBy(*at).agg(F.sum("n").alias("visits"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
    counts = counts.join(family, at)
    alone = _differs(F.col("l"), F.col("b"), F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b"), share)
    counts = counts.withColumn("side", F.when(F.col("n") < MIN_BRANCH, 0).otherwise(alone))
    pool = counts.groupBy(*at, "side").agg(F.count("*").alias("k"), F.sum("l").alias("side_l"), F.sum("b").alias("side_b"))
    counts = counts.join(pool, [*at, "side"])
    apart = _differs(F.col("l"), F.col("b"), F.col("side_l") - F.col("l"), F.col("side_b") - F.col("b"), share)
    own = ((F.col("k") == 1) & (F.col("n") >= MIN_BRANCH)) | ((F.col("side") != 0) & (apart != 0))
    to = F.when(own, F.col("seg")).when(F.col("side") == 0, "*").when(F.col("side") > 0, "(+)").otherwise("(-)")
    counts = counts.withColumn("to", to)
    merged = counts.groupBy(*at, "to").agg(F.sum("l").alias("to_l"), F.sum("b").alias("to_b"))
    out = counts.drop("side").join(merged, [*at, "to"])
    side = _differs(F.col("to_l"), F.col("to_b"), F.col("all_l") - F.col("to_l"), F.col("all_b") - F.col("to_b"), share)
    return out.select(*at, "seg", "to", "to_l", "to_b", side.alias("side"), "visits")


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page rows (page_id, host, path) with the template, the one that decides, its bad share and the verdict."""
    host, path = parts(F.col("url"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("mark")
    )
    fits = F.pmod(F.xxhash64("label_id"), F.lit(2)) == 0
    marks = marks.select("label_id", F.when(fits, F.col("mark")).alias("bad"), F.when(~fits, F.col("mark")).alias("held"))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.when(number != "", number.cast("long")).alias("label_id"))
    rows = rows.join(marks, "label_id", "left").drop("label_id")
    segments = F.filter(F.split("path", "/", -1), lambda x: x != "")
    rows = rows.withColumn("segments", segments).withColumn("template", F.lit("/"))
    rows = written(rows, "urls")
    everything = rows.agg(F.count("bad"), F.sum("bad")).first()
    share = (everything[1] or 0) / everything[0] if everything[0] else 0.0
    # tables of their own, so that the joins are free to split hot hosts
    top = written(_counted(rows, ["host"]).select("host", ((F.col("b") + PRIOR * share) / (F.col("l") + PRIOR)).alias("purity")), "hosts")
    rows = rows.join(top, "host").withColumns({"own": F.lit("/"), "finished": F.size("segments") == 0})
    spark, depth, paths = pages.sparkSession, 0, []
    while True:
        # one write a level: the plans stay small however deep the paths are
        paths.append(fresh_path(spark, "urls"))
        rows.write.option("compression", "zstd").parquet(paths[-1])
        reader = spark.read.schema(rows.schema)
        rows = reader.parquet(paths[-1]).filter("not finished")
        if rows.isEmpty():
            break
        seg = F.get("segments", F.lit(depth))
        code = seg.rlike(r"[0-9]") | (F.length(seg) > 40)
        rows = rows.withColumn("seg", F.when(code, F.regexp_replace(seg, r"^[^.]*", "*")).otherwise(seg))
        branches = written(_branches(_counted(rows, ["host", "template", "seg"]), share), "branches")
        rows = rows.join(branches, ["host", "template", "seg"])
        next_ = F.concat("template", "to", F.lit("/"))
        rows = rows.select(
            "page_id", "host", "path", "bad", "held", "segments",
            next_.alias("template"),
            F.when(F.col("side") != 0, (F.col("to_b") + PRIOR * F.col("purity")) / (F.col("to_l") + PRIOR)).otherwise(F.col("purity")).alias("purity"),
            F.when(F.col("side") != 0, next_).otherwise(F.col("own")).alias("own"),
            ((F.size("segments") <= depth + 1) | (F.col("visits") < MIN_BRANCH)).alias("finished"),
        )
        depth += 1
    rows = reader.parquet(*paths).filter("finished")
    threshold = _threshold(rows, share)
    blocked = F.col("purity") >= threshold if threshold is not None else F.lit(False)
    return rows.select(
        "page_id", "host", "path", "template", F.col("own").alias("decided_by"), F.col("purity").alias("bad_share"),
        F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("method_verdict"),
    )


def _threshold(rows: DataFrame, share: float) -> float | None:
    """The least candidate that the held-out labels confirm."""
    candidates = [share + f * (1 - share) for f in STEPS]
    hit = [F.col("purity") >= t for t in candidates]
    sums = rows.agg(*(F.count(F.when(h, F.col("held"))) for h in hit), *(F.sum(F.when(h, F.col("held"))) for h in hit)).first()
    for t, n, bad in zip(candidates, sums, sums[len(STEPS) :]):
        if n and (bad + PRIOR * share) / (n + PRIOR) >= t:
            return t
    return None


def filtered_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    out = templates(pages, labels)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return out.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "method_verdict").alias("verdict"),
        "template", "decided_by", "bad_share",
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
