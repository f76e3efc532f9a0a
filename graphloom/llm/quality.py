"""Quality rules: hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Two multinomials over hashed word 1- and 2-grams: one of the trusted documents (label quality = 1), one of the whole corpus.
A document's score is the mean, over its n-grams, of log p_trusted - log p_raw; documents below a fixed threshold go.
Everything is DataFrame functions.  Counting explodes n-gram buckets into a partial aggregation, so a task shuffles at most
`buckets` rows whatever its input; the model is one array, a literal of the plan; scoring is a per-row fold without a shuffle.
The number of buckets follows the corpus, a power of two: one for each 8 KB of text, from `buckets` up to `most_buckets` (2 MB of numbers).

Verdicts are written before they are given out.  A filter or an aggregate right above the scoring would make the optimizer copy it into itself, again and again.

Null text or text without a word has no n-grams: score null, base_failed true, kept false.  Rows that repeat are judged each
for itself.  The trusted set is at most `max_trusted` labelled ids, those of smallest hash; corpus counts cover all documents.
With no trusted document all ratios are those of the smoothing alone.  An empty table gives no rows.
Repeated windows within a text are found by a 64-bit hash of five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, table, words, written

BUCKETS, MOST_BUCKETS, PER_BUCKET, MAX_TRUSTED, THRESHOLD, SMOOTHING = 1 << 14, 1 << 18, 1 << 13, 20_000, -0.09, 1.0


def joined(a: Column, b: Column, gap: int) -> Column:
    """Hashes of a's items with the items of b that stand `gap` places later."""
    n = F.greatest(F.size(b) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), F.least(n, F.size(a))), F.slice(b, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def bucket(h: Column, buckets: int) -> Column:
    """buckets: a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def hashed(rows: DataFrame) -> DataFrame:
    """rows with h1 and h2, the hashes of words (column w) and of pairs of neighbours."""
    return rows.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x))).withColumn("h2", joined(F.col("h1"), F.col("h1"), 1))


def bucket_count(docs: DataFrame, least: int, most: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(least, 1 << (size // PER_BUCKET).bit_length()), max(least, most))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float) -> list[float]:
    """log p_trusted - log p_raw by bucket, to six places.  Only these `buckets` numbers come to the driver."""
    marked = docs.select("doc_id", words(F.col("text")).alias("w")).join(F.broadcast(trusted.withColumn("hit", F.lit(1))), "doc_id", "left")
    each = hashed(marked).select("hit", F.explode(F.concat("h1", "h2")).alias("h")).select("hit", bucket(F.col("h"), buckets).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("hit").alias("good"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    one = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("m"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    mass = smoothing * buckets
    return one.select(F.transform("m", lambda x: F.log((x["good"] + smoothing) / (F.col("good") + mass)) - F.log((x["raw"] + smoothing) / (F.col("raw") + mass))).alias("model")).first()["model"]


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Distinct ids of trusted documents, `most` at most, by hash: a bounded sample of labelled rows."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def constant(model: list[float]) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")


def assess(
    docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, buckets: int = BUCKETS, most_buckets: int = MOST_BUCKETS, max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD, smoothing: float = SMOOTHING
) -> DataFrame:
    """The input row (all columns, or those of `keep`) as struct __row, with the base figures, the score and the verdict beside it: a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(texts, buckets, most_buckets)
    model = constant(log_ratios(texts, trusted_ids(labels, max_trusted), buckets, smoothing))
    # each step carries on what later ones need, and no text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("__row"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("__row", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    rows = rows.select(
        "__row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
    )
    base = ["__row", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(model, bucket(x, buckets)))
    rows = rows.select(*base, "h1", joined(F.col("h1"), F.col("h1"), 1).alias("h2"))
    rows = rows.select(*base, F.try_divide(total("h1") + total("h2"), F.size("h1") + F.size("h2")).alias("score"), "h1", joined(F.col("h2"), F.col("h2"), 2).alias("h4"))
    # five words repeat only where four do
    rows = rows.select(*base, "score", F.when(F.size(F.array_distinct("h4")) < F.size("h4"), joined(F.col("h4"), F.col("h1"), 4)).alias("h"))
    rows = rows.select(*base, "score", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = lambda i, j: F.coalesce(F.get("s", i)["x"] == F.get("s", j)["x"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    rows = rows.withColumn("at", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get("s", i)["i"])))).drop("s")
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return written(rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))), "verdicts")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    return assess(docs, labels, **options).where("kept").select("__row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return rows.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
