"""Benchmark decontamination: a prefix-filtered set join between item windows and documents.

A window is `window` consecutive words of an item; an item of fewer words is one window.  A window's set is its k-word
shingles (k = 3, or all its words if fewer).  Shingles are ordered by rarity in the corpus.  A window lies whole in a document only
if the document has every shingle of it, so one necessary prefix token, the rarest shingle, is joined.  A match at word p,
with the shingle at offset o of the window, can only start at p - o: it must be at least 0 (positional bound) and leave the
window's length within the document (length bound).  What is left is verified by comparing the words.

Everything is DataFrame functions.  Documents are exploded into shingle hashes and looked up in a broadcast table of windows
while the words are at hand in the same row, so only hits are shuffled.  What is broadcast, shingles with their counts and windows with their words, is
added up beforehand and sent only up to `max_broadcast` bytes; beyond that both sides are shuffled by shingle.  Shingles that make up more than a thousandth of the
corpus, a thousand at most, are then salted: their windows go to `SALTS` keys each, their places to one of them.

Null or wordless documents have no words and no hits; null or wordless items have no windows.  A null item_id's windows mark
words but add no item.  Rows with equal id and text get the same figures each; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, packed, table, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE, MAX_BROADCAST, SALTS = 10, 3, 64 << 20, 16


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, and the words of each window."""
    w = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    return w.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("window")).distinct()


def occurrences(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each place of a document where a window occurs: doc_id, text_hash, item_id, start, len."""
    windows = item_windows(items, window)
    found = None
    # at most SHINGLE rows; a shingle is sent with its count (40 bytes), a window with its words (16 bytes beside each, 80 in all)
    k_of, octets = F.least(F.size("window"), F.lit(SHINGLE)), F.octet_length(F.array_join("window", ""))
    sizes = windows.groupBy(k_of.alias("k")).agg(F.sum(40 * (F.size("window") - k_of + 1) + octets + 16 * F.size("window") + 80).alias("bytes")).collect()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("w"))
    for k, n in sorted((r["k"], r["bytes"]) for r in sizes):
        sent = n <= max_broadcast
        small = F.broadcast if sent else (lambda df: df)
        # a window as its shingles; the corpus tells how rare each is
        own = windows.where(k_of == k)
        parts = own.select("item_id", "window", F.posexplode(shingles(F.col("window"), k)).alias("o", "token"))
        tokens = parts.select("token").distinct()
        df = texts.select(F.explode(shingles(F.col("w"), k)).alias("token")).join(small(tokens), "token").groupBy("token").count()
        rarest = parts.join(small(df), "token").groupBy("item_id", "window").agg(F.min(F.struct("count", "token", "o")).alias("p"), F.count("*").alias("seen"))
        # a shingle that no document has rules its window out
        prefix = rarest.where(F.col("seen") == F.size("window") - k + 1).select("item_id", "window", "p.token", "p.o", "p.count")
        placed = texts.select("doc_id", "text_hash", "w", F.posexplode(shingles(F.col("w"), k)).alias("p", "token"))
        on = ["token"]
        if sent:
            placed = placed.withColumns({"lo": F.lit(0), "n": F.size("w")})
        else:  # the words next to the shingle go along, not the document
            lo = F.greatest(F.col("p") - window + 1, F.lit(0))
            placed = placed.select("doc_id", "text_hash", "p", "token", lo.alias("lo"), F.size("w").alias("n"), F.slice("w", lo + 1, F.lit(2 * window)).alias("w"))
            prefix = written(prefix, "windows")
            total = texts.agg(F.sum(F.greatest(F.size("w") - k + 1, F.lit(0)))).first()[0] or 0
            common = F.col("count") * 1000 > total
            hot = prefix.where(common).select("token").distinct().withColumn("hot", F.lit(True))  # a thousand at most, as their counts add up to the total
            placed = placed.join(F.broadcast(hot), "token", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_hash", "p"), F.lit(SALTS))).otherwise(0)).drop("hot")
            prefix = prefix.withColumn("salt", F.explode(F.when(common, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
            on = ["token", "salt"]
        start, length = F.col("p") - F.col("o"), F.size("window")
        hit = placed.join(small(prefix.drop("count")), on).where((start >= 0) & (start + length <= F.col("n"))).where(F.slice("w", F.greatest(start - F.col("lo") + 1, F.lit(1)), length) == F.col("window"))
        hit = hit.select("doc_id", "text_hash", "item_id", start.alias("start"), length.alias("len"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, len int")
    return found


def marks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The input row as struct __row with n_words, n_hit, n_items, items (sorted strings) and contaminated beside it."""
    hits = occurrences(docs, items, **options)
    places = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    begun = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    count = F.aggregate(F.array_sort("at"), begun, lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n")), lambda a: a["n"])
    places = places.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), count.alias("n_hit"), "items")
    rows = packed(docs, "doc_id", "text").select("__row", "doc_id", F.xxhash64("text").alias("text_hash"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left")
    rows = rows.select("__row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return marks(docs, items, **options).where(~F.col("contaminated")).select("__row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    # only the id stays of the row, so no text is shuffled
    return rows.select("__row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s : s + least(10, len(w)) - 1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM (SELECT doc_id, s, n, w[s : s + n - 1] AS x FROM places) p JOIN win USING (x)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
