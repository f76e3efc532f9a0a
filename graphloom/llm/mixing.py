"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh 5, 2, 1, repeating.  They share `share` of all words by weight; a source's
target stops at `most` times its size and the excess goes to the others by weight until none is above: that is the level at
which targets are min(most * size, level * weight), found from running sums over the sources sorted by size a weight.

A source's documents each are due c = target / size copies: floor(c) for certain, and one more with the fractional
probability.  These probabilities are rounded in dependence: two documents exchange expected words at random, in proportion that
keeps both expectations, until one probability is 0 or 1; the other goes on to the next pair.  The words expected of a source
never change; in the end the one document that is left is drawn with its probability, so a source is off by less than that document.  Documents
are paired in chunks of about `chunk`, by hash, from long to short, so that what a chunk leaves over, one document, tends to be
short; it goes up a reduction tree whose levels follow from the largest source's count.

Everything is DataFrame functions.  Rows of equal id, source, size and text are one unit of m rows, pre-aggregated: floor(m * p) of them are taken once more
for certain, and one row with what is left of m * p goes into the tree.  A hot source is many chunks.  All randomness is a hash of seed and unit: reruns agree.
Documents without words (null or empty) take 0; a source without words has target 0; an empty table gives no rows.
What is sorted as a whole is one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written

WEIGHTS, SHARE, MOST, CHUNK, SEED = (5.0, 2.0, 1.0), 1.5, 2, 96, 17


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("t"))


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, n (units with words), target.  The windows run over the sources alone."""
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))  # n: units
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights)))
    s = s.withColumns({"cap": F.col("source_size") * most, "all": F.sum("source_size").over(every) * share})
    ratio = F.col("cap") / F.col("weight")
    up = Window.orderBy(ratio, "k")
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # the first source below its cap sets the level; where there is none, all stand at their caps
    s = s.withColumn("level", F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("r"), F.col("k"), F.col("level").alias("v")))).over(every)["v"])
    target = F.when(F.col("level").isNull() | (ratio < F.col("level")), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "n", target.alias("target"))


def chance(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def round_chunk(level: int, seed: int) -> Column:
    """Pairs the sorted list u of (h, size, p) one after another.  out: the rounded ones with their bit; carry: what is left."""
    unit = "struct<h:bigint,size:bigint,p:double>"
    mass = lambda x: x["size"].cast("double")
    with_p = lambda x, p: F.struct(x["h"].alias("h"), x["size"].alias("size"), p.alias("p"))

    def meet(acc: Column, b: Column) -> Column:
        a, out = acc["carry"], acc["out"]
        a_up, b_down = (1 - a["p"]) * mass(a), b["p"] * mass(b)  # words that can go from b to a
        a_down, b_up = a["p"] * mass(a), (1 - b["p"]) * mass(b)
        to_a, to_b = F.least(a_up, b_down), F.least(a_down, b_up)
        rises = chance(F.lit(seed), F.lit(level), a["h"], b["h"]) * (to_a + to_b) < to_b
        bit = lambda x, v: F.array(with_p(x, F.lit(float(v))))
        end = lambda done, left: F.struct(left.cast(unit).alias("carry"), F.concat(out, done.cast(f"array<{unit}>")).alias("out"))
        up = F.when(a_up <= b_down, end(bit(a, 1), with_p(b, b["p"] - to_a / mass(b)))).otherwise(end(bit(b, 0), with_p(a, a["p"] + to_a / mass(a))))
        down = F.when(a_down <= b_up, end(bit(a, 0), with_p(b, b["p"] + to_b / mass(b)))).otherwise(end(bit(b, 1), with_p(a, a["p"] - to_b / mass(a))))
        return F.when(rises, up).otherwise(down)

    start = F.struct(F.get("u", F.lit(0)).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("out"))
    return F.aggregate(F.slice("u", F.lit(2), F.size("u")), start, meet)


def rounded(units: DataFrame, goal: DataFrame, *, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, t, m, source_size, target, base, extra for each unit: its rows are taken base times each, and extra of them once more."""
    n_sources, most = goal.agg(F.count("*"), F.max("n")).first()
    goal = F.broadcast(goal) if n_sources <= 100_000 else goal
    due = units.alias("u").join(goal.alias("g"), F.expr("u.source <=> g.source")).select("u.*", "source_size", "target", "n")
    due = due.withColumn("c", F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    due = due.withColumns({"base": F.floor("c"), "h": F.xxhash64(F.lit(seed), "doc_id", "source", "size", "t")}).withColumn("x", F.col("m") * (F.col("c") - F.col("base")))
    due = due.withColumns({"extra": F.floor("x"), "p": F.col("x") - F.floor("x")})
    live = due.where("p > 0").select("source", "h", "size", "p", F.ceil(F.col("n") / chunk).alias("chunks"))
    done, level, left = [], 0, max(most or 0, 1)
    while True:
        left = math.ceil(left / chunk)
        grouped = live.groupBy("source", "chunks", F.pmod(F.xxhash64(F.lit(level), "h"), "chunks").alias("c")).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "h", "size", "p"))).alias("u"))
        grouped = grouped.withColumn("u", F.transform("u", lambda x: F.struct(*[x[k].alias(k) for k in ("h", "size", "p")])))
        out = written(grouped.select("source", "chunks", round_chunk(level, seed).alias("r")).select("source", "chunks", "r.carry", "r.out"), "mixing", few=True)
        done.append(out.select(F.explode("out").alias("x")).select("x.h", F.col("x.p").cast("long").alias("bit")))
        rest = out.select("source", "chunks", "carry.*")
        if left <= 1:
            break
        live, level = rest.withColumn("chunks", F.ceil(F.col("chunks") / chunk)), level + 1
    bits = rest.select("h", (chance(F.lit(seed), F.lit("last"), "h") < F.col("p")).cast("long").alias("bit"))  # one document a source
    for d in done:
        bits = bits.unionByName(d)
    bits = bits.groupBy("h").agg(F.max("bit").alias("bit"))
    keep = ["doc_id", "source", "size", "t", "m", "source_size", "target", "base"]
    drawn = due.join(bits, "h", "left")
    return drawn.select(*keep, F.least("m", F.col("extra") + F.coalesce("bit", F.lit(0))).alias("extra"))


def plan(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Copies of each unit of docs; units come from one pass over the texts, kept as a small table."""
    units = written(sizes(docs).groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("m")), "units", few=True)
    return rounded(units, written(targets(units, weights, share, most), "targets", few=True), chunk=chunk, seed=seed)


def each_time(rows: DataFrame, n: str, block: int = 1000) -> DataFrame:
    """rows, each n times, in two steps, so that no long list is made."""
    many = rows.where(F.col(n) > 0).withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / block))))
    return many.withColumn("__k", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col(n) - F.col("__b") * block)))).drop("__b", "__k")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, with the columns of docs."""
    counts = plan(docs, **options).where("base > 0 or extra > 0").select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("t").alias("__t"), "m", "base", "extra")
    counts = written(counts, "counts", few=True)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("__i")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__n")) & (F.col("t") == F.col("__t"))
    both = sized.join(counts, same).drop("__i", "__s", "__n", "__t")
    if counts.where("m > 1").isEmpty():
        return each_time(both.select("__row", (F.col("base") + F.col("extra")).alias("n")), "n").select("__row.*")
    # rows of larger units are numbered in 64 parts each, kept in a table so that both passes see the same parts
    unit = ["doc_id", "source", "size", "t"]
    large = written(both.where("m > 1").withColumn("__p", F.pmod(F.monotonically_increasing_id(), F.lit(64))), "repeats")
    part = Window.partitionBy(*unit).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = large.groupBy(*unit, "__p").count().withColumn("__o", F.coalesce(F.sum("count").over(part), F.lit(0)))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*unit, "__p")]
    large = large.alias("l").join(before.alias("r"), on).select("l.*", "__o")
    rank = F.col("__o") + F.row_number().over(Window.partitionBy(*unit, "__p").orderBy(F.xxhash64("__row")))
    large = large.withColumn("__rank", rank).select("__row", (F.col("base") + (F.col("__rank") <= F.col("extra")).cast("long")).alias("n"))
    return each_time(both.where("m = 1").select("__row", (F.col("base") + F.col("extra")).alias("n")).unionByName(large), "n").select("__row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; a unit of several rows is given out again."""
    rows = plan(table(spark, sf_dir, "documents"))
    kinds = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("extra").alias("n")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("extra")).alias("n")))
    rows = each_time(rows.select("doc_id", "size", "source_size", "target", F.inline(kinds)), "n")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
