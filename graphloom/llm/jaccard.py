"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles (five lower-cased words), as 64-bit hashes.  Documents with equal sets are one class from the start:
only a class's digest goes on, so copies never meet each other.

Signatures.  Tokens are ordered rare class first, then frequent class, each by hash.  A set of n tokens that is similar to another misses at most
e = n - ceil(0.8 n) of its tokens there.  Its prefix is extended until deleting any e tokens leaves a signature: rare tokens are signatures by
themselves and count 1 each; frequent tokens are split by hash into sub-classes, every pair of prefix tokens of one sub-class is a signature, and a sub-class
with x prefix tokens counts x - 1.  The count must reach e + 1.  As both prefixes follow one order, the tokens that two similar sets share in the
shorter prefix lie in both, so they share a signature: no link is lost.  The number of sub-classes follows from the set's size level (powers of 1.25), and as similar
sets are at most one level apart, frequent pairs are made for the own and the next level.

Classes.  Frequencies come from one counting sketch over all documents: a counter for each KB of text, from `width` up to 8 times that (32 MB a task).  Any classes are
correct; they only decide how selective the signatures are.

Candidates.  Signatures are shuffled and sorted; a run of one signature is read as a stream, never held.  Runs of up to `small` classes give all pairs whose sizes
fit.  Longer runs give star pairs with their first four members (for one in `thin` of the signatures), and their members go to the family that is named after the first.  After the
first components are known, only members outside a family's largest component are compared with members of its other components, in blocks of at most `BLOCK` members by
`BLOCK`, so that a family is many tasks.  Nothing is capped or dropped; a family that falls apart into many components costs the square of its members in comparisons of
fingerprints, not in rows.

Verification.  Each class has a fingerprint of two to four bits a shingle, which bounds what two sets can share from above; pairs that it rules out go first.  For the others, it computes the sets again from the texts of class representatives and compares exactly.  Components are found by alternating large-star
and small-star steps over written tables.

Null, empty or wordless documents have no shingles and are alone; with fewer words than five the whole sequence is the one shingle.  Repeated rows
and equal texts share a component.  A null id takes part, and its component is the smallest id that is not null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, written

WORDS, TIMES, OF = 5, 100, 80  # links: TIMES * intersection >= OF * union
WIDTH, SMALL, THIN, FREQUENT, BITMAP, MAX_BROADCAST, BLOCK, MADE = 1 << 20, 16, 8, 64, 256, 1_000_000, 256, 400_000
A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * B
    return (x ^ (x >> np.uint64(29))) * A


class Words(dict):
    """Word to 64-bit hash; emptied when large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = Words()


def rest() -> None:
    """At a task's end: an idle worker holds no words and no unused Arrow memory."""
    _words.clear()
    pa.default_memory_pool().release_unused()


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes.  bytes.lower() and bytes.split() know A-Z and the six white-space bytes only."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([_words[x] for x in w], np.uint64)
    m = min(width, len(h))
    n = len(h) - m + 1
    x = np.full(n, m, np.uint64)
    for k in range(m):
        x = x * A + h[k : k + n]
    return np.unique(mix(x))


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def signatures(t: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set; frequent: a flag for each.  Sets of under four tokens link with equal sets only; four tokens link with themselves and one more."""
    n = len(t)
    need = n - math.ceil(n * OF / TIMES) + 1
    if n < 4:
        return np.zeros(0, np.uint64)
    rare = t[~frequent][:need]
    if len(rare) == need:
        return rare
    often, out = t[frequent], [rare]
    level = math.floor(math.log(n) / math.log(TIMES / OF))
    for v in (level, level + 1):
        classes = max(1, math.floor((TIMES / OF) ** v / 8))
        cls = (mix(often ^ np.uint64(v)) >> np.uint64(20)) % np.uint64(classes)
        later = np.ones(len(often), bool)
        later[np.unique(cls, return_index=True)[1]] = False
        x = int(np.searchsorted(np.cumsum(later), need - len(rare))) + 1
        tok, c = often[:x], cls[:x]
        by = np.argsort(c, kind="stable")
        tok, c = tok[by], c[by]
        for gap in range(1, len(tok)):  # pairs at this distance within one sub-class
            same = c[gap:] == c[:-gap]
            if not same.any():
                break
            out.append(mix(tok[:-gap][same] * A + mix(tok[gap:][same] + np.uint64(v))))
    return np.unique(np.concatenate(out))


def fingerprint(tokens: np.ndarray) -> np.ndarray:
    """Bits, two to four times as many as tokens and a power of two: each token flips one.  Sets differ in at least as many tokens as their fingerprints in bits."""
    wide = max(BITMAP, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else BITMAP
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % wide, minlength=wide) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    col = batch.column(batch.schema.get_field_index(column))
    for lo in range(0, len(col), 1000):
        yield from col.slice(lo, 1000).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest and fingerprint of each row; and, with a null digest, the partition's sketch in pieces (n: the piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(width, np.uint32), ["doc_id", "n", "digest", "bits", "sketch"]
        for b in batches:
            sizes, digests, prints = [], [], []
            for text in texts_of(b):
                t = shingle_set(text)
                prints.append(fingerprint(t))
                np.add.at(counts, (t >> np.uint64(44)).astype(np.int64) % width, 1)
                sizes.append(len(t))
                digests.append(digest(t))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary())], names=names)
        rest()
        pieces = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(np.split(counts, 64)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pieces), pa.int64()), pa.array([k for k, _ in pieces], pa.int64()), pa.nulls(len(pieces), pa.int64()), pa.nulls(len(pieces), pa.list_(pa.int64())), pa.array([c for _, c in pieces], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest long, bits array<long>, sketch binary")


def frequent_buckets(sketches: DataFrame, width: int, least: int) -> np.ndarray:
    """Flags, packed to width / 8 bytes.  The pieces are summed by Spark; 64 pieces of fixed size come to the driver."""

    def add(key: tuple, tab: pa.Table) -> pa.Table:
        total = np.zeros(width // 64, np.uint64)
        for raw in tab.column("sketch").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        return pa.table({"n": pa.array([key[0].as_py()], pa.int64()), "sketch": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(width, np.uint64)
    for r in sketches.groupBy("n").applyInArrow(add, "n long, sketch binary").collect():
        total[r["n"] * (width // 64) : (r["n"] + 1) * (width // 64)] = np.frombuffer(r["sketch"], np.uint64)
    return total >= max(least, 3 * float(total.mean()))


def candidates(docs: DataFrame, flags: np.ndarray, small: int, thin: int) -> DataFrame:
    """Rows (a, b, family): pairs to verify (family false), or a long run's leader and member (family true)."""
    shared, width = docs.sparkSession.sparkContext.broadcast(np.packbits(flags)), len(flags)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = np.unpackbits(shared.value, count=width).astype(bool), set()
        for b in batches:
            sigs, owners, sizes = [], [], []
            for text in texts_of(b):
                t = shingle_set(text)
                if len(t) < 4 or (d := digest(t)) in seen:
                    continue
                seen.add(d)  # of this task's documents
                s = signatures(t, often[(t >> np.uint64(44)).astype(np.int64) % width])
                sigs.append(s)
                owners.append(np.full(len(s), d, np.int64))
                sizes.append(np.full(len(s), len(t), np.int32))
                if len(sigs) >= 500:
                    yield pa.RecordBatch.from_arrays([signed(np.concatenate(sigs)), signed(np.concatenate(owners)), signed(np.concatenate(sizes))], names=["sig", "d", "n"])
                    sigs, owners, sizes = [], [], []
            if sigs:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(sigs)), signed(np.concatenate(owners)), signed(np.concatenate(sizes))], names=["sig", "d", "n"])
        rest()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by signature and class: what one run holds is at most `small` members, and `MADE` rows that were given out already."""
        now, held, leads, last, out, made = None, [], [], None, [], set()

        def give(row: tuple[int, int, bool]) -> None:
            """Once, as far as is remembered."""
            if row not in made:
                if len(made) >= MADE:
                    made.clear()
                made.add(row)
                out.append(row)

        def pair(x: tuple[int, int], y: tuple[int, int]) -> None:
            lo, hi = sorted((x[1], y[1]))
            if TIMES * lo >= OF * hi and x[0] != y[0]:
                p = (min(x[0], y[0]), max(x[0], y[0]), False)
                give(p)

        def close() -> None:
            for k, x in enumerate(held):
                for y in held[:k]:
                    pair(x, y)

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.bool_())], names=["a", "b", "family"])
            out.clear()
            return got

        def member(sig: int, x: tuple[int, int]) -> None:
            give((leads[0][0], x[0], True))
            if sig % thin == 0:
                for y in leads:
                    pair(y, x)

        for b in batches:
            sig, d, n = (c.to_numpy() for c in b.columns)
            # most signatures stand alone: go on to runs only
            same = np.zeros(len(sig), bool)
            same[1:] = sig[1:] == sig[:-1]
            live = same.copy()
            live[:-1] |= same[1:]
            if len(sig):
                live[0] = live[-1] = True
            for s, x in zip(sig[live].tolist(), zip(d[live].tolist(), n[live].tolist(), strict=True), strict=True):
                if s != now:
                    close()
                    now, held, leads, last = s, [x], [], x
                elif x != last:
                    last = x
                    if held:
                        held.append(x)
                        if len(held) > small:
                            leads = held[:4]
                            for y in held:
                                member(s, y)
                            held = []
                    else:
                        member(s, x)
            if len(out) >= 50_000:
                yield batch()
        close()
        yield batch()

    rows = docs.select("text").mapInArrow(sign, "sig long, d long, n int")
    rows = rows.repartition("sig").sortWithinPartitions("sig", "d")
    return rows.mapInArrow(runs, "a long, b long, family boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it reaches) for every node of edges (a, b)."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges", few=True)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, e = e, written(small.where("a <> b").distinct(), "edges", few=True)
        forget(old)
        new = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    own = e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return own.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, tokens for the wanted (d, doc_id) representatives: no others' sets are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingle_set(t) for t in texts_of(b)]
            for lo in range(0, len(own), 500):
                part = own[lo : lo + 500]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("d")).slice(lo, 500), pa.array([t.tobytes() for t in part], pa.binary()), pa.array([digest(t) for t in part], pa.int64())], names=["d", "tokens", "own"])
        rest()

    few = F.broadcast if wanted.count() <= MAX_BROADCAST else (lambda df: df)  # two numbers a row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(wanted), F.col("doc_id").eqNullSafe(F.col("rep"))).select("d", "text")
    rows = rows.mapInArrow(run, "d long, tokens binary, own long").where("d = own")  # an id may have other texts
    return rows.select("d", "tokens").dropDuplicates(["d"])


def differing(x: str, y: str) -> Column:
    """Bits in which two fingerprints differ, the longer one folded to the other's length; sizes that fit are at most one doubling apart."""
    fold = lambda a, b: F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))
    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def room(nx: str, ny: str, bx: str, by: str) -> Column:
    """Whether sizes and fingerprints leave room for a link: sets share at most half of what their sizes add up to less the differing bits."""
    both = F.col(nx) + F.col(ny)
    return (TIMES * F.least(nx, ny) >= OF * F.greatest(nx, ny)) & ((TIMES + OF) * (both - differing(bx, by)) >= 2 * OF * both)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that have room for a link."""
    a = classes.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    b = classes.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(a, "a").join(b, "b").where(room("na", "nb", "xa", "xb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = TIMES * both >= OF * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    x = sets.select(F.col("d").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("d").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a family's members outside its largest component with members of other components, as far as fingerprints leave room for a link.

    A family of n members is dealt into about n / BLOCK parts on either side, by hash, and every two parts meet under a key of their own, so a key has about 2 * BLOCK
    rows and a row goes to n / BLOCK keys.  A pair that is ruled out is never a row."""
    parts = placed.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.max(F.col("out").cast("int")).alias("any")).where("any = 1").drop("any")
    own = placed.join(parts, "family").join(classes.select("d", "n", "bits"), "d")
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "d"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = own.where("out").select("family", part("x").alias("i"), every.alias("j"), F.col("d").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    y = own.select("family", every.alias("i"), part("y").alias("j"), F.col("d").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    met = x.join(y, ["family", "i", "j"]).where((F.col("cx") != F.col("cy")) & room("nx", "ny", "bx", "by"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def sketch_width(docs: DataFrame, least: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(least, 1 << (size >> 10).bit_length()), 8 * least)


def classified(docs: DataFrame, *, width: int = WIDTH, small: int = SMALL, thin: int = THIN, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest), one for each document; and (d, comp, component_id) for each class."""
    width = sketch_width(docs, width)
    first = written(profile(docs, width), "sets")
    sets = first.where("digest is not null").select("doc_id", "n", "digest", "bits")
    flags = frequent_buckets(first.where("digest is null"), width, frequent)
    classes = sets.where("n > 0").groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = written(classes, "classes", few=True)
    found = written(candidates(docs, flags, small, thin), "candidates", few=True)
    pairs, members = written(possible(found.where("not family").select("a", "b"), classes), "pairs", few=True), found.where("family").select("a", "b")

    def proven(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct()
        tokens = written(token_sets(docs, nodes.join(classes.select("d", "rep"), "d")), "tokens", few=True)
        links = written(verified(pairs, tokens), "links", few=True)
        forget(pairs, tokens)
        return links

    links = proven(pairs)
    comp = components(links)
    if not members.isEmpty():
        fam = members.select(F.col("a").alias("family"), F.col("b").alias("d"))
        placed = fam.join(comp.select(F.col("node").alias("d"), "comp"), "d", "left").withColumn("comp", F.coalesce("comp", "d"))
        main = placed.groupBy("family", "comp").count().groupBy("family").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
        placed = written(placed.join(main, "family").select("family", "d", "comp", (F.col("comp") != F.col("main")).alias("out")), "families", few=True)
        more = proven(written(across(placed, classes), "pairs", few=True))
        forget(placed)
        comp = components(links.unionByName(more))
        forget(more)
    forget(found, links)
    comp = classes.join(comp, F.col("d") == F.col("node"), "left").select("d", "rep", F.coalesce("comp", "d").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return sets.drop("bits"), comp.join(least, "comp").select("d", "comp", "component_id")


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    sets, named = classified(docs, **options)
    rows = sets.join(named.drop("comp"), sets["digest"] == named["d"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that with the smallest id (null last), then digest, then row hash.  Rows without words all stay, and of rows that repeat one of them, one."""
    sets, named = classified(docs, **options)
    least = sets.join(named, sets["digest"] == named["d"]).groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k"))
    best = least.select("k.doc_id", "k.digest", F.lit(True).alias("__one"))
    wordless = sets.where("n = 0").select("doc_id", "digest", F.lit(False).alias("__one")).distinct()
    ids = sets.groupBy(F.col("doc_id").alias("__j")).agg((F.min("digest") != F.max("digest")).alias("__many"))  # ids of several texts
    keep = best.unionByName(wordless).join(ids, F.col("doc_id").eqNullSafe(F.col("__j")))
    keep = written(keep.select(F.col("doc_id").alias("__i"), F.col("digest").alias("__k"), "__one", "__many"), "kept", few=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__d"))
    rows = rows.join(keep, F.col("__d").eqNullSafe(F.col("__i")))
    if not keep.where("__many").isEmpty():
        rows = rows.where("not __many").unionByName(own_digest(rows.where("__many")))
    rows = rows.withColumn("__h", F.xxhash64("__row"))
    rows = rows.groupBy("__d", "__k", F.when(F.col("__one"), F.lit(0)).otherwise(F.col("__h")).alias("__g")).agg(F.min_by("__row", "__h").alias("__row"))
    return rows.select("__row.*")


def own_digest(rows: DataFrame) -> DataFrame:
    """Rows whose text has the digest __k."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([digest(shingle_set(t)) for t in texts_of(b, "__text")], pa.int64())
            yield b.filter(pc.equal(own, b.column(b.schema.get_field_index("__k")))).select(names)
        rest()

    return rows.withColumn("__text", F.col("__row.text")).mapInArrow(run, rows.schema)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
