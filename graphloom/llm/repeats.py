"""Substring dedup: every byte covered by a string of `length` bytes that also starts anywhere else goes; strings of `passage` bytes that do so are reported.

Shards' suffix orders are merged by interleave refinement; no suffix of the corpus is ever sorted again as a whole.

Pre-filter.  A window's anchor is the position of the smallest 8-byte hash, the leftmost on ties, among its first `REACH` positions, so equal windows have
equal anchors, at equal places, and equal cores: the passage - REACH + 1 bytes from the anchor on, which lie in every window with that anchor.  Windows of `passage` bytes
with one anchor form a run; its extent goes on to the end of the windows of `length` bytes that begin in it, or of the text.  Each shard counts its runs by core and the merge adds the counts: a core that occurs once rules out all windows of its run (proof: an
equal window would have its core).  Cores are compared by 64-bit polynomial hashes.

Merge.  What is left are intervals: the suffixes that begin with one core, from all shards.

1. Runs that are equal as a whole to another run of their interval repeat.  A shard settles what it holds twice and sends one run for each content; the
   others are shuffled by content, sorted, and compared with their neighbours as a stream.  One run for each content goes on.
2. An interval with unequal runs is merged symbol by symbol (`interleave`).  The interleave vector says which run stands at which place; a step
   reads the symbol before each run's suffix (its Burrows-Wheeler symbol) and deals the places out by it, stably: that is the LF mapping, and turns the order of
   suffixes into the order of those one symbol longer.  Common prefixes follow by recurrence: two neighbours with equal symbols share one more than the least
   value between their old places.  Steps begin at the last byte of the extents, and go down to the first one.  After the step at a window's first byte,
   neighbours that share at least the rest of the window, as it is for either length, lie in one repeated interval, and the window repeats.  This compares bytes, not hashes.

An interval of more than `most` runs of different content is not held: its windows are shuffled one by one, by a 64-bit hash, and compared with their neighbours as a
stream.  That is exact for any size of interval, only slower.

Between the steps, bit sets of cores go to the executors, 16 bits a core.  Where they would be larger than `bits`, cores are dealt into rounds, each with a
set and a pass over the texts of its own.  A false hit costs rows and is weeded out by the comparison.

Null texts are empty; texts below `length` bytes are kept whole.  Texts are cut into overlapping pieces of `PIECE` bytes, so memory is bounded for any
length.  Rows that repeat an id, or have none, are documents of their own.  An empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, written

LENGTH, PASSAGE, REACH, PIECE, BITS, MOST = 400, 256, 128, 1 << 20, 1 << 28, 1 << 15
K = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
LETTERS = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)  # an odd number for each byte
BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 2 * PIECE + 2 * LENGTH)
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K
    return x ^ (x >> np.uint64(33))


class Runs:
    """Runs of a block of text pieces: piece (its number), at (first window in the block), n (windows), anchor, end (of the extent)."""

    def __init__(self, pieces: list[bytes], length: int, passage: int):
        self.raw = b"".join(pieces) + b"\0" * 8
        raw = np.frombuffer(self.raw, np.uint8)
        self.core_size, size = passage - REACH + 1, len(raw) - 8
        up, self.down = powers(size + 1)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(LETTERS[raw[:size]] * up[:size], out=self.sums[1:])
        gram = np.ndarray((size,), "<u8", raw.tobytes(), strides=(1,))
        low = (mixed(gram * K + K) & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
        for k in range(REACH.bit_length() - 1):  # minima of 2, 4, .. REACH neighbours
            step = 1 << k
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        self.begin = ends - [len(p) for p in pieces]
        good = np.zeros(len(anchor), bool)
        for a, z in zip(self.begin.tolist(), ends.tolist(), strict=True):
            good[a : max(a, min(a + PIECE, z - passage + 1))] = True
        where = np.flatnonzero(good)
        own = anchor[where]
        first = np.ones(len(where), bool)
        first[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1] + 1)
        start = np.flatnonzero(first)
        self.at, self.anchor = where[start], own[start]
        self.n = np.diff(np.append(start, len(where)))
        self.piece = np.searchsorted(ends, self.at, side="right")
        self.end = np.minimum(self.at + self.n - 1 + length, ends[self.piece])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def core(self) -> np.ndarray:
        return self.hashes(self.anchor, self.anchor + self.core_size)

    def full(self) -> np.ndarray:
        """Of the extent, the anchor's place in it and the number of windows."""
        return mixed(self.hashes(self.at, self.end) + ((self.anchor - self.at) * (1 << 20) + self.n).astype(np.uint64) * K)


def blocks(batches: Iterator[pa.RecordBatch], length: int, passage: int) -> Iterator[tuple[list[int], list[int], Runs]]:
    """Row keys and offsets of pieces, and their runs, about PIECE bytes at a time.  Columns: key, text."""
    keys, starts, pieces, size = [], [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            for key, text in zip(batch.column(0).slice(lo, 500).to_pylist(), batch.column(1).slice(lo, 500).to_pylist(), strict=True):
                raw = (text or "").encode()
                for a in range(0, len(raw) - passage + 1, PIECE):
                    piece = raw[a : a + PIECE + length - 1]
                    if size + len(piece) > PIECE and pieces:
                        yield keys, starts, Runs(pieces, length, passage)
                        keys, starts, pieces, size = [], [], [], 0
                    keys.append(key)
                    starts.append(a)
                    pieces.append(piece)
                    size += len(piece)
    if pieces:
        yield keys, starts, Runs(pieces, length, passage)


def longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def counted(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """Cores of two or more runs: core, uneven (whether its runs differ), runs (a bound on the number of different ones)."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, runs in blocks(batches, length, passage):
            core, full = runs.core().view(np.int64), runs.full().view(np.int64)
            if not len(core):
                continue
            by = np.lexsort((full, core))  # the block's own suffixes in order of their intervals
            core, full = core[by], full[by]
            first = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
            last = np.append(first[1:], len(core)) - 1
            new = np.cumsum(np.append(True, (core[1:] != core[:-1]) | (full[1:] != full[:-1])))
            yield pa.RecordBatch.from_arrays(longs(core[first], last - first + 1, full[first], full[last], new[last] - new[first] + 1), names=["core", "n", "lo", "hi", "runs"])

    each = rows.mapInArrow(shard, "core long, n long, lo long, hi long, runs long")
    sums = each.groupBy("core").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("runs").alias("runs"))
    return sums.where("n > 1").select("core", (F.col("lo") != F.col("hi")).alias("uneven"), "runs")


def bit_set(cores: DataFrame, bits: int) -> np.ndarray:
    """Two bits a core in a set of fixed size, put together by Spark in pieces of 4 KB."""
    part = min(bits, 1 << 15)

    def fold(key: tuple, tab: pa.Table) -> pa.Table:
        own = np.zeros(part, np.uint8)
        own[tab.column("bit").to_numpy()] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([np.packbits(own).tobytes()], pa.binary())})

    h = F.xxhash64("core")
    places = cores.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 20), F.lit(bits)))).alias("p"))
    places = places.select((F.col("p") / part).cast("int").alias("piece"), F.pmod("p", F.lit(part)).cast("int").alias("bit")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy("piece").applyInArrow(fold, "piece int, raw binary").toLocalIterator():
        out[r["piece"] * part // 8 : (r["piece"] + 1) * part // 8] = np.frombuffer(r["raw"], np.uint8)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first `keys` columns, in batches of about `size` that end with a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < size:
            continue
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        differs = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            c = b.column(k).to_numpy()
            differs |= c[1:] != c[:-1]
        ends = np.flatnonzero(differs)
        held = [b]
        if len(ends):
            yield b.slice(0, int(ends[-1]) + 1)
            held = [b.slice(int(ends[-1]) + 1)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def repeated(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows whose keys are those of another row: sorted by key, compared with their neighbours as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, twice = None, False  # the last row, not given out yet, and whether it repeats
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            same = np.ones(b.num_rows - 1, bool)
            for k in range(len(keys)):
                c = b.column(k).to_numpy()
                same &= c[1:] == c[:-1]
            hit = np.zeros(b.num_rows, bool)
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= twice
            yield pa.RecordBatch.from_arrays([b.column(len(keys) + k).filter(pa.array(np.append(hit[:-1], False))) for k in range(len(keep))], names=keep)
            held, twice = b.slice(b.num_rows - 1), bool(hit[-1])
        if held is not None and twice:
            yield pa.RecordBatch.from_arrays([held.column(len(keys) + k) for k in range(len(keep))], names=keep)

    sorted_ = rows.select(*keys, *keep).repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, ", ".join(f"{k} long" for k in keep))


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo] to values[hi], ends included, by doubling."""
    out, width, table = np.empty(len(lo), values.dtype), hi - lo + 1, values
    k = 0
    while len(lo):
        now = width >> k == 1
        out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << k) + 1])
        if (width >> (k + 1) == 0).all():
            break
        table = np.minimum(table[: -(1 << k)], table[(1 << k) :])
        k += 1
    return out


def interleave(interval: np.ndarray, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, after: int, rest: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Merges the runs of intervals, given in ascending order (at most 65,536 of them): which windows repeat, for either length, as matrices of runs and anchor distances.

    symbols: a row a run; the columns hold the bytes around the core, from the last of `after` bytes behind it to the first one before it, -1 where a run has none.
    A run's windows have anchor distances from first to last.  The window of distance d begins with column after + d - 1; rest: how many bytes beside the core make up a
    window of each length."""
    n, reach = len(interval), symbols.shape[1] - after + 1
    group = interval.astype(np.uint16)
    at = np.arange(n)  # the interleave vector: the run at each place
    common = np.zeros(n, np.int16)  # with the place before
    hits = tuple(np.zeros((n, reach), bool) for _ in rest)
    for k in range(symbols.shape[1] + 1):
        if (d := k - after) >= 0:
            own = (first[at] <= d) & (d <= last[at])
            for size, hit in zip(rest, hits, strict=True):
                block = np.cumsum(common < size) - 1
                hit[at, d] = own & (np.bincount(block, own)[block] >= 2)
        if k == symbols.shape[1]:
            return hits
        own = symbols[at, k]
        by = np.argsort((own + 1).astype(np.uint16), kind="stable")
        by = by[np.argsort(group[by], kind="stable")]  # where each place's suffix, one symbol longer, comes to stand
        own = own[by]
        same = np.flatnonzero((own[1:] == own[:-1]) & (group[1:] == group[:-1]) & (own[1:] >= 0)) + 1
        longer = np.zeros(n, np.int16)
        longer[same] = 1 + range_min(common, by[same - 1] + 1, by[same])
        at, common = at[by], longer
    return hits


def member(bits: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Whether the bit set has the cores: Spark's xxhash64 of a long, in numpy."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.uint64(42) + p5 + np.uint64(8)
    h = h ^ (rot(core.view(np.uint64) * p2, 31) * p1)
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h = (h ^ (h >> np.uint64(32))).view(np.int64)
    n = len(bits) * 8
    out = np.ones(len(core), bool)
    for p in (h % n, (h >> 20) % n):
        out &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return out


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of a matrix's rows: row, first, end."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return row, first, end


def spans(rows: DataFrame, length: int, passage: int, bits: int, most: int) -> DataFrame:
    """key, at, n, goes: repeated bytes of each row, as they are found; they overlap.  goes: 1 for strings of `length`, 0 for those of `passage` bytes."""
    cores = written(counted(rows, length, passage), "cores", few=True)
    n = cores.count()
    rounds = max(1, -(-16 * n // bits))
    found = None
    for k in range(rounds):
        own = cores if rounds == 1 else cores.where(F.pmod(F.xxhash64(F.lit("round"), "core"), F.lit(rounds)) == k)
        one = round_spans(rows, own, length, passage, bits, most)
        found = one if found is None else found.unionByName(one)
    forget(cores)  # its bit sets are made
    return found


def round_spans(rows: DataFrame, cores: DataFrame, length: int, passage: int, bits: int, most: int) -> DataFrame:
    """spans() of the runs with these cores."""
    core_size = passage - REACH + 1
    after = length - core_size
    span = "key long, at long, n long, goes long"

    def shared(df: DataFrame):
        return rows.sparkSession.sparkContext.broadcast(bit_set(df.select("core"), min(bits, max(1 << 15, 1 << (16 * df.count()).bit_length()))))  # at most `bits`

    wide = cores.where(F.col("uneven") & (F.col("runs") > most))
    some, uneven, large = shared(cores), shared(cores.where("uneven")), shared(wide)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of repeated cores.  sure: equal to another one of the block; of those, one goes on as not sure, too."""
        for keys, starts, runs in blocks(batches, length, passage):
            core, full = runs.core(), runs.full()
            on = np.flatnonzero(member(some.value, core))
            on = on[np.lexsort((full[on], core[on]))]
            new = np.append(True, (core[on[1:]] != core[on[:-1]]) | (full[on[1:]] != full[on[:-1]]))[: len(on)]
            twice = ~new
            twice[:-1] |= ~new[1:]
            on, sure = np.append(on[new], on[twice]), np.append(np.zeros(new.sum(), bool), np.ones(twice.sum(), bool))
            piece = runs.piece[on]
            at = np.array(starts, np.int64)[piece] + runs.at[on] - runs.begin[piece]
            yield pa.RecordBatch.from_arrays([*longs(core[on], full[on], np.array(keys, np.int64)[piece], at, runs.n[on] - 1 + passage, runs.end[on] - runs.at[on]), pa.array(sure)], names=["core", "full", "key", "at", "n", "extent", "sure"])

    def different(batches: Iterator[pa.RecordBatch], out_of_hand: bool) -> Iterator[tuple[list[int], list[int], Runs, np.ndarray]]:
        """Runs of uneven cores, one for each content in a task: equal ones are settled and it stands for them."""
        seen: set[int] = set()
        for keys, starts, runs in blocks(batches, length, passage):
            core, full = runs.core(), runs.full()
            on = np.flatnonzero(member(uneven.value, core))
            on = on[member(large.value, core[on]) == out_of_hand]
            if len(seen) > 500_000:
                seen.clear()
            new = []
            for k, f in zip(on.tolist(), full[on].tolist(), strict=True):
                if f not in seen:
                    seen.add(f)
                    new.append(k)
            if new:
                yield keys, starts, runs, np.array(new, np.int64)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The extent's bytes before and after the core."""
        for keys, starts, runs, on in different(batches, False):
            piece, before = runs.piece[on], runs.anchor[on] - runs.at[on]
            begin = np.array(starts, np.int64)[piece] - runs.begin[piece]
            sides = [runs.raw[a:c] + runs.raw[c + core_size : z] for a, c, z in zip(runs.at[on].tolist(), runs.anchor[on].tolist(), runs.end[on].tolist(), strict=True)]
            numbers = longs(runs.core()[on], runs.full()[on], np.array(keys, np.int64)[piece], begin + runs.anchor[on], before, runs.n[on])
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(sides, pa.binary())], names=["core", "full", "key", "anchor", "before", "n", "sides"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 1, 8000):
            core, full, key, anchor, before, n = (b.column(k).to_numpy() for k in range(6))
            fresh = np.append(True, core[1:] != core[:-1])
            on = np.flatnonzero(fresh | np.append(True, full[1:] != full[:-1]))  # one for each content
            interval = np.cumsum(fresh)[on] - 1
            more = np.bincount(interval)[interval] > 1
            on, interval = on[more], interval[more]
            if not len(on):
                continue
            symbols = np.full((len(on), after + REACH - 1), -1, np.int16)  # the extents' bytes in reverse, set against the core
            for k, (raw, m) in enumerate(zip(b.column(6).take(pa.array(on)).to_pylist(), before[on].tolist(), strict=True)):
                x = np.frombuffer(raw, np.uint8)[::-1]
                symbols[k, after + m - len(x) : after + m] = x
            hits = interleave(interval, symbols, before[on] - n[on] + 1, before[on], after, (passage - core_size, length - core_size))
            for goes, (size, hit) in enumerate(zip((passage, length), hits, strict=True)):
                row, first, end = stretches(hit)
                yield pa.RecordBatch.from_arrays(longs(key[on][row], anchor[on][row] - end + 1, end - first - 1 + size, np.full(len(row), goes)), names=["key", "at", "n", "goes"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, runs, on in different(batches, True):
            for goes, size in enumerate((passage, length)):
                n = np.clip(np.minimum(runs.n[on], runs.end[on] - runs.at[on] - size + 1), 0, None)
                run = np.repeat(on, n)
                at = runs.at[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                piece = runs.piece[run]
                yield pa.RecordBatch.from_arrays(longs(runs.hashes(at, at + size), np.full(len(at), goes), np.array(keys, np.int64)[piece], np.array(starts, np.int64)[piece] + at - runs.begin[piece], np.full(len(at), size)), names=["w", "goes", "key", "at", "n"])

    equal = written(rows.mapInArrow(whole, "core long, full long, key long, at long, n long, extent long, sure boolean"), "runs")
    same = equal.where("sure").select("key", "at", "n", "extent").unionByName(repeated(equal.where("not sure"), ["core", "full"], ["key", "at", "n", "extent"]))
    kinds = F.array(F.struct("key", "at", "n", F.lit(0).cast("long").alias("goes")), F.struct("key", "at", F.col("extent").alias("n"), F.lit(1).cast("long").alias("goes")))
    found = same.select(F.inline(kinds)).where(f"goes = 0 or n >= {length}")
    sides = rows.mapInArrow(around, "core long, full long, key long, anchor long, before long, n long, sides binary")
    found = found.unionByName(sides.repartition("core").sortWithinPartitions("core", "full").mapInArrow(merge, span))
    if wide.isEmpty():
        return found
    return found.unionByName(repeated(rows.mapInArrow(windows, f"w long, goes long, {span.removesuffix(', goes long')}"), ["w", "goes"], ["key", "at", "n", "goes"]))


def covered(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches of the places that spans (begin, end) cover, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(cover):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def dedup(docs: DataFrame, *, length: int = LENGTH, passage: int = PASSAGE, bits: int = BITS, most: int = MOST) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256; n_repeated: the bytes covered by strings of `passage` bytes that also start anywhere else.

    passage is at most length, and more than REACH."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = rows.withColumn("key", F.col("doc_id"))
    else:  # rows are numbered once, in a written table, so that they keep their numbers
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "rows")
    cover = spans(rows.select("key", "text"), length, passage, bits, most).groupBy("key").agg(F.collect_list(F.struct("at", "n", "goes")).alias("cover"))
    digest = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part, out = b.slice(lo, 200), []
                for text, cover in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    gone, seen = (covered([(c["at"], c["at"] + c["n"]) for c in cover or () if c["goes"] == kind]) for kind in (1, 0))
                    ends = [0, *(x for span in gone for x in span), len(raw)]
                    rest = b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True))
                    out.append((rest, len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), sum(z - a for a, z in seen)))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), *(t for _, t in digest)), strict=True))], names=["doc_id", "kept", *(n for n, _ in digest)])

    both = rows.join(cover, "key", "left").select("doc_id", "text", "cover")
    return both.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, size, s, hash(substr(h, 2 * s + 1, 2 * size)) AS k FROM (SELECT doc_id, h, size, unnest(range(0, n - size + 1)) AS s FROM d, (VALUES (400), (256)) t(size))),
rep AS (SELECT doc_id, size, s FROM w QUALIFY count(*) OVER (PARTITION BY size, k) > 1),
marked AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id, size ORDER BY s) + size THEN 1 ELSE 0 END AS new FROM rep),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, size ORDER BY s) AS part FROM marked),
spans AS (SELECT doc_id, size, min(s) AS a, max(s) + size AS z FROM parts GROUP BY doc_id, size, part),
around AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id, size ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS rest FROM around JOIN d USING (doc_id) WHERE size = 400 GROUP BY doc_id),
also AS (SELECT doc_id, sum(z - a) AS n_repeated FROM spans WHERE size = 256 GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256, coalesce(n_repeated, 0)::BIGINT AS n_repeated
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN also USING (doc_id)
"""
