"""Token-ID output in shards of independent zstandard frames with a trailing seek table.

A shard is a file in the public zstd seekable format:

* data frames, each an independent zstd frame with its content checksum, that hold whole documents;
* a skippable frame (magic 184D2A50) with one entry a data frame: whether its first and last document have an id, and these ids;
* the seek table: a skippable frame (magic 184D2A5E) with compressed size, decompressed size and checksum
  (low half of XXH64 of the content) of each data frame, then the frame count, a descriptor byte and the magic 8F92EAB1.

A decompressed data frame holds: u32 document count; per document i64 id, u8 whether the id is there, u32 token count;
then all token ids as little-endian u16 or u32 (the shard's first byte of the index frame tells: 2 or 4).

Shards are written by tasks under names of their own; only those that the manifest lists count, so a task that runs twice
leaves an unlisted file and no wrong rows.  Null texts are empty documents with the end id alone.  Documents are in ascending
id order, null ids first, then by text; rows that repeat an id are kept, each with its own place.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "path string, n_docs long, n_tokens long, n_frames long, first_id long, has_id boolean, first_hash long"
MARKS = ".,!?;:#$%&*|"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ChunkEncoder:
    """Encodes texts with a tokenizers file, remembering the ids of chunks between single spaces.

    GPT-2's byte-level splitter never joins characters across a space between two non-space characters, nor across a single
    line break between two, so a text's ids are those of its chunks.  Texts where white space stands together, at an end, or is of another kind, or that hold
    an added token's string, are encoded whole; so are all texts where the file has another splitter or a normalizer.  The memory is emptied at `limit` chunks.
    Texts of `group` characters are encoded together: Arrow numbers their chunks, so that each different one is looked up once, and the ids are gathered by number."""

    def __init__(self, path: str, limit: int = 1_400_000, group: int = 1 << 23):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.group = limit, group
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.memory: dict[str, bytes | None] = {}  # chunks after a space, and with a line break before them those at a text's or line's start; None: texts with it are encoded whole
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        pre, post = says.get("pre_tokenizer") or {}, says.get("post_processor") or {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not says.get("normalizer") and post.get("type", "ByteLevel") == "ByteLevel"
        self.by_chunk = plain and says["model"].get("type", "BPE") == "BPE" and not says.get("truncation") and not any(c in t for t in added for c in " \n")
        self.odd = re.compile("|".join([r"\s", *map(re.escape, added)]))
        self.marks = {"\n": self._ids(["\n"])[0]}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _apart(self, pieces: list[str], group: int = 64) -> list[bytes]:
        """_ids of pieces without line breaks, some in one text: a line break before a piece is a token of its own."""
        mark = self.marks["\n"]
        size = len(mark)
        if size != int(self.width[-1]):
            return self._ids(pieces)
        out, (line,) = [], np.frombuffer(mark, self.width)
        for e in self.tokenizer.encode_batch_fast(["\n" + "\n".join(pieces[k : k + group]) for k in range(0, len(pieces), group)], add_special_tokens=False):
            ids = np.array(e.ids, self.width)
            at = (np.flatnonzero(ids == line) * size).tolist()
            raw = ids.tobytes()
            out += [raw[a + size : z] for a, z in zip(at, [*at[1:], len(raw)], strict=True)]
        return out

    def _learn(self, new: list[str], begun: bool) -> None:
        """new: different chunks; begun: those at a text's or line's start."""
        memory = self.memory
        key, lead, start = ("\n", "", self.marks["\n"]) if begun else ("", " ", b"")
        first, letters, tails, other = set(), {}, set(), []
        for c in new:
            if c.isalpha():
                first.add(c)
                continue
            k = len(c.rstrip(MARKS))
            if 0 < k < len(c) and c[:k].isalpha():  # letters and the marks that close them are two pieces for the splitter
                letters[c] = (head := c[:k]), (tail := c[k:])
                tails.add(tail)
                if key + head not in memory:
                    first.add(head)
            else:
                other.append(c)
        alone = set(filter(self.odd.search, other))
        memory.update(dict.fromkeys([key + c for c in alone]))
        first.update(c for c in other if c not in alone)
        pieces = list(first)
        ids = self._apart([lead + c for c in pieces] if lead else pieces)
        memory.update(zip([key + c for c in pieces], [start + x for x in ids], strict=True) if begun else zip(pieces, ids, strict=True))
        pieces = list(tails - self.marks.keys())
        self.marks.update(zip(pieces, self._apart(pieces), strict=True))
        for c, (head, tail) in letters.items():
            memory[key + c] = memory[key + head] + self.marks[tail]

    def trim(self, limit: int) -> None:
        if len(self.memory) > limit:
            self.memory.clear()
            self.marks = {"\n": self.marks["\n"]}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest, split, size = [], [], 0
        for k, text in enumerate(texts):
            if not text or not self.by_chunk or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
                rest.append(k)
                continue
            split.append(k)
            size += len(text)
            if size >= self.group:
                rest += self._by_chunk(texts, split, out)
                split, size = [], 0
        if split:
            rest += self._by_chunk(texts, split, out)
        for k, ids in zip(rest, self._ids([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _by_chunk(self, texts: list[str], split: list[int], out: list[bytes | None]) -> list[int]:
        """Encodes the texts at `split` into out; the places of those that are to be encoded whole."""
        self.trim(self.limit)
        some, get = [texts[k] for k in split], self.memory.get
        raw = ("\n" + "\n".join(some)).replace("\n", " \n").encode()  # every chunk begins with a space, a text's first like a line's first
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        chunks = pa.LargeStringArray.from_buffers(len(spaces), pa.py_buffer(np.append(spaces, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        which, _, values = chunks.indices.to_numpy(), *chunks.dictionary.buffers()[1:]
        names = values.to_pybytes().decode().split(" ")[1:]
        pieces = list(map(get, names))
        lacking = [j for j, x in enumerate(pieces) if x is None]
        new = [c for c in map(names.__getitem__, lacking) if c not in self.memory]
        self._learn([c for c in new if c[0] != "\n"], False)
        self._learn([c[1:] for c in new if c[0] == "\n"], True)
        alone = np.zeros(len(names), bool)  # chunks that are not to be encoded alone
        for j in lacking:
            x = get(names[j])
            pieces[j], alone[j] = x or b"", x is None
        last = np.cumsum([t.count(" ") + t.count("\n") + 1 for t in some])  # chunks up to each text's end
        whole = set(np.searchsorted(last, np.flatnonzero(alone[which]), "right").tolist()) if alone.any() else ()
        flat = np.frombuffer(b"".join(pieces), self.width)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces)) // flat.itemsize
        own = n[which]
        ends = np.cumsum(own)
        place = np.repeat((np.cumsum(n) - n)[which] - (ends - own), own)
        place += np.arange(len(place))
        ids, at, mark = flat[place].tobytes(), 0, len(self.marks["\n"])
        for k, j, end in zip(split, range(len(split)), (ends[last - 1] * flat.itemsize).tolist(), strict=True):
            if j not in whole:
                out[k] = ids[at + mark : end]
            at = end
        return [split[j] for j in whole]


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, limit: int) -> ChunkEncoder:
    """One a worker process, so that what it remembers serves all its tasks."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = ChunkEncoder(path, limit)
    return _encoders[path, limit]


class ShardWriter:
    """Writes documents in their given order; at most one frame's documents are held."""

    def __init__(self, uri: str, width: str, frame_bytes: int, level: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = fs.open_output_stream(path, compression=None)
        self.width, self.frame_bytes = width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.heads, self.bodies, self.size = [], [], 0
        self.table, self.index = [], []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // int(self.width[-1])
        self.heads.append((doc_id, n))
        self.bodies.append(ids)
        self.size += len(ids)
        self.n_docs += 1
        self.n_tokens += n
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.heads:
            return
        raw = b"".join([struct.pack("<I", len(self.heads)), *(struct.pack("<qBI", i or 0, i is not None, n) for i, n in self.heads), *self.bodies])
        frame = self.zstd.compress(raw)
        self.file.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        (a, _), (z, _) = self.heads[0], self.heads[-1]
        self.index.append(struct.pack("<qBqB", a or 0, a is not None, z or 0, z is not None))
        self.heads, self.bodies, self.size = [], [], 0

    def close(self) -> int:
        self.flush()
        body = bytes([int(self.width[-1])]) + b"".join(self.index)
        self.file.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.file.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
        self.file.close()
        return len(self.table)


class ShardReader:
    """Reads a shard frame by frame, or only the frames that may hold a requested document."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        raw = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed_size, full, check = struct.unpack_from("<III", raw, 12 * k)
            self.frames.append((at, packed_size, full, check))
            at += packed_size
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX_MAGIC or length != 1 + 18 * n:
            raise ValueError(f"{uri}: no document index")
        raw = self.file.read_at(length, at + 8)
        self.width = f"<u{raw[0]}"
        self.ranges = [struct.unpack_from("<qBqB", raw, 1 + 18 * k) for k in range(n)]
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        at, packed_size, full, check = self.frames[k]
        raw = self.zstd.decompress(self.file.read_at(packed_size, at), max_output_size=full)
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        (n,) = struct.unpack_from("<I", raw)
        heads = np.frombuffer(raw, np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")]), n, 4)
        ids = np.frombuffer(raw, self.width, offset=4 + 13 * n)
        ends = np.cumsum(heads["n"].astype(np.int64))
        for i, has, m, end in zip(heads["id"].tolist(), heads["has"].tolist(), heads["n"].tolist(), ends.tolist(), strict=True):
            yield (i if has else None), ids[end - m : end]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.frames)):
            yield from self.frame(k)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of all documents with this id; only frames whose range covers it are decompressed."""
        return [ids for k, (a, _, z, last) in enumerate(self.ranges) if last and (a <= doc_id or not self.ranges[k][1]) and doc_id <= z for i, ids in self.frame(k) if i == doc_id]


def write_shards(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", out_dir: str | None = None, frame_bytes: int = 1 << 18, level: int = 3, remembered: int = 1_400_000, resting: int | None = None
) -> DataFrame:
    """Encodes and writes all documents; the manifest, one row a shard, as a written table.  One shuffle: by ranges of the id.

    A worker remembers `remembered` chunks at most, and more than `resting` are not kept from one task to the next."""
    spark = docs.sparkSession
    out_dir = out_dir or shared_dir(spark, "tokens")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first = None, None
        for batch in batches:
            coder = encoder(tokenizer_path, remembered)
            end = np.array([end_id], coder.width).tobytes()
            for lo in range(0, batch.num_rows, 2000):
                ids = batch.column(0).slice(lo, 2000).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(lo, 2000).to_pylist()]
                if writer is None and ids:
                    uri = f"{out_dir}/shard-{uuid.uuid4().hex}.zst"
                    writer, first = ShardWriter(uri, coder.width, frame_bytes, level), (ids[0], xxhash.xxh64_intdigest(texts[0].encode()) >> 1)
                for i, x in zip(ids, coder.encode(texts), strict=True):
                    writer.add(i, x + end)
        encoder(tokenizer_path, remembered).trim(remembered if resting is None else resting)
        pa.default_memory_pool().release_unused()
        if writer:
            frames = writer.close()
            yield pa.RecordBatch.from_pylist([{"path": uri, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_frames": frames, "first_id": first[0], "has_id": first[0] is not None, "first_hash": first[1]}], schema=pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_frames", pa.int64()), ("first_id", pa.int64()), ("has_id", pa.bool_()), ("first_hash", pa.int64())]))

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = lean.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(shard, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row a document as the shards hold it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum over shards goes over the manifest alone, one row for each shard file."""
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(Window.orderBy("has_id", "first_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, rows = ShardReader(path), []
                for k in range(len(shard.frames)):
                    for i, ids in shard.frame(k):
                        rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    return placed.repartition(max(1, manifest.count() // 2), "path").mapInArrow(read, RESULT)  # about two shards a task


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))
