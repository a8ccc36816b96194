"""Token-ID output: one compressed wavelet-matrix file per shard, with access, rank and select.

Texts are dealt by ranges of ``doc_id`` and sorted, then encoded where they are put into shards, so shards are in ascending order and ids
are never shuffled.  A shard is closed at ``part_ids`` ids.  Its ids are
stored as bit planes (most significant first), each stably partitioned by its bit.  A plane is cut into frames, each a zstd stream of
its own that holds the bits and, for every 512th of them, the ones before; the shard's head tells each frame's place and the ones before it.  So rank is a
look-up in the head, one in a frame's table and a count of 512 bits at most, and access, rank and select unpack one frame or two a plane.  Spark's own
committer writes the files, so a lost executor leaves none half written and any file system that Spark knows will do.

Defined cases: a null text is empty (only the end id); very long texts are encoded whole, into a shard as long as they need; rows of equal ``doc_id`` stay apart,
in order of their texts' hashes; a null ``doc_id`` sorts first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.encoding import encoder
from newsflow.llm.runtime import n_parts, new_path, ship_package, small_batches

#: A shard is closed at so many ids.
PART_IDS = 1 << 22
#: Bytes of text that one task encodes and writes, about.
TASK_BYTES = 32 << 20
BLOCK = 512
#: Bits of a plane that are compressed together.
FRAME = 1 << 19
#: The head of a payload - format, ids, planes, documents, frames a plane.
HEAD = struct.Struct("<4sQIII")
MAGIC = b"WVM2"


def bit_planes(ids: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The bits of each plane, most significant first, as booleans."""
    for b in range(depth - 1, -1, -1):
        bits = (ids & ids.dtype.type(1 << b)).astype(bool)
        yield bits
        ids = np.concatenate([np.compress(~bits, ids), np.compress(bits, ids)])


def pack_shard(ids: np.ndarray, lengths: np.ndarray, depth: int) -> bytes:
    """Head, places of frames, ones before frames, the documents' lengths, then the frames plane by plane."""
    packer = zstandard.ZstdCompressor(1)
    n, per_plane = len(ids), -(-len(ids) // FRAME)
    frames, ones = [packer.compress(np.asarray(lengths, "<u4").tobytes())], np.zeros((depth, per_plane + 1), "<u8")
    for level, bits in enumerate(bit_planes(ids, depth)):
        plane = np.packbits(bits)
        for k in range(per_plane):
            part = plane[k * FRAME // 8:(k + 1) * FRAME // 8]
            blocks = np.add.reduceat(np.bitwise_count(part), np.arange(0, len(part), BLOCK // 8), dtype=np.int64)
            before = np.cumsum(blocks) - blocks
            ones[level, k + 1] = int(ones[level, k]) + int(blocks.sum())
            frames.append(packer.compress(before.astype("<u4").tobytes() + part.tobytes()))
    places = np.cumsum([0, *map(len, frames)]).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, n, depth, len(lengths), per_plane), places.tobytes(), ones.tobytes(), *frames])


class Shard:
    """A packed sequence of unsigned ids; frames are unpacked as they are asked for."""

    def __init__(self, payload: bytes):
        magic, self.n, self.depth, self.docs, self.per_plane = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix payload")
        at = HEAD.size
        k = self.depth * self.per_plane + 2
        self.places = np.frombuffer(payload, "<u8", k, at)
        at += 8 * k
        self.ones = np.frombuffer(payload, "<u8", self.depth * (self.per_plane + 1), at).reshape(self.depth, -1).astype(np.int64)
        self.zeros = [self.n - int(x) for x in self.ones[:, -1]]
        self.body = memoryview(payload)[at + 8 * self.ones.size:]
        self.frame = lru_cache(maxsize=4 * self.depth)(self._frame)

    def _unpacked(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.body[int(self.places[k]):int(self.places[k + 1])])

    def lengths(self) -> np.ndarray:
        """Of the documents, in ids."""
        return np.frombuffer(self._unpacked(0), "<u4")

    def _frame(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each block of the frame, and its bits."""
        raw = self._unpacked(1 + level * self.per_plane + k)
        blocks = -(-min(FRAME, self.n - k * FRAME) // BLOCK)
        return np.frombuffer(raw, "<u4", blocks), np.frombuffer(raw, np.uint8, offset=4 * blocks)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, inside = divmod(i, FRAME)
        ones = int(self.ones[level, k])
        if not inside:
            return ones
        table, bits = self.frame(level, k)
        block = inside // BLOCK
        if block == len(table):
            return int(self.ones[level, k + 1])
        lo = block * (BLOCK // 8)
        ones += int(table[block]) + int(np.bitwise_count(bits[lo:inside >> 3]).sum())
        return ones + (int(bits[inside >> 3] >> (8 - (inside & 7))).bit_count() if inside & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.depth):
            inside = i % FRAME
            bit = int(self.frame(level, i // FRAME)[1][inside >> 3] >> (7 - (inside & 7))) & 1
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.depth):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.depth - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs among the first ``i`` ids."""
        lo, hi = self._range(value, i)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Where ``value`` occurs for the k-th time (from 0); -1 if it doesn't."""
        lo, hi = self._range(value, self.n)
        if k >= hi - lo or k < 0:
            return -1
        i = lo + k
        for level in range(self.depth - 1, -1, -1):
            bit = value >> (self.depth - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        ends = np.minimum(np.arange(self.per_plane + 1) * FRAME, self.n)
        before = self.ones[level] if bit else ends - self.ones[level]
        f = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[f])
        table, bits = self.frame(level, f)
        before = table if bit else np.arange(len(table)) * BLOCK - table
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * BLOCK
        some = np.unpackbits(bits[lo // 8:(lo + BLOCK) // 8])[: min(BLOCK, self.n - f * FRAME - lo)]
        return f * FRAME + lo + int(np.flatnonzero(some == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        out = np.zeros(self.n, np.uint32 if self.depth > 16 else np.uint16)
        for level in range(self.depth - 1, -1, -1):
            zeros = self.zeros[level]
            packed = [self._frame(level, k)[1] for k in range(self.per_plane)]
            bits = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bits)] = out[:zeros]
            up[np.flatnonzero(bits)] = out[zeros:] | out.dtype.type(1 << (self.depth - 1 - level))
            out = up
        return out


def _build(path: str, end_id: int, part_ids: int):
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, part, docs, blobs, size = 0, 0, [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(blobs), enc.dtype)
            lengths = np.array([len(x) // enc.width for x in blobs], np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()),
                                               pa.array([docs], pa.list_(pa.int64())), pa.array([pack_shard(ids, lengths, 8 * enc.width)], pa.binary())], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                shard = b.column("shard")[0].as_py()
                for d, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    docs.append(d)
                    blobs.append(x + end)
                    size += len(x) // enc.width + 1
                    if size >= part_ids:
                        yield flush()
                        part, docs, blobs, size = part + 1, [], [], 0
        if docs:
            yield flush()

    return run


def write_shards(documents: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, part_ids: int = PART_IDS, task_bytes: int = TASK_BYTES) -> str:
    """Encode ``documents`` and write a wavelet-matrix file per shard; returns the folder."""
    spark = documents.sparkSession
    ship_package(spark)
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(n_parts(spark), -(-int(size) // task_bytes))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = documents.select("doc_id", "text").repartitionByRange(tasks, *key).sortWithinPartitions(*key).select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text")
    built = ordered.mapInArrow(_build(tokenizer_path, end_id, part_ids), "shard long, part int, n_ids long, doc_ids array<long>, payload binary")
    path = path or new_path(spark, "wavelet")
    with small_batches(spark):
        built.write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(path)
    return path


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for shard, part, docs, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "doc_ids", "payload")), strict=True):
            opened = Shard(payload)
            ids, lengths = opened.decode().astype("<u4"), opened.lengths()
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            k = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int64()), pa.array([part] * k, pa.int32()), pa.array(docs, pa.int64()),
                                              pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    ship_package(spark)
    files = spark.read.schema("shard long, part int, n_ids long, doc_ids array<long>, payload binary").parquet(path)
    sizes = files.select("shard", "part", "n_ids", F.expr("shard div 1024").alias("region"))
    region = sizes.groupBy("region").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    region = region.select("region", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("region").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(region, "region")
               .select("shard", "part", (F.col("base") + F.col("inner")).alias("offset")))
    docs = files.select("shard", "part", "doc_ids", "payload").mapInArrow(_decode, "shard long, part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["shard", "part"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
