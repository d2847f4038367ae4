"""Token-id output as sorted-string-table shards, written and read by Spark tasks in the shared folder.

A shard holds documents in order of identifier: data blocks with prefix-compressed keys (zstd, CRC-32
each), a Bloom filter, a sparse index (first key, place and size of each block) and a fixed footer.
A document is found by binary search of the index and one block read. Shards are ranges of
identifiers, so shard order is identifier order; a task holds one block of its shard at a time.

A task that is tried again writes a file of another name, and only the rows of the attempt that
succeeded name their shards; what failed attempts leave behind is never read.

Edge cases: a null text has the end id only; a null identifier sorts before all others; identifiers
that repeat are neighbours in order of their text's hash; rows that repeat are entries of their own,
and very many of them are spread over shards; very long texts are entries like others, a task holds
one at a time; an empty table writes nothing; other columns are ignored, whatever their names. Any
tokenizer of the library will do; those of another form than `tokens.FORM` are slower.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import memo, new_folder, open_fs, picked, pieces, settle
from .tokens import END, WordTokens

BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
SHARD_BYTES = 16 << 20
SLICE_BYTES = 8 << 20
MAGIC = b"EVSST01\n"
FOOTER = "<QQQQQQI8s"  # bloom place, size; index place, size; entries; tokens; id width; magic
PLACE = "<QII"  # block place, size, entries


def key_of(value) -> bytes:
    """Bytes that sort as the identifiers do: null, then integers or strings in order."""
    if value is None:
        return b"\x00"
    return b"\x01" + (struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1)) if isinstance(value, int) else str(value).encode())


def value_of(key: bytes, integer: bool):
    if key == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if integer else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes (key, ids) in key order and writes a shard to a stream."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.entries = self.tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self):
        self.block, self.size, self.count, self.last, self.first = [], 0, 0, b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.count:
            self.first = key
        shared = 0
        for a, b in zip(key, self.last, strict=False):
            if a != b:
                break
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += [entry, ids]
        self.size += len(entry) + len(ids)
        self.count += 1
        self.entries += 1
        self.tokens += len(ids) // self.width
        if key != self.last or self.count == 1:
            self.hashes.append(key)
        self.last = key
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self):
        if self.count:
            body = self.zip.compress(b"".join(self.block))
            at, size = self._write(body + struct.pack("<I", zlib.crc32(body)))
            self.index.append((self.first, at, size, self.count))
        self._new()

    def close(self):
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for x in _bloom_bits(key, bits):
                bloom[x >> 3] |= 1 << (x & 7)
        bloom_at = self._write(struct.pack("<Q", bits) + bytes(bloom))
        index_at = self._write(b"".join(_varint(len(k)) + k + struct.pack(PLACE, a, s, n) for k, a, s, n in self.index))
        self._write(struct.pack(FOOTER, *bloom_at, *index_at, self.entries, self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a file with seek and read: the footer, filter and index at once, blocks as asked."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._range(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER))
        b_at, b_size, i_at, i_size, self.entries, self.tokens, self.width, magic = struct.unpack(FOOTER, tail)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        bloom = self._range(b_at, b_size)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        raw, at, self.keys, self.places = self._range(i_at, i_size), 0, [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.keys.append(raw[at : at + n])
            self.places.append(struct.unpack_from(PLACE, raw, at + n))
            at += n + struct.calcsize(PLACE)

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the shard ends early")
        return data

    def block(self, i: int) -> list[tuple[bytes, bytes]]:
        at, size, count = self.places[i]
        data = self._range(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        data, at, key, out = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b"", []
        for _ in range(count):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            out.append((key, data[at + n : at + n + size]))
            at += n + size
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, identifier) -> list[np.ndarray]:
        """Ids of every document with an identifier: none if the filter or the blocks lack it."""
        key = key_of(identifier)
        if not all(self.bloom[x >> 3] >> (x & 7) & 1 for x in _bloom_bits(key, self.bits)):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key)):
            out += [np.frombuffer(v, dtype=f"<u{self.width}") for k, v in self.block(i) if k == key]
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, id_col="doc_id", text_col="text", shards: int | None = None) -> DataFrame:
    """Writes all documents to shards in a folder; (shard, path, entries, tokens), one row per shard, settled."""
    n = shards or pieces(docs, SHARD_BYTES)
    # The hash splits an identifier that repeats very often over several ranges, the input's part rows that repeat.
    docs = picked(docs, doc_id=id_col, text=text_col)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("part"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("part")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        name = f"shard-{part:06d}.{attempt}.sst"
        stream = writer = None
        for batch in batches:
            words = memo(f"tokens:{tokenizer}", lambda: WordTokens(tokenizer))
            end = np.array([END], dtype=words.dtype).tobytes()
            if stream is None and batch.num_rows:
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                stream = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(stream, words.width)
            texts, keys = batch.column("text").fill_null(b""), batch.column("doc_id").to_pylist()
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < len(texts):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                for i, t in zip(keys[at:stop], words.ids(texts.slice(at, stop - at)), strict=True):
                    writer.add(key_of(i), t + end)
                at = stop
        if writer is not None:
            writer.close()
            stream.close()
            path = folder.rstrip("/") + f"/{name}"
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([writer.entries], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "path", "entries", "tokens"])

    return settle(rows.mapInArrow(write, "shard bigint, path string, entries bigint, tokens bigint"))


def read_shards(shards: DataFrame, integer: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, read back from the shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = shards.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint")).select("shard", "path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "offset")], strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    reader = ShardReader(file, fs.get_file_info(name).size)
                    for i in range(len(reader.places)):
                        keys, starts, sizes, sums = [], [], [], []
                        for key, value in reader.block(i):
                            ids = np.frombuffer(value, dtype=f"<u{reader.width}")
                            keys.append(value_of(key, integer))
                            starts.append(start)
                            sizes.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64() if integer else pa.string()), *[pa.array(x, pa.int64()) for x in (starts, sizes, sums, [shard] * len(keys))]], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    kind = "bigint" if integer else "string"
    tasks = placed.repartition(max(1, shards.count()), "shard")
    return tasks.mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint")


def token_output(docs: DataFrame, tokenizer: str, *, folder: str | None = None, id_col="doc_id", text_col="text", shards: int | None = None) -> DataFrame:
    """Writes the shards and reads them back."""
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    integer = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    return read_shards(write_shards(docs, folder, tokenizer, id_col=id_col, text_col=text_col, shards=shards), integer)
