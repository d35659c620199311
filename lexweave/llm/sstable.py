"""Token ids as sorted-string-table shards.

A shard is: data blocks | index | Bloom filter | footer. Entries of a block are ordered by key; each has varints
(bytes shared with the key before, bytes not shared, bytes of value), the rest of the key and the value; the first of a
block shares nothing. The index holds (last key, offset, length) of each block. Keys are identifiers as eight
bytes big-endian with the sign flipped, so that byte order is number order. Values are token ids, little-endian.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import release
from .tokenizers import DEFAULT_VOCABULARY, encoding, forget, ranks
from .work import pruned

MAGIC = b"LXWSST01"
FOOTER = struct.Struct("<QQQQQIHH8s")  # index at, index bytes, bloom at, bloom bytes, entries, blocks, id width, hashes, magic
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(identifier: int) -> bytes:
    return struct.pack(">Q", (identifier + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        i += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, i
        shift += 7


def _probes(key: bytes, bits: int, hashes: int = BLOOM_HASHES) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b & (1 << 64) - 1) % bits for i in range(hashes)]


class Writer:
    """Builds one shard from entries in key order; equal keys may follow each other."""

    def __init__(self, width: int, block_bytes: int = BLOCK_BYTES):
        self.width, self.block_bytes = width, block_bytes
        self.data = bytearray()
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.size = self.n = 0
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not descend")
        shared = 0
        if self.size:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.data += head
        self.data += value
        self.size += len(head) + len(value)
        self.last = key
        self.keys.append(key)
        self.n += 1
        if self.size >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.size:
            self.index.append((self.last, self.at, self.size))
            self.at += self.size
            self.size = 0

    def finish(self) -> bytearray:
        """The shard, in the buffer that it was written to: it isn't copied."""
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(s) for k, o, s in self.index)
        distinct = list(dict.fromkeys(self.keys))
        bits = max(64, -(-len(distinct) * BLOOM_BITS // 64) * 64)
        bloom = np.zeros(bits, np.uint8)
        if distinct:
            bloom[np.array([_probes(k, bits) for k in distinct]).ravel()] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.n, len(self.index), self.width, BLOOM_HASHES, MAGIC)
        self.data += index
        self.data += packed
        self.data += foot
        return self.data


class Reader:
    """Looks documents up in a shard: Bloom filter, binary search in the sparse index, then one block."""

    def __init__(self, shard: bytes | bytearray):
        shard = bytes(shard)
        self.b = shard
        at, size, bloom_at, bloom_size, self.entries, blocks, self.width, self.hashes, magic = FOOTER.unpack(shard[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = shard[bloom_at : bloom_at + bloom_size]
        self.blocks, i = [], at
        for _ in range(blocks):
            n, i = _read_varint(shard, i)
            key, i = shard[i : i + n], i + n
            o, i = _read_varint(shard, i)
            s, i = _read_varint(shard, i)
            self.blocks.append((key, o, s))
        self.last_keys = [k for k, _, _ in self.blocks]

    def _block(self, o: int, s: int) -> Iterator[tuple[bytes, bytes]]:
        i, key = o, b""
        while i < o + s:
            shared, i = _read_varint(self.b, i)
            rest, i = _read_varint(self.b, i)
            size, i = _read_varint(self.b, i)
            key = key[:shared] + self.b[i : i + rest]
            i += rest
            yield key, self.b[i : i + size]
            i += size

    def may_hold(self, identifier: int) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(identifier), len(self.bloom) * 8, self.hashes))

    def get(self, identifier: int) -> list[list[int]]:
        """The token ids of every document stored under the identifier, in the order of the shard."""
        if not self.may_hold(identifier):
            return []
        key, found = key_of(identifier), []
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            _, o, s = self.blocks[k]
            first = True
            for at, value in self._block(o, s):
                if first and at > key:
                    return found
                first = False
                if at == key:
                    found.append(self._ids(value))
            if self.last_keys[k] > key:
                break
        return found

    def _ids(self, value: bytes) -> list[int]:
        return np.frombuffer(value, f"<u{self.width}").tolist()

    def items(self) -> Iterator[tuple[int, list[int]]]:
        for _, o, s in self.blocks:
            for k, v in self._block(o, s):
                yield id_of(k), self._ids(v)


#: Partitions of identifiers are as many as shards up to PARTITIONS; beyond, one holds up to PER_PARTITION shards. Numbers of
#: shards are STRIDE apart between partitions.
PARTITIONS, PER_PARTITION, STRIDE = 4096, 16, 1 << 24


def token_shards(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, shard_bytes: int = 32 << 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, min_id, max_id, n_docs, n_tokens, n_blocks, sst): one row per sorted-string-table shard.

    Every row of docs(doc_id, text) with a doc_id is stored under it; repeated identifiers are stored once for each
    row (all are found by a lookup), ordered by their tokens, and may run on into the next shard. Null text is stored as no
    tokens; rows with a null doc_id cannot be looked up and are left out. A shard is closed once it holds `shard_bytes`
    (1 at least), whatever the number of its documents; shards follow each other in key order, their numbers ascend with
    gaps. Empty input gives no shards. Other columns are not read.

    Identifiers are read first (a narrow scan) for the partitions' boundaries; texts become token ids where they are read, and
    only these move, once, to the partition of their identifier, where shards are cut from the sorted stream: a task
    holds one shard at a time.
    """
    if shard_bytes < 1:
        raise ValueError("shard_bytes must be at least 1")
    base = pruned(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    sizes = base.agg(F.sum(F.length("text").cast("long")).alias("c")).head()
    shards = max(1, -(-int(sizes["c"] or 0) // shard_bytes))
    parts = max(min(shards, PARTITIONS), shards // PER_PARTITION)
    bounds: list[int] = []
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        bounds = base.agg(F.percentile_approx("doc_id", probs, F.lit(max(1000, 10 * parts))).alias("b")).head()["b"] or []
    cuts = np.unique(np.array(bounds, np.int64))
    width = 2 if len(ranks(vocabulary)) <= 1 << 16 else 4

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc = encoding(vocabulary)
        for b in batches:
            ids = np.asarray(b.column(0))
            texts = b.column(1)
            for i in range(0, len(ids), 64):
                values = [np.array(enc.encode_ordinary(t or ""), f"<u{width}").tobytes() for t in texts.slice(i, 64).to_pylist()]
                part = ids[i : i + 64]
                where = np.searchsorted(cuts, part, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(part), pa.array(values, pa.binary())], names=["part", "doc_id", "v"])
        del enc
        forget()
        release()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, number, w, lo, hi, tokens, held = None, 0, None, 0, 0, 0, 0

        def done() -> pa.RecordBatch:
            sst = w.finish()  # closes the last block
            row = [[part * STRIDE + number], [lo], [hi], [w.n], [tokens], [len(w.index)]]
            ends = pa.py_buffer(np.array([0, len(sst)], np.int32))
            one = pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(sst)])  # no copy
            return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(row, ARROW, strict=False)), one], names=NAMES)

        for b in batches:
            for p, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if w and (p != part or held >= shard_bytes):
                    yield done()
                    w, number = None, number + 1
                if p != part:
                    part, number = p, 0
                if w is None:
                    w, lo, tokens, held = Writer(width, block_bytes), i, 0, 0
                v = v.as_py()
                w.add(key_of(i), v)
                hi = i
                tokens += len(v) // width
                held += len(v) + 16
        if w:
            yield done()
        w = None
        release()

    coded = base.mapInArrow(encode, "part int, doc_id bigint, v binary")
    placed = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "v")
    return placed.mapInArrow(build, "shard bigint, min_id bigint, max_id bigint, n_docs bigint, n_tokens bigint, n_blocks int, sst binary")


NAMES = ["shard", "min_id", "max_id", "n_docs", "n_tokens", "n_blocks", "sst"]
ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each row's `sst` as folder/shard-NNNNNN.sst and returns (shard, path, bytes) as a table of its own.

    Files are written under a name of the attempt's own and renamed at its end, so a lost or doubled task leaves
    either the whole file or none."""
    import uuid

    from .work import saved

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for s, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                to, own = f"{root}/shard-{s:06d}.sst", f"{root}/.{s:06d}-{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write(v.as_buffer())
                store.move(own, to)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([to]), pa.array([len(v.as_buffer())], pa.int64())], names=["shard", "path", "bytes"])

    return saved(shards.select("shard", "sst").mapInArrow(write, "shard bigint, path string, bytes bigint"), "sst-files")
