"""Token shards as wavelet matrices.

A shard holds whole documents. Its ids are renumbered by falling frequency and stored as bit planes
from the highest bit down; each plane orders the tokens of the next one, zeros before ones. Counts
of ones per 512 bits give rank, and select by search, so a token can be read, counted or located
without decoding the shard.

One shard is one compressed byte string in a row of a Parquet table, so files are written and read
by Spark in any store, and commits, retries and lost executors are Spark's matter. Documents are in
ascending id order (nulls first, equal ids by text), cut into ranges by id; a shard's ``before`` is
the number of ids ahead of it in its range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodgrid.llm.encoding import encoder, groups

SHARD_TOKENS = 1 << 19
_MAGIC = b"WAVMAT01"
_BLOCK = 512
# Ids below this are looked up in a table of as many places.
_DIRECT = 1 << 18


class WaveletMatrix:
    """Bit planes with rank and select over one array of ids."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.alphabet, self.planes, self.zeros, self.ones = n, alphabet, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids) and int(ids.max()) < _DIRECT:
            # Ids of a vocabulary are counted in a table instead of being sorted.
            table = np.bincount(ids)
            alphabet = np.flatnonzero(table).astype(ids.dtype)
            counts, inverse = table[alphabet], ids
            places = alphabet
        else:
            alphabet, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
            places = np.arange(len(alphabet))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(int(places[-1]) + 1 if len(places) else 0, np.uint32)
        rank[places[order]] = np.arange(len(order), dtype=np.uint32)
        codes = rank[inverse]
        if len(order) <= 1 << 16:
            codes = codes.astype(np.uint16)
        planes, zeros, ones = [], [], []
        for bit in range(max(len(order) - 1, 0).bit_length() - 1, -1, -1):
            set_bits = (codes & codes.dtype.type(1 << bit)) != 0
            plane = np.packbits(set_bits, bitorder="little")
            planes.append(plane)
            ones.append(cls._block_counts(plane, len(ids)))
            up, down = np.flatnonzero(set_bits), np.flatnonzero(~set_bits)
            zeros.append(len(down))
            codes = np.concatenate((codes[down], codes[up]))
        return cls(len(ids), alphabet[order].astype("<u4"), planes, zeros, ones)

    @staticmethod
    def _block_counts(plane: np.ndarray, n: int) -> np.ndarray:
        """Ones before each block of 512 bits, and in all."""
        padded = np.zeros(-(-max(n, 1) // _BLOCK) * _BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded.view("<u8")).reshape(-1, _BLOCK // 64).sum(1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(per))).astype("<u4")

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        head = self.planes[level][block * _BLOCK // 8 : (i + 7) // 8]
        bits = np.unpackbits(head, bitorder="little", count=i - block * _BLOCK)
        return int(self.ones[level][block]) + int(bits.sum())

    def _select(self, level: int, k: int, bit: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value in a plane."""
        ahead = self.ones[level].astype(np.int64)
        if not bit:
            ahead = np.minimum(np.arange(len(ahead)) * _BLOCK, self.n) - ahead
        block = int(np.searchsorted(ahead, k, side="right")) - 1
        first = block * _BLOCK
        bits = np.unpackbits(self.planes[level][first // 8 : first // 8 + _BLOCK // 8], bitorder="little", count=min(_BLOCK, self.n - first))
        return first + int(np.flatnonzero(bits == bit)[k - int(ahead[block])])

    def access(self, i: int) -> int:
        code = 0
        for level, zero in enumerate(self.zeros):
            bit, before = self._bit(level, i), self._rank1(level, i)
            code = code << 1 | bit
            i = zero + before if bit else i - before
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = np.flatnonzero(self.alphabet == token)
        return int(at[0]) if len(at) else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where places ``lo`` to ``hi`` that hold ``code`` end up below the last plane."""
        for level, zero in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if code >> (len(self.zeros) - 1 - level) & 1:
                lo, hi = zero + a, zero + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> list[int]:
        """Places of a token, ascending, by select from the last plane up."""
        code = self._code(token)
        if code is None:
            return []
        a, b = self._range(code, 0, self.n)
        places = []
        for i in range(a, b):
            for level in range(len(self.zeros) - 1, -1, -1):
                bit = code >> (len(self.zeros) - 1 - level) & 1
                i = self._select(level, i - self.zeros[level] * bit, bit)
            places.append(i)
        return places

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last up."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            set_bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(codes)
            zero = self.zeros[level]
            above[np.flatnonzero(~set_bits)] = codes[:zero]
            above[np.flatnonzero(set_bits)] = codes[zero:] | codes.dtype.type(1 << (len(self.planes) - 1 - level))
            codes = above
        return self.alphabet[codes] if self.n else np.zeros(0, "<u4")


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard: header, document directory, alphabet, zero counts, then planes with their ranks."""
    m = WaveletMatrix.build(ids)
    parts = [
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u4").tobytes(),
        m.alphabet.tobytes(),
        np.array(m.zeros, "<u4").tobytes(),
        *[x.tobytes() for pair in zip(m.planes, m.ones) for x in pair],
    ]
    squeezed = [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]
    sizes = struct.pack(f"<{len(squeezed)}I", *[len(p) for p in squeezed])
    return b"".join([_MAGIC, struct.pack("<QQI", m.n, len(doc_ids), len(squeezed)), sizes, *squeezed])


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if data[:8] != _MAGIC:
        raise ValueError("not a token shard")
    n, n_docs, k = struct.unpack_from("<QQI", data, 8)
    sizes = struct.unpack_from(f"<{k}I", data, 28)
    at, parts = 28 + 4 * k, []
    for size in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]) if size else b"")
        at += size
    nulls, ids = np.frombuffer(parts[0], bool), np.frombuffer(parts[1], "<i8")
    doc_ids = [None if z else int(d) for z, d in zip(nulls, ids)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[5::2]]
    ones = [np.frombuffer(p, "<u4") for p in parts[6::2]]
    zeros = [int(z) for z in np.frombuffer(parts[4], "<u4")]
    return doc_ids, np.frombuffer(parts[2], "<u4"), WaveletMatrix(n, np.frombuffer(parts[3], "<u4"), planes, zeros, ones)


_SHARD = "part int, seq int, before bigint, n_docs bigint, n_tokens bigint, payload binary"


def write_shards(
    documents: DataFrame, out: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every text (null: empty) with ``end_id`` appended and write the shards below ``out``.

    A shard is closed at ``shard_tokens`` ids, so a task holds one shard; only a single longer
    document makes a larger one. An empty table writes no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, counts=False)
        end = np.array([end_id], "<u4").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, ids, size = [], [], [], 0

        def close():
            row = [part, seq, before, len(docs), size, pack_shard(docs, lengths, np.frombuffer(b"".join(ids), "<u4"))]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["part", "seq", "before", "n_docs", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for some in groups(t.as_py() or b"" for t in batch.column(1).cast(pa.binary())):
                for encoded in enc.encode(some):
                    docs.append(next(keys))
                    ids.append(encoded + end)
                    lengths.append(len(encoded) // 4 + 1)
                    size += lengths[-1]
                    if size >= shard_tokens:
                        yield close()
                        seq, before = seq + 1, before + size
                        docs, lengths, ids, size = [], [], [], 0
        if docs:
            yield close()

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(shards, _SHARD).write.parquet(out)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32, in no order."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1)):
                doc_ids, lengths, matrix = open_shard(payload.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begins + start.as_py()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_start(spark, path).select("start", "payload").mapInArrow(docs, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    """Shards with the number of ids in all ranges and shards before them."""
    shards = spark.read.schema(_SHARD).parquet(path)
    # One row per range, at most the number of shuffle partitions of the writer.
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(ahead, F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))


def token_counts_by_shard(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often a token occurs in each shard, by rank."""

    def count(batches):
        for batch in batches:
            n = [open_shard(p.as_py())[2].count(token) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["start", "n"])

    return _with_start(spark, path).select("start", "payload").mapInArrow(count, "start bigint, n bigint")


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of a token: doc_id and the place in the document, by select."""

    def places(batches):
        for batch in batches:
            for p in batch.column(0):
                doc_ids, lengths, matrix = open_shard(p.as_py())
                at = np.array(matrix.occurrences(token), np.int64)
                ends = np.cumsum(lengths, dtype=np.int64)
                which = np.searchsorted(ends, at, side="right")
                rows = [pa.array([doc_ids[i] for i in which], pa.int64()), pa.array(at - (ends - lengths)[which])]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "place"])

    return spark.read.schema(_SHARD).parquet(path).select("payload").mapInArrow(places, "doc_id bigint, place bigint")
