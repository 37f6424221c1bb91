"""Wavelet matrices of token ids: one compressed, searchable file per shard.

A wavelet matrix keeps one bit plane per bit of the ids, highest first; between
planes the sequence is stably split into those with bit 0 and those with bit 1.
With a count of ones at every 512th position, rank and select on the planes
give token access, counts and occurrences from the file alone, and following
the splits backwards gives the whole sequence.

File: magic, length of the header, JSON header, then sections, each
zstd-compressed: ``docs`` (Arrow: doc_id, n_tokens), ``plane<b>`` (bits, eight
to a byte, lowest first) and ``ranks<b>`` (uint32 counts before each block).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import scratch_path, stage
from .memory import released
from .tokenids import encode_documents

MAGIC = b"OWM1"
#: Bits between two stored ranks.
RANK_BLOCK = 512
#: Tokens of one shard at most, unless a single document is longer.
SHARD_TOKENS = 1 << 20
SUFFIX = ".owm"


class WaveletMatrix:
    """Succinct sequence of unsigned ids with access, rank and select."""

    def __init__(self, length: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.length, self.zeros, self.planes, self.ranks = length, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % (RANK_BLOCK // 8) or 0, np.uint8)]
            counts = np.bitwise_count(packed.view("<u8")).reshape(-1, RANK_BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.r_[np.uint32(0), np.cumsum(counts, dtype=np.uint32)])
            low, high = now.compress(~one), now.compress(one)
            zeros.append(len(low))
            now = np.concatenate((low, high))
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, k: int, position: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        position = np.asarray(position, np.int64)
        block, plane = position // RANK_BLOCK, self.planes[k].view("<u8")
        ones = self.ranks[k][block].astype(np.int64)
        first, full = block * (RANK_BLOCK // 64), position // 64
        for w in range(RANK_BLOCK // 64):
            at = first + w
            inside = at < full
            ones += np.where(inside, np.bitwise_count(plane[np.where(inside, at, 0)]), 0)
        rest = (position % 64).astype(np.uint64)
        cut = rest > 0
        word = plane[np.where(cut, full, 0)] & ((np.uint64(1) << rest) - np.uint64(1))
        return ones + np.where(cut, np.bitwise_count(word), 0)

    def access(self, positions) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.length):
            raise IndexError("position outside the shard")
        out = np.zeros(len(at), np.uint32)
        for k in range(len(self.planes)):
            bit = self.planes[k][at // 8] >> (at % 8).astype(np.uint8) & 1
            ones = self._ones(k, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie behind the last plane."""
        if token >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for k in range(len(self.planes)):
            ones = self._ones(k, np.array([low, high]))
            if token >> (len(self.planes) - 1 - k) & 1:
                low, high = self.zeros[k] + int(ones[0]), self.zeros[k] + int(ones[1])
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def rank(self, token: int, position: int) -> int:
        """Occurrences of a token before a position."""
        low, high = self._range(token, position)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def _select_bit(self, k: int, bit: np.ndarray | int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) one or zero of plane k."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.length, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self._ones(k, middle + 1)
            enough = (ones if bit else middle + 1 - ones) > nth
            high, low = np.where(enough & (low < high), middle, high), np.where(~enough & (low < high), middle + 1, low)
        return low

    def select(self, token: int, nth) -> np.ndarray:
        """Positions of the nth (from 0) occurrences of a token."""
        low, high = self._range(token, self.length)
        at = low + np.asarray(nth, np.int64)
        if len(at) and not (low <= at.min() and at.max() < high):
            raise IndexError("no such occurrence")
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            at = self._select_bit(k, one, at - self.zeros[k] if one else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending."""
        return self.select(token, np.arange(self.count(token)))

    def decode(self) -> np.ndarray:
        """The whole sequence, by following the splits backwards."""
        now = np.zeros(self.length, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (zeros, plane) in enumerate(zip(reversed(self.zeros), reversed(self.planes), strict=True)):
            one = np.unpackbits(plane, count=self.length, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~one)] = now[:zeros]
            before[np.flatnonzero(one)] = now[zeros:] | now.dtype.type(1 << b)
            now = before
        return now


def write_shard(matrix: WaveletMatrix, docs: pa.Table, extra: dict) -> bytes:
    """One shard as the bytes of its file."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_table(docs)
    raw = {"docs": sink.getvalue().to_pybytes()}
    for k, (plane, ranks) in enumerate(zip(matrix.planes, matrix.ranks, strict=True)):
        raw[f"plane{k}"], raw[f"ranks{k}"] = plane.tobytes(), ranks.astype("<u4").tobytes()
    pack, sections, body, at = zstandard.ZstdCompressor(level=1).compress, {}, [], 0
    for name, data in raw.items():
        body.append(pack(data))
        sections[name] = [at, len(body[-1]), len(data)]
        at += len(body[-1])
    header = json.dumps({"length": matrix.length, "zeros": matrix.zeros, "sections": sections, **extra}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


def read_shard(data: bytes) -> tuple[WaveletMatrix, pa.Table, dict]:
    """A shard's matrix, its documents and its header."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack("<I", data[4:8])
    header, base, unpack = json.loads(data[8 : 8 + size]), 8 + size, zstandard.ZstdDecompressor().decompress

    def section(name: str) -> bytes:
        at, packed, raw = header["sections"][name]
        return unpack(data[base + at : base + at + packed], max_output_size=max(1, raw))

    bits = range(len(header["zeros"]))
    planes = [np.frombuffer(section(f"plane{k}"), np.uint8) for k in bits]
    ranks = [np.frombuffer(section(f"ranks{k}"), "<u4") for k in bits]
    docs = pa.ipc.open_stream(section("docs")).read_all()
    return WaveletMatrix(header["length"], header["zeros"], planes, ranks), docs, header


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it: Hadoop's names of S3 are pyarrow's ``s3``."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending ``doc_id`` order into shards in ``folder``.

    Returns the manifest (partition, shard, tokens); rows with equal ``doc_id``
    are ordered by the hash of their text, a null ``doc_id`` comes first.  Documents are dealt in
    ranges of ``doc_id``; a file is written under another name and then moved,
    so a task that runs again replaces equal bytes by equal bytes.
    """

    def save(fs: pafs.FileSystem, base: str, partition: int, shard: int, ids: list, counts: list, parts: list) -> tuple[int, int, int]:
        table = pa.table({"doc_id": pa.array(ids, kind), "n_tokens": pa.array(counts, pa.int64())})
        tokens = np.concatenate(parts)
        data = write_shard(WaveletMatrix.build(tokens), table, {"partition": partition, "shard": shard})
        name = f"{base}/{partition:07d}-{shard:07d}{SUFFIX}"
        draft = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(data)
        fs.move(draft, name)
        return partition, shard, len(tokens)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        partition, shard, done = TaskContext.get().partitionId(), 0, []
        ids, counts, parts, held = [], [], [], 0
        for batch in released(batches):
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encode_documents(tokenizer, (t.as_py() for t in batch.column(1)), end_id), strict=True):
                if held and held + len(tokens) > shard_tokens:
                    done.append(save(fs, base, partition, shard, ids, counts, parts))
                    shard += 1
                    ids, counts, parts, held = [], [], [], 0
                ids.append(doc_id)
                counts.append(len(tokens))
                parts.append(tokens)
                held += len(tokens)
        if ids:
            done.append(save(fs, base, partition, shard, ids, counts, parts))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*done, strict=True)) or ([], [], []))], ["partition", "shard", "tokens"])

    source = docs.select("doc_id", "text")
    kind = source.limit(0).toArrow().schema.field("doc_id").type
    ordered = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stage(ordered.mapInArrow(kernel, "partition long, shard long, tokens long"), "manifest")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, kind) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for content in batch.column(0):
                matrix, docs, header = read_shard(content.as_py())
                ids = matrix.decode().astype("<u4")
                counts = docs.column("n_tokens").to_numpy()
                end = np.cumsum(counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((end - counts).tolist(), end.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([header["partition"]] * n, pa.int64()), pa.array([header["shard"]] * n, pa.int64()), docs.column("doc_id").combine_chunks(), pa.array(end - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["partition", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    schema = StructType([StructField("partition", LongType()), StructField("shard", LongType()), StructField("doc_id", kind), *[StructField(n, LongType()) for n in ("local", "n_tokens", "ids_crc32")]])
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    # Running sums over the shards of one partition, then over the partitions.
    parts = manifest.groupBy("partition").agg(F.sum("tokens").alias("part_tokens"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("partition").alias("p"), F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.withColumn("shard_start", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, F.col("partition") == F.col("p"))
    bases = bases.select("partition", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    found = files.mapInArrow(kernel, schema).join(bases, ["partition", "shard"])
    return found.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents to shard files and report what the files hold.

    Defined results: null or empty text is the end id alone; repeated rows are
    written each; an empty table writes no file and gives an empty result.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    manifest = write_shards(docs, tokenizer, folder, end_id, shard_tokens)
    kind = docs.schema["doc_id"].dataType
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], StructType([StructField("doc_id", kind), *[StructField(n, LongType()) for n in ("start", "n_tokens", "ids_crc32")]]))
    return read_documents(docs.sparkSession, folder, manifest, kind)


def lookup(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Every occurrence of a token: (partition, shard, position), by rank and select."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for content in batch.column(0):
                matrix, _, header = read_shard(content.as_py())
                at = matrix.occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([header["partition"]] * len(at), pa.int64()), pa.array([header["shard"]] * len(at), pa.int64()), pa.array(at, pa.int64())], ["partition", "shard", "position"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    return files.mapInArrow(kernel, "partition long, shard long, position long")
