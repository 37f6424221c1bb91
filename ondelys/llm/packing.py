"""Packing token sequences by bounded-space online best fit.

Documents are encoded whole; only one above the capacity is cut.  Pieces are
dealt by a hash of their place in the staged table, whatever their ids, into
groups of about ``GROUP`` pieces, and each group is packed by one pass over its
pieces, longest first: a piece goes into the open bin with the least sufficient
free space, found in a bitset keyed by free space; at most ``open_bins`` bins
are open, and the fullest closes first.  Placement is final and emitted at
once, so a task holds the open bins only.  The bound is met where pieces of
about half the capacity abound; a group of short pieces stays below it.

Defined results:

* null or empty text: the end id alone, one piece of length 1;
* null ``doc_id``: packed like any other; repeated rows: each is packed;
* empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..scratch import stage
from .memory import released
from .tokenids import encode_documents

CAPACITY = 4096
#: Pieces of one packing group; a group leaves a bin or two part-filled.
GROUP = 100_000
OPEN_BINS = 16_384
ROWS = 20_000


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = self.open = self.made = 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int, oldest: bool = False) -> int:
        held = self.bins[free]
        found = held.pop(0) if oldest else held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; the placement is final."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return bin_, self.capacity - free
                self._take(fullest, oldest=True)
            self.bins.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    kind = docs.schema["doc_id"].dataType
    fields = [StructField("doc_id", kind), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    names = [f.name for f in fields] + ["ids"] * with_ids

    def rows(ids: pa.Array, found: list) -> pa.RecordBatch:
        row, piece, start, length, crc, *raw = zip(*found, strict=True)
        columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.binary()) for x in raw], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found, held = [], 0
            for i, ids in enumerate(encode_documents(tokenizer, (t.as_py() for t in batch.column(1)), end_id)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    found.append((i, k, at, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                    held += len(part) * with_ids
                if len(found) >= ROWS or held > 1 << 24:
                    yield rows(batch.column(0), found)
                    found, held = [], 0
            if found:
                yield rows(batch.column(0), found)

    schema = StructType(fields + [StructField("ids", BinaryType())] * with_ids)
    return docs.select("doc_id", "text").mapInArrow(kernel, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """``parts`` with sequence_id and offset; needs doc_id, piece, start, length.

    ``parts`` must be staged: it is counted, then dealt.
    """
    groups = max(1, -(-parts.count() // group))
    # By place and not by id: any number of pieces may share an id, or have none.
    dealt = parts.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    order = [F.col("group"), F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    sorted_ = dealt.repartition(groups, "group").sortWithinPartitions(*order)
    schema = StructType([*sorted_.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, OpenBins(capacity, open_bins)
        for batch in released(batches):
            sequence, offset = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            of, lengths = batch.column("group").to_pylist(), batch.column("length").to_pylist()
            for i, (g, n) in enumerate(zip(of, lengths, strict=True)):
                if g != now:
                    now, bins = g, OpenBins(capacity, open_bins)
                b, offset[i] = bins.place(n)
                sequence[i] = (g << 40) + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    return sorted_.mapInArrow(kernel, schema).drop("group")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, open_bins, group)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of long), parts.

    A sequence holds ``capacity`` ids at most, so its group is bounded.
    """
    placed = pack(stage(pieces(docs, tokenizer, end_id, capacity, with_ids=True), "pieces"), capacity, open_bins, group)
    kind = placed.schema["doc_id"].dataType
    part = StructType([StructField("doc_id", kind), StructField("piece", IntegerType()), StructField("offset", LongType()), StructField("length", LongType())])
    schema = StructType([StructField("sequence_id", LongType()), StructField("ids", ArrayType(LongType())), StructField("parts", ArrayType(part))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64) for row in batch.column("held").to_pylist()]
            parts = [[{k: p[k] for k in ("doc_id", "piece", "offset", "length")} for p in row] for row in batch.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.struct([pa.field(f.name, t) for f, t in zip(part.fields, [batch.schema.field("held").type.value_type.field(n).type for n in ("doc_id", "piece", "offset", "length")], strict=True)])))], schema.names)

    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("held"))
    return held.mapInArrow(join, schema)
