"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every shingle of ``width`` words, repeats
included; a bit is 1 if it is set in over half of the hashes.  Two documents
link if their fingerprints differ in at most ``radius`` bits.

Exact equals share a fingerprint and are folded first, so a group of copies of
any size is one row.  Distinct fingerprints meet in tables keyed by two of
their four 16-bit parts: with at most two differing bits, two parts agree, so
no link is lost.  A key shared by more than ``SPLIT`` fingerprints is divided
once more by two of the four bytes left; such a group holds 2**16 fingerprints
at most, since 48 of 64 bits are fixed, which bounds a task whatever the data.
Inside a group fingerprints are compared by :mod:`bitslice`, and only a
spanning forest of its links leaves the group.

Defined results:

* null or empty text, or one without words: fingerprint zero, linked like any
  other;
* fewer than ``width`` words: the whole sequence is the one shingle;
* null ``doc_id``: gets a fingerprint and the smallest known id of its
  component, null if none is known;
* repeated rows: each is returned; empty table: empty result;
* extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import stage
from .bitslice import local_links
from .components import components
from .memory import released
from .words import split_words

SEED = 42
WIDTH = 3
RADIUS = 2
#: Fingerprints under one key before it is divided by further bits.
SPLIT = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = split_words((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(width, len(words))
    starts, ends = start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(kernel, StructType([StructField("doc_id", kind), StructField("fp", LongType())]))


def _pair_keys(value: Column, bits: int) -> Column:
    """Keys by any two of the four ``bits``-wide parts of ``value``."""
    mask = (1 << bits) - 1
    part = [F.shiftrightunsigned(value, bits * i).bitwiseAND(F.lit(mask)) for i in range(4)]
    return F.array(*[F.lit(t * (1 << 2 * bits)) + part[i] * (1 << bits) + part[j] for t, (i, j) in enumerate(combinations(range(4), 2))])


def _rest(fp: Column, key: Column) -> Column:
    """The 32 bits that a table's key leaves open."""
    part = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out, table = F.lit(None).cast("long"), F.shiftrightunsigned(key, 32)
    for t, pair in enumerate(combinations(range(4), 2)):
        i, j = (x for x in range(4) if x not in pair)
        out = F.when(table == t, part[i] * (1 << 16) + part[j]).otherwise(out)
    return out


def _links_kernel(radius: int):
    def links(prints: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(new)
        a, b = local_links(prints, starts, np.diff(np.r_[starts, len(prints)]), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by (key, sub): a group ends where either changes; the last waits for the next batch.
        keys, subs, prints = (np.zeros(0, np.int64) for _ in range(3))
        for batch in released(batches):
            k, s, p = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            keys, subs, prints = np.r_[keys, k], np.r_[subs, s], np.r_[prints, p]
            if not len(keys):
                continue
            new = np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])]
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield links(prints[:last].view(np.uint64), new[:last])
            keys, subs, prints = keys[last:], subs[last:], prints[last:]
        if len(keys):
            yield links(prints.view(np.uint64), np.arange(len(prints)) == 0)

    return kernel


def links(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to join every component."""
    if radius > 2:
        raise ValueError("two of four parts agree for certain only up to a radius of 2")
    keyed = prints.select("fp", F.explode(_pair_keys(F.col("fp"), 16)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > split).select(F.col("key").alias("large"))
    rest = _pair_keys(_rest(F.col("fp"), F.col("key")), 8)
    whole = F.array(F.lit(-1).cast("long"))
    parts = keyed.join(large, F.col("key") == F.col("large"), "left").select(
        "key", F.explode(F.when(F.col("large").isNull(), whole).otherwise(rest)).alias("sub"), "fp"
    )
    dealt = parts.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_links_kernel(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id): the smallest ``doc_id`` that links reach."""
    prints = stage(fingerprints(docs, width), "fingerprints")
    folded = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "folded")
    roots = components(links(folded.select("fp"), radius, split))
    rooted = folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(of, prints["fp"] == of["of"]).select("doc_id", "fp", "component_id")
