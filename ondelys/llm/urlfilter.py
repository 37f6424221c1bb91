"""URL verdicts by rules of any number: blocked Bloom filter, then exact hash join.

A rule is a host and a path.  It fits its host and every subdomain if the
url's path starts with the rule's; the longest fitting rule wins, and of equal
ones ``block``.  Every url is turned into the canonical keys that could be
listed: each suffix of its host with as many labels as a rule's host has, with
each path prefix of a length that rules have.  However long a url is, its keys
are bounded by the rules.  A blocked Bloom filter, one cache line of eight 64-bit words to a key,
lets the possible ones pass; an exact join with the rules then removes false
positives.  The filter never exceeds ``FILTER_BYTES``, however long the list,
so it may be broadcast; urls without a possible hit are done then and aren't
shuffled, and the rules themselves are joined with the others, hot keys
included, as the optimizer's measured sizes allow.

Defined results: null url, or one without ``://``: host and path empty, no
rule, ``allow``.  Repeated rows are judged each; an empty table gives an empty
result; other columns are ignored; without rules everything is allowed.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..scratch import stage

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
FILTER_BYTES = 64 << 20
BITS_PER_KEY = 16
WORDS = 8
#: Odd multipliers, one per word of a block: fixed values of the Parquet format's split-block filter.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty if there is none."""
    at = F.instr(url, "://")
    tail = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(tail, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)


def build_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """(blocks, 8) words of the filter over the string column ``key``.

    Built by OR per block on the executors; what is gathered is the filter,
    whose size is bounded by ``most_bytes``.
    """
    blocks = int(min(max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS))), most_bytes // (8 * WORDS)))
    h = F.xxhash64("key")
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).alias("block")
    # The product is taken in two halves of the salt, so that it stays within a long.
    product = [(low * F.lit(s & 0xFFFF) + (low * F.lit(s >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)).bitwiseAND(F.lit(0xFFFFFFFF)) for s in SALTS]
    bits = [F.shiftrightunsigned(p, 26) for p in product]
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) for b in bits]
    rows = keys.select(block, *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    out = np.zeros((blocks, WORDS), np.uint64)
    got = rows.toArrow()
    if got.num_rows:
        words = np.stack([got.column(f"w{i}").to_numpy() for i in range(WORDS)], axis=1).astype(np.int64)
        out[got.column("block").to_numpy()] = words.view(np.uint64)
    return out


def may_contain(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit key hashes may be in the filter."""
    rows = table[(hashes >> np.uint64(32)) % np.uint64(len(table))]
    low, passed = hashes & np.uint64(0xFFFFFFFF), np.ones(len(hashes), bool)
    for i, salt in enumerate(SALTS):
        bit = (low * np.uint64(salt) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        passed &= (rows[:, i] >> bit & np.uint64(1)).astype(bool)
    return passed


def candidate_keys(host: str, path: str, labels: list[int], lengths: list[int]) -> list[str]:
    """Canonical keys under which a url could be listed; ``labels`` and ``lengths`` ascending, of the rules' hosts and paths."""
    if not host or not labels:
        return []
    # One label more than any rule has shows that the host goes on.
    parts = host.rsplit(".", labels[-1])
    whole = len(parts) <= labels[-1]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    suffixes = [".".join(parts[-n:]) for n in labels if n < len(parts) or n == len(parts) and whole]
    return [s + p for s in suffixes if s for p in prefixes]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of ``pages``.

    ``rules``: host, path, verdict.  ``default`` is the verdict of a url that
    isn't listed.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), F.col("verdict").alias("listed_verdict"), F.length("path").alias("path_length"), F.size(F.split("host", "[.]")).alias("labels")).where("key is not null")
    # Bounded by the longest url a rule holds.
    lengths, labels = (sorted(r[0] for r in listed.select(c).distinct().collect()) for c in ("path_length", "labels"))
    spark = pages.sparkSession
    table = spark.sparkContext.broadcast(build_filter(listed.select("key"), most_bytes))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys = [candidate_keys(h, p, labels, lengths) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            flat = [k for row in keys for k in row]
            hit = may_contain(table.value, np.array([digest(k.encode(), 42) for k in flat], np.uint64)).tolist() if flat else []
            at, hits = 0, []
            for row in keys:
                hits.append([k for k, yes in zip(row, hit[at : at + len(row)], strict=True) if yes])
                at += len(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "hits"])

    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    schema = StructType([*parsed.schema.fields, StructField("hits", ArrayType(StringType()))])
    probed = stage(parsed.mapInArrow(kernel, schema).withColumn("row", F.monotonically_increasing_id()), "probed")
    columns = ["page_id", "url", "host", "path"]
    unlisted = probed.where("size(hits) = 0").select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = probed.where("size(hits) > 0").select("row", *columns, F.explode("hits").alias("hit"))
    joined = possible.join(listed, possible["hit"] == listed["key"], "left")
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), F.col("listed_verdict"), F.col("key")))).alias("best")
    found = joined.groupBy("row", *columns).agg(best)
    return unlisted.unionByName(found.select(*columns, F.col("best.key").alias("rule"), F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict")))


#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

JUDGE_SQL = f"""
WITH tails AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
parsed AS (
  SELECT row, page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM tails),
rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fitting AS (
  SELECT row, max({{'n': length(r_host || r_path), 'verdict': r_verdict, 'rule': r_host || r_path}}) AS best
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY row)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fitting USING (row)
"""
