"""Exact nearest neighbours, votes and weighted means.

Points are dealt to leaves by median splits taken from a bounded sample, so a
leaf is a region of space.  A query first looks into its own leaf, which gives
it a bound, and then into those leaves alone whose bounding box is nearer than
the bound; where points have few dimensions that is a small share of them.  A
leaf above ``LEAF`` points is dealt over chunks.  All of it is one lazy plan but
for the counts and the splits; nothing is gathered, and the sides may have any
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..schema import DataError
from ..scratch import stage

#: Points of a leaf, leaves at most, and points from which the splits are taken.
LEAF, LEAVES, SAMPLE = 16_384, 1024, 65_536
BLOCK = 256


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Splits:
    """Median splits along the widest dimension: a complete tree, nodes by level."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, (leaves - 1).bit_length()) if len(sample) else 0
        self.dim, self.at = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [sample]
        for level in range(self.depth):
            now = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part):
                    self.dim[node] = np.ptp(part, axis=0).argmax()
                    self.at[node] = np.median(part[:, self.dim[node]])
                low = part[:, self.dim[node]] <= self.at[node]
                now += [part[low], part[~low]]
            parts = now

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            at = 2 * at + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return at


def _dealt(table: DataFrame, splits: Splits, names: str) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = splits.leaf(_points(batch.column("point"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return table.mapInArrow(kernel, f"{names}, leaf long")


def _boxes(dealt: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves in use, and the least and largest values of each: ``LEAVES`` rows at most."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            leaf, points = batch.column(0).to_numpy(), _points(batch.column(1)) if batch.num_rows else None
            for x in np.unique(leaf).tolist():
                low, high = points[leaf == x].min(axis=0), points[leaf == x].max(axis=0)
                before = found.get(x, (low, high))
                found[x] = np.minimum(low, before[0]), np.maximum(high, before[1])
        lows, highs = [v[0].tolist() for v in found.values()], [v[1].tolist() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(lows, pa.list_(pa.float64())), pa.array(highs, pa.list_(pa.float64()))], ["leaf", "low", "high"])

    rows = dealt.select("leaf", "point").mapInArrow(kernel, "leaf long, low array<double>, high array<double>")
    each = rows.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "v")).groupBy("leaf", "dim").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high"))
    rows = each.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("v")).orderBy("leaf").collect()
    return np.array([r["leaf"] for r in rows]), *(np.array([[v[c] for v in r["v"]] for r in rows], float) for c in ("low", "high"))


def _best(names: list[str], x: np.ndarray, ids: np.ndarray, pos: np.ndarray, points: np.ndarray, k: int, radius: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, pos, distance) of the ``k`` nearest (0: all) to each query, ties to the lower position."""
    rough = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * x @ points.T
    limit = np.full(len(x), np.inf) if radius <= 0 else np.full(len(x), radius**2)
    if 0 < k < len(points):
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
    # What rounding may add to a square of a distance; all that may tie is looked at exactly.
    slack = 1e-9 * (1 + (x**2).sum(axis=1) + (points**2).sum(axis=1).max())
    row, col = np.nonzero(rough <= (limit + slack)[:, None])
    exact = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.sqrt(((x[row[part]] - points[col[part]]) ** 2).sum(axis=1))
    order = np.lexsort((pos[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    keep = exact < radius if radius > 0 else np.isfinite(exact)
    if k:
        keep &= np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row] < k
    row, col, exact = row[keep], col[keep], exact[keep]
    return [names[i] for i in row], ids[col], pos[col], exact


def _search(held: DataFrame, asked: DataFrame, k: int, radius: float) -> DataFrame:
    """(query, id, pos, distance) among rows that share leaf and chunk."""
    place = ["leaf", "chunk"]
    held = held.select(*place, F.lit(0).alias("kind"), "id", "pos", "point")
    asked = asked.select(*place, F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("pos"), "point")
    dealt = held.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], axis=1)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]).tolist()
            names, pos, points = batch.column("id").to_pylist(), batch.column("pos").to_numpy(zero_copy_only=False), _points(batch.column("point"))
            for a, b in zip(edges, edges[1:], strict=False):
                if tuple(key[a, :2]) != now:
                    now, parts = tuple(key[a, :2]), []
                if key[a, 2] == 0:
                    parts.append((np.array(names[a:b], object), pos[a:b], points[a:b]))
                    continue
                if len(parts) > 1:
                    parts = [tuple(np.concatenate(c) for c in zip(*parts, strict=True))]
                for at in range(a, b, BLOCK) if parts else ():
                    to = min(b, at + BLOCK)
                    query, found, where, distance = _best(names[at:to], points[at:to], *parts[0], k, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(list(found), pa.string()), pa.array(where, pa.int64()), pa.array(distance)], ["query", "id", "pos", "distance"])

    return dealt.mapInArrow(kernel, "query string, id string, pos long, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "pos")))
    return ranked.where(F.col("rank") <= k) if k else ranked


def nearest(ds: DataFrame, queries: DataFrame, k: int = 1, radius: float = 0.0, leaf: int = LEAF) -> DataFrame:
    """(query, rank, id, distance): the ``k`` nearest rows of ``ds`` to each row of ``queries``.

    Ascending, ties by position; k = 0 takes all; a radius keeps what is
    strictly nearer.
    """
    if k < 0:
        raise DataError("k is negative")
    out = ["query", F.col("rank").cast("int").alias("rank"), "id", "distance"]
    ds, queries = ds.select("id", "pos", "point"), queries.select("id", "point")
    count = ds.count()
    leaves = min(LEAVES, -(-count // leaf))
    zero = F.lit(0).cast("long")
    if leaves <= 1:
        return _ranked(_search(ds.withColumn("leaf", zero).withColumn("chunk", zero), queries.withColumn("leaf", zero).withColumn("chunk", zero), k, radius), k).select(*out)
    # SAMPLE rows at most.
    share = min(1.0, 2 * SAMPLE / count)
    sample = ds.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("point").limit(SAMPLE).collect()
    splits = Splits(np.array([r["point"] for r in sample], float), leaves)
    dealt = stage(_dealt(ds, splits, "id string, pos long, point array<double>"), "leaves")
    names, low, high = _boxes(dealt)
    parts = dealt.groupBy(F.col("leaf").alias("l")).agg(F.ceil(F.count(F.lit(1)) / leaf).alias("parts"))

    def chunked(rows: DataFrame, query: bool) -> DataFrame:
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if query else F.pmod(F.xxhash64("id"), F.col("parts"))
        return rows.join(parts, F.col("leaf") == F.col("l")).withColumn("chunk", chunk)

    held = chunked(dealt, False)
    home = _dealt(queries, splits, "id string, point array<double>")
    first = stage(_ranked(_search(held, chunked(home, True), k, radius), k).select("query", "id", "pos", "distance"), "first")
    # The distance of the last of k; without so many, or for all, everything is within reach but for the radius.
    reach = first.groupBy(F.col("query").alias("of")).agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    bound = F.when((F.lit(k) > 0) & (F.col("n") >= k), F.col("far")).otherwise(F.lit(float("inf") if radius <= 0 else radius))
    asking = home.join(reach, F.col("id") == F.col("of"), "left").select("id", "point", "leaf", bound.alias("bound"))

    def near_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, own, bound = _points(part.column("point")), part.column("leaf").to_numpy(), part.column("bound").to_numpy()
                gap = np.sqrt((np.maximum(0, np.maximum(low[None] - x[:, None], x[:, None] - high[None])) ** 2).sum(axis=2))
                # A little more than the bound, for rounding; ties count.
                row, col = np.nonzero((gap <= (bound * (1 + 1e-9) + 1e-12)[:, None]) & (names[None] != own[:, None]))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), part.column("point").take(pa.array(row)), pa.array(names[col], pa.int64())], ["id", "point", "leaf"])

    other = asking.mapInArrow(near_kernel, "id string, point array<double>, leaf long")
    return _ranked(first.unionByName(_search(held, chunked(other, True), k, radius)), k).select(*out)


def lookup(neighbours: DataFrame, table: DataFrame) -> DataFrame:
    """Neighbours with their points in another data set; those it lacks are left out and ranks close up."""
    found = neighbours.join(table.select("id", "point"), "id")
    order = Window.partitionBy("query").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).select("query", "rank", "id", "distance", "point")


def _weights(neighbours: DataFrame, weighted: bool) -> DataFrame:
    """``w``: 1, or 1 / distance; exact matches alone count where there is one."""
    exact = F.max((F.col("distance") < EPSILON).cast("int")).over(Window.partitionBy("query")) == 1
    by_distance = F.when(exact, (F.col("distance") < EPSILON).cast("double")).otherwise(1 / F.greatest(F.col("distance"), F.lit(EPSILON)))
    return neighbours.withColumn("w", by_distance if weighted else F.lit(1.0))


def classify(ds: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 3, weighted: bool = True, compat: bool = False) -> DataFrame:
    """(id, label): the label with the largest vote of the neighbours; ties by the nearest.

    ``compat`` gives the heaviest single neighbour's label instead.
    """
    found = _weights(nearest(ds, queries, k), weighted).join(labels.select("id", "label"), "id")
    if compat:
        best = F.max_by("label", F.struct("w", -F.col("rank")))
        return found.groupBy("query").agg(best.alias("label")).select(F.col("query").alias("id"), "label")
    votes = found.groupBy("query", "label").agg(F.sum("w").alias("vote"), F.min("rank").alias("first"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("vote", -F.col("first"))).alias("label")).select(F.col("query").alias("id"), "label")


def regress(ds: DataFrame, targets: DataFrame, queries: DataFrame, k: int = 3, weighted: bool = True) -> DataFrame:
    """(id, point): weighted mean of the neighbours' target vectors."""
    found = _weights(nearest(ds, queries, k), weighted).join(targets.select("id", "point"), "id")
    found = found.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query")))
    dims = found.select("query", F.posexplode("point").alias("dim", "v"), "w").groupBy("query", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return dims.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("r")).select(F.col("query").alias("id"), F.transform("r", lambda r: r["v"]).alias("point"))
