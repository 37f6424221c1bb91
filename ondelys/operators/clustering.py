"""K-means and spherical k-means: a loop of aggregations around k means.

The state is k means of one width, bounded by the model; points are never
gathered.  Seeds follow a contract (equal seeds, equal results), not another
generator's stream.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import norm
from ..schema import DataError

#: Products held at a time.
CELLS = 1 << 20


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _gaps(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Squared distances to every mean."""
    out = np.empty((len(points), len(means)))
    step = max(1, CELLS // max(1, means.size))
    for at in range(0, len(points), step):
        out[at : at + step] = ((points[at : at + step, None] - means[None]) ** 2).sum(axis=2)
    return out


def _with_clusters(ds: DataFrame, means: list[list[float]], spherical: bool) -> DataFrame:
    """``ds`` with the nearest mean, or the most similar, ties to the lowest; the means are sent, not written into the plan."""
    sent = ds.sparkSession.sparkContext.broadcast(np.array(means, float))
    schema = StructType([*ds.schema.fields, StructField("cluster", IntegerType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _points(batch.column("point"))
                found = (points @ sent.value.T).argmax(axis=1) if spherical else _gaps(points, sent.value).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema.names)

    return ds.mapInArrow(kernel, schema)


def _mapped(ds: DataFrame, means: list[list[float]], work) -> DataFrame:
    """(id, pos, point) with ``work`` of the points and means for point; works on streams."""
    sent = ds.sparkSession.sparkContext.broadcast(np.array(means, float))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(work(_points(batch.column(2)), sent.value)), pa.list_(pa.float64()))], ["id", "pos", "point"])

    return ds.select("id", "pos", "point").mapInArrow(kernel, "id string, pos long, point array<double>")


def _update(assigned: DataFrame, means: list[list[float]]) -> list[list[float]]:
    """Means of the members; an empty cluster keeps its own.  A task sends one sum for each cluster."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(len(means), np.int64)
        for batch in batches:
            if batch.num_rows:
                points, cluster = _points(batch.column(1)), batch.column(0).to_numpy()
                total = np.zeros((len(means), points.shape[1])) if total is None else total
                np.add.at(total, cluster, points)
                count += np.bincount(cluster, minlength=len(means))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array([] if total is None else list(total[at]), pa.list_(pa.float64()))], ["cluster", "n", "total"])

    parts = assigned.select("cluster", "point").mapInArrow(kernel, "cluster int, n long, total array<double>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("dim", "v")).groupBy("cluster", "dim").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    out = [list(m) for m in means]
    for r in sums:
        out[r["cluster"]][r["dim"]] = r["v"]
    if len({r["cluster"] for r in sums}) < len(means):
        warnings.warn("some clusters are empty", stacklevel=3)
    return out


@dataclass
class KMeans:
    """Lloyd's algorithm until assignments stop changing or ``max_iter``."""

    k: int = 4
    max_iter: int = 100
    init: str = "assignment"
    seed: int = 42
    means: list[list[float]] | None = field(default=None)

    spherical = False

    def _initial(self, ds: DataFrame) -> list[list[float]]:
        count, seed = ds.count(), F.lit(self.seed)
        if count < self.k:
            raise DataError("there are fewer points than clusters")
        # k rows leave the executors.
        order = F.xxhash64("id", seed)
        if self.init == "assignment":
            random = ds.withColumn("cluster", F.pmod(order, F.lit(self.k)).cast("int"))
            width = len(ds.select("point").first()[0])
            return _update(random, [[0.0] * width for _ in range(self.k)])
        if self.init == "points":
            return [r["point"] for r in ds.orderBy(order, "pos").limit(self.k).collect()]
        if self.init == "sampling":
            # Markov chain over a stated number of drawn points, by distance to the means so far.
            drawn = np.array([r["point"] for r in ds.orderBy(order, "pos").limit(200 * self.k).collect()])
            random = np.random.default_rng(self.seed)
            means = [drawn[0]]
            for _ in range(1, self.k):
                gaps = np.min([((drawn - m) ** 2).sum(axis=1) for m in means], axis=0)
                at = random.integers(len(drawn))
                for _ in range(200):
                    to = random.integers(len(drawn))
                    if gaps[at] == 0 or gaps[to] / gaps[at] > random.random():
                        at = to
                means.append(drawn[at])
            return [m.tolist() for m in means]
        raise DataError("init is assignment, points or sampling")

    def _prepared(self, ds: DataFrame) -> DataFrame:
        return ds

    def _renewed(self, means: list[list[float]]) -> list[list[float]]:
        return means

    def _assign(self, ds: DataFrame, means: list[list[float]]) -> DataFrame:
        return _with_clusters(ds, means, self.spherical)

    def fit(self, ds: DataFrame) -> KMeans:
        """A new model; existing means of the right number are where it starts from."""
        data = self._prepared(ds).select("id", "pos", "point").persist()
        means = self.means if self.means is not None and len(self.means) == self.k else self._renewed(self._initial(data))
        for _ in range(self.max_iter):
            new = self._renewed(_update(self._assign(data, means), means))
            # Equal means give equal assignments and the other way round.
            still = new == means
            means = new
            if still:
                break
        data.unpersist()
        return type(self)(self.k, self.max_iter, self.init, self.seed, means)

    def predict(self, ds: DataFrame) -> DataFrame:
        """(id, pos, cluster) by the nearest mean."""
        return _with_clusters(ds.select("id", "pos", "point"), self.means, False).drop("point")

    def predict_point(self, point: list[float]) -> int:
        return int(np.argmin(((np.array(self.means) - np.array(point)) ** 2).sum(axis=1)))

    def transform(self, ds: DataFrame) -> DataFrame:
        """Squared distances to every mean."""
        return _mapped(ds, self.means, _gaps)

    def sizes(self, ds: DataFrame) -> DataFrame:
        """(cluster, count) with empty clusters."""
        found = self.predict(ds).groupBy("cluster").count()
        every = ds.sparkSession.range(self.k).select(F.col("id").cast("int").alias("cluster"))
        return every.join(found, "cluster", "left").select("cluster", F.coalesce("count", F.lit(0)).alias("count"))


@dataclass
class SKMeans(KMeans):
    """Spherical: unit points, most similar mean, means of unit length."""

    spherical = True

    def _prepared(self, ds: DataFrame) -> DataFrame:
        return ds.withColumn("point", F.transform("point", lambda v: v / norm(F.col("point"))))

    def _renewed(self, means: list[list[float]]) -> list[list[float]]:
        out = []
        for m in means:
            size = float(np.linalg.norm(m))
            out.append([x / size for x in m] if size else m)
        return out

    def encode(self, ds: DataFrame, threshold: float = 0.25) -> DataFrame:
        """max(0, likeness to every mean - threshold); points as they are."""
        return _mapped(ds, self.means, lambda points, means: np.maximum(points @ means.T - threshold, 0.0))
