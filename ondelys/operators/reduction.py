"""Dimension reduction: PCA, MDS and grids at any size, UMAP to a million points.

MDS compares all points with all, so its time grows with their square; above
``MOST`` points the distances are made in blocks by the executors, again for
each product, and the driver holds the points and a few vectors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..schema import DATASET, DataError
from .assignment import assign, assign_cells
from .neighbors import nearest

#: Points up to which MDS holds their distances whole; beyond, rows and columns of a block of distances.
MOST, ROWS, COLS = 5000, 1024, 2048
#: Dimensions that the vectors start from, blocks of vectors kept between restarts, passes at most, and the residual
#: asked for as a share of the largest eigenvalue.
WIDE, KEPT, PASSES, RESIDUAL = 40, 3, 60, 1e-10


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gathered(ds: DataFrame) -> tuple[list[str], np.ndarray]:
    """Ids and points in order."""
    rows = ds.select("id", "pos", "point").orderBy("pos").toArrow()
    if not rows.num_rows:
        raise DataError("the data set is empty")
    return rows.column("id").to_pylist(), np.concatenate([_matrix(c) for c in rows.column("point").chunks if len(c)]).astype(float)


def _as_dataset(ds: DataFrame, ids: list[str], points: np.ndarray) -> DataFrame:
    return ds.sparkSession.createDataFrame([(n, i, p) for i, (n, p) in enumerate(zip(ids, points.tolist(), strict=True))], DATASET)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1)


def _map_points(ds: DataFrame, work) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(_matrix(batch.column("point")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pos"), pa.array(list(out), pa.list_(pa.float64()))], ["id", "pos", "point"])

    return ds.select("id", "pos", "point").mapInArrow(kernel, "id string, pos long, point array<double>")


@dataclass
class PCA:
    """Principal components; what leaves an executor is a width x width sum."""

    dims: int = 2
    whiten: bool = False
    mean: np.ndarray | None = None
    bases: np.ndarray | None = None
    values: np.ndarray | None = None
    count: int = 0

    def fit(self, ds: DataFrame) -> PCA:
        def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, square = 0, None, None
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("point"))
                    n += len(x)
                    total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                    square = x.T @ x if square is None else square + x.T @ x
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64())), pa.array([square.ravel()], pa.list_(pa.float64()))], ["n", "total", "square"])

        parts = ds.select("point").mapInArrow(gram, "n long, total array<double>, square array<double>").toLocalIterator()
        n, total, square = 0, 0.0, 0.0
        for p in parts:
            n, total, square = n + p["n"], total + np.array(p["total"]), square + np.array(p["square"])
        if not n:
            raise DataError("the data set is empty")
        mean = total / n
        scatter = square.reshape(len(mean), -1) - n * np.outer(mean, mean)
        values, vectors = np.linalg.eigh(scatter)
        order = np.argsort(-values)
        return PCA(self.dims, self.whiten, mean, _signed(vectors[:, order]), np.sqrt(np.maximum(values[order], 0)), n)

    def explained(self) -> float:
        """Share of the variance that the kept dimensions hold."""
        power = self.values**2
        return float(power[: self.dims].sum() / max(power.sum(), 1e-300))

    def _scale(self) -> np.ndarray:
        spread = self.values[: self.dims] ** 2 / max(1, self.count - 1)
        return 1 / np.sqrt(np.maximum(spread, np.finfo(float).eps)) if self.whiten else np.ones(self.dims)

    def transform(self, ds: DataFrame) -> DataFrame:
        mean, bases = self.mean, self.bases[:, : self.dims] * self._scale()
        return _map_points(ds, lambda x: (x - mean) @ bases)

    def inverse_transform(self, ds: DataFrame) -> DataFrame:
        """Missing dimensions count as 0."""
        mean, bases = self.mean, (self.bases[:, : self.dims] / self._scale()).T
        return _map_points(ds, lambda y: y @ bases[: y.shape[1]] + mean)


def _distances(x: np.ndarray, metric: str, first: int | None = None) -> np.ndarray:
    """Distances of all points, or of the ``first``, to all."""
    eps = np.finfo(float).eps
    out = np.empty((len(x[:first]), len(x)))
    for i, a in enumerate(x[:first]):
        gap = np.abs(x - a)
        if metric in ("kl", "jensen_shannon"):
            p, q = np.maximum(a, eps), np.maximum(x, eps)
            if metric == "kl":
                out[i] = ((a - x) * (np.log(p) - np.log(q))).sum(axis=1)
            else:
                p, q = p / p.sum(), q / q.sum(axis=1, keepdims=True)
                m = (p + q) / 2
                out[i] = np.sqrt(np.maximum(0, ((p * np.log(p / m)) + (q * np.log(q / m))).sum(axis=1) / 2))
        else:
            out[i] = {"manhattan": lambda: gap.sum(axis=1), "euclidean": lambda: np.sqrt((gap**2).sum(axis=1)), "squared_euclidean": lambda: (gap**2).sum(axis=1), "max": lambda: gap.max(axis=1), "min": lambda: gap.min(axis=1), "cosine": lambda: 1 - x @ a / (np.linalg.norm(x, axis=1) * np.linalg.norm(a))}[metric]()  # noqa: B023
    return out


def _between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances (len(a), len(b)) as `_distances` has them, for sets of any size, a block at a time."""
    if metric not in ("euclidean", "squared_euclidean"):
        return np.stack([_distances(np.concatenate([row[None], b]), metric, 1)[0, 1:] for row in a])
    own, other = (a**2).sum(axis=1)[:, None], (b**2).sum(axis=1)[None]
    square = own + other - 2 * a @ b.T
    # Of near points the product leaves rounding alone.
    i, j = np.nonzero(square < 1e-5 * (own + other))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        square[i[part], j[part]] = ((a[i[part]] - b[j[part]]) ** 2).sum(axis=1)
    return square if metric == "squared_euclidean" else np.sqrt(square, out=square)


def _times_distances(spark: SparkSession, held: Broadcast, q: np.ndarray, metric: str, power: int) -> np.ndarray:
    """The matrix of all distances, raised to ``power``, times ``q``; the matrix itself is never held."""
    sent = spark.sparkContext.broadcast(q)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = held.value, sent.value
        for batch in batches:
            for n in batch.column(0).to_pylist():
                rows = x[n * ROWS : (n + 1) * ROWS]
                out = np.zeros((len(rows), y.shape[1]))
                for at in range(0, len(x), COLS):
                    out += _between(rows, x[at : at + COLS], metric) ** power @ y[at : at + COLS]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["n", "out"])

    parts = -(-len(q) // ROWS)
    found = spark.range(0, parts, 1, parts).mapInArrow(kernel, "n long, out binary").toArrow()
    out = np.empty(q.shape)
    for n, part in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        out[n * ROWS : (n + 1) * ROWS] = np.frombuffer(part.as_buffer(), float).reshape(-1, q.shape[1])
    del found
    sent.destroy()
    return out


def _largest(times, start: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``dims`` eigenvalues of largest size, and vectors, of a symmetric matrix known by its products: block Lanczos, restarted.

    Every vector is made orthogonal to all kept ones, so the residuals follow
    from the last block.
    """
    n, size = start.shape
    q, _ = np.linalg.qr(start)
    basis, inner, done = q, np.zeros((0, 0)), 0
    while True:
        image = times(q)
        done += 1
        if not np.isfinite(image).all():
            raise DataError("a distance isn't finite")
        part = basis.T @ image
        inner = np.pad(inner, (0, size))
        inner[:, -size:], inner[-size:] = part, part.T
        image -= basis @ part
        image -= basis @ (basis.T @ image)
        q, last = np.linalg.qr(image)
        # Where the image has fewer dimensions than columns, what is left is rounding and not yet orthogonal.
        for _ in range(2):
            q, more = np.linalg.qr(q - basis @ (basis.T @ q))
            last = more @ last
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        values, turn = values[order], turn[:, order]
        left = np.linalg.norm(last @ turn[-size:, :dims], axis=0).max()
        if left <= RESIDUAL * abs(values[0]) or basis.shape[1] + size > n or done >= PASSES:
            if left > RESIDUAL * abs(values[0]):
                warnings.warn(f"MDS: a residual of {left / abs(values[0]):.1e} is left", stacklevel=2)
            return values[:dims], basis @ turn[:, :dims]
        if basis.shape[1] >= KEPT * size:
            q, _ = np.linalg.qr(basis @ turn[:, :size])
            basis, inner = q, np.zeros((0, 0))
        else:
            basis = np.concatenate([basis, q], axis=1)


def mds(ds: DataFrame, dims: int = 2, metric: str = "euclidean", classical: bool = False, most: int = MOST) -> DataFrame:
    """Coordinates from distances; ``classical`` squares them and scales by square roots.

    Above ``most`` points the same singular vectors are found by products with
    the distances, to a residual of ``RESIDUAL``.
    """
    ids, x = _gathered(ds)
    if len(x) <= most:
        d = _distances(x, metric)
        d = d**2 if classical else d
        centre = np.eye(len(x)) - 1 / len(x)
        u, s, _ = np.linalg.svd(-0.5 * centre @ d @ centre)
        u, s = u[:, :dims], s[:dims]
    else:
        near = metric in ("euclidean", "squared_euclidean")
        spark = ds.sparkSession
        held = spark.sparkContext.broadcast(x - x.mean(axis=0) if near else x)

        def times(q: np.ndarray) -> np.ndarray:
            out = _times_distances(spark, held, q - q.mean(axis=0), metric, 2 if classical else 1)
            return -0.5 * (out - out.mean(axis=0))

        random = np.random.default_rng(0).normal(size=(len(x), dims + 6))
        start = np.concatenate([(x - x.mean(axis=0))[:, :WIDE], random - random.mean(axis=0)], axis=1)
        del x
        s, u = _largest(times, start, dims)
        held.destroy()
        s = np.abs(s)
    return _as_dataset(ds, ids, _signed(u) * (np.sqrt(s) if classical else s))


#: Points up to which a grid holds the cost of every cell.
MOST_COSTS = 2000


def grid(ds: DataFrame, oversample: int = 1, extent: int = 0, horizontal: bool = True, most: int = MOST_COSTS) -> DataFrame:
    """Two-dimensional points moved to cells of a grid, by the least total distance; above ``most`` points without a matrix of costs."""
    ids, x = _gathered(ds)
    if x.shape[1] != 2:
        raise DataError("a grid needs two dimensions")
    n = len(x) * oversample
    if extent > 0:
        across, down = (extent, -(-n // extent)) if horizontal else (-(-n // extent), extent)
    else:
        across = int(np.ceil(np.sqrt(n)))
        down = -(-n // across)
    low, span = x.min(axis=0), np.maximum(np.ptp(x, axis=0), 1e-12)
    cells = np.array([(c, r) for r in range(down) for c in range(across)], float)
    placed = (x - low) / span * [max(across - 1, 0), max(down - 1, 0)]
    if len(x) > most:
        return _as_dataset(ds, ids, cells[assign_cells(ds.sparkSession, placed, across, down)])
    cost = ((placed[:, None] - cells[None]) ** 2).sum(axis=2)
    return _as_dataset(ds, ids, cells[assign(cost)])


def neighbour_widths(rows: np.ndarray, k: int) -> np.ndarray:
    """Widths of the neighbourhoods: by bisection, for ``rows`` of ascending distances, those beyond the first taken from it.

    With it the weights of all neighbours but the first sum to log2(k).
    """
    gap = np.maximum(rows - rows[:, :1], 0)[:, 1:]
    low, high, width = np.zeros(len(rows)), np.full(len(rows), np.inf), np.ones(len(rows))
    on = np.ones(len(rows), bool)
    for _ in range(64):
        total = np.exp(-gap / np.maximum(width, 1e-300)[:, None]).sum(axis=1)
        on &= np.abs(total - np.log2(k)) >= 1e-5
        if not on.any():
            break
        wide = on & (total > np.log2(k))
        narrow = on & ~wide
        high[wide], low[narrow] = width[wide], width[narrow]
        width = np.where(on, np.where(np.isfinite(high), (low + high) / 2, 2 * width), width)
    return width


def fuzzy_union(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a + b - a * b for a directed graph and its reverse, each way once, by (i, j)."""
    code, both = np.concatenate([i * n + j, j * n + i]), np.concatenate([w, w])
    order = np.argsort(code, kind="stable")
    code, both = code[order], both[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    # An edge and its reverse meet here once or twice.
    total, product = np.add.reduceat(both, first), np.multiply.reduceat(both, first)
    twice = np.diff(np.r_[first, len(code)]) == 2
    code = code[first]
    return code // n, code % n, np.where(twice, total - product, total)


def spectral_start(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, dims: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Eigenvectors 1 to ``dims`` of the normalised Laplacian of a sparse graph, by subspace iteration; dense where it is small."""
    degree = np.maximum(np.bincount(i, w, n), 1e-12)
    scaled = w / np.sqrt(degree[i] * degree[j])
    if n <= 1000:
        dense = np.zeros((n, n))
        dense[i, j] = scaled
        return _signed(np.linalg.eigh(np.eye(n) - dense)[1][:, 1 : dims + 1])
    known = np.sqrt(degree / degree.sum())
    x = np.random.default_rng(seed).normal(size=(n, dims + 4))
    for _ in range(rounds):
        # (I + A) / 2 has the Laplacian's eigenvectors, the smallest first; the first is known.
        x = (x + np.stack([np.bincount(i, scaled * x[j, c], n) for c in range(x.shape[1])], axis=1)) / 2
        x -= np.outer(known, known @ x)
        x, _ = np.linalg.qr(x)
    image = (x + np.stack([np.bincount(i, scaled * x[j, c], n) for c in range(x.shape[1])], axis=1)) / 2
    values, turn = np.linalg.eigh(x.T @ image)
    return _signed(x @ turn[:, np.argsort(-values)[:dims]])


#: Points of a layout: its graph of k edges a point and its gradients are held by the driver.
MOST_LAID_OUT = 1_000_000


@dataclass
class UMAP:
    """Neighbour graph in Spark, kept sparse; layout by stochastic gradients on the driver."""

    dims: int = 2
    k: int = 15
    min_dist: float = 0.1
    iterations: int = 200
    learn_rate: float = 0.1
    seed: int = 42
    source: DataFrame | None = None
    layout: dict[str, list[float]] | None = None

    def _curve(self) -> tuple[float, float]:
        """a, b of 1 / (1 + a x^2b) nearest to the wanted fall-off."""
        x = np.linspace(0, 3, 300)
        y = np.where(x < self.min_dist, 1, np.exp(-(x - self.min_dist)))
        best = min(((((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum(), a, b) for a in np.linspace(0.2, 3, 57) for b in np.linspace(0.4, 2, 65)))
        return best[1], best[2]

    def graph(self, ds: DataFrame, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted edges (i, j, w) between places, both ways."""
        near = nearest(ds, ds, self.k + 1).where("query <> id")
        rows = near.select("query", "id", "distance", "rank").toArrow()
        i, j = (np.array([place[x] for x in rows.column(c).to_pylist()], np.int64) for c in ("query", "id"))
        d, rank = rows.column("distance").to_numpy(), rows.column("rank").to_numpy()
        order = np.lexsort((rank, d, i))
        i, j, d = i[order], j[order], d[order]
        # Among more than k equals a point may not have found itself: k others each.
        first = np.searchsorted(i, np.arange(len(place)))
        keep = np.arange(len(i)) - first[i] < self.k
        table = d[keep].reshape(len(place), self.k)
        width = neighbour_widths(table, self.k)
        weight = np.exp(-(table - table[:, :1]) / np.maximum(width, 1e-12)[:, None])
        return fuzzy_union(i[keep], j[keep], weight.ravel(), len(place))

    def fit_transform(self, ds: DataFrame) -> tuple[UMAP, DataFrame]:
        rows = ds.select("id", "pos").orderBy("pos").limit(MOST_LAID_OUT + 1).toArrow()
        ids = rows.column("id").to_pylist()
        if not ids:
            raise DataError("the data set is empty")
        if len(ids) > MOST_LAID_OUT:
            raise DataError(f"more than {MOST_LAID_OUT} points")
        if self.k >= len(ids):
            raise DataError("more neighbours than other points")
        i, j, weights = self.graph(ds, {n: at for at, n in enumerate(ids)})
        random = np.random.default_rng(self.seed)
        y = spectral_start(i, j, weights, len(ids), self.dims, self.seed)
        y = 10 * y / max(np.abs(y).max(), 1e-12) + random.normal(0, 1e-4, y.shape)
        a, b = self._curve()
        share = weights / weights.max()
        for epoch in range(self.iterations):
            rate = self.learn_rate * (1 - epoch / self.iterations)
            on = random.random(len(i)) < share
            p, q = i[on], j[on]
            gap = y[p] - y[q]
            d2 = np.maximum((gap**2).sum(axis=1), 1e-12)
            pull = (-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * gap
            move = np.zeros_like(y)
            np.add.at(move, p, np.clip(pull, -4, 4))
            np.add.at(move, q, -np.clip(pull, -4, 4))
            for _ in range(5):
                other = random.integers(len(y), size=len(p))
                gap = y[p] - y[other]
                d2 = (gap**2).sum(axis=1)
                push = (2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b)))[:, None] * gap
                np.add.at(move, p, np.where(other[:, None] == p[:, None], 0, np.clip(push, -4, 4)))
            y = y + rate * move
        model = UMAP(self.dims, self.k, self.min_dist, self.iterations, self.learn_rate, self.seed, ds, dict(zip(ids, y.tolist(), strict=True)))
        return model, _as_dataset(ds, ids, y)

    def transform(self, ds: DataFrame) -> DataFrame:
        """New points at the weighted mean of their neighbours' places."""
        from .neighbors import regress

        ids = list(self.layout)
        placed = _as_dataset(ds, ids, np.array([self.layout[n] for n in ids]))
        out = regress(self.source, placed, ds, self.k)
        return out.join(ds.select("id", "pos"), "id").select("id", "pos", "point")
