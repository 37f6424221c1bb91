"""A k-d tree of a bounded data set: for streams, single points and model files.

Sets of any size are searched by :func:`ondelys.operators.neighbors.nearest`;
this holds its points in memory (``MOST_BYTES``, checked) and answers rows of a
static or streaming DataFrame without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.vectors import EPSILON
from ..schema import DataError
from .neighbors import BLOCK, _best, _points

MOST_BYTES = 256 << 20
#: Nodes that a block of queries is compared with at a time: distances held by a task are bounded by ``BLOCK * TILE``.
TILE = 8192


@dataclass
class KDTree:
    """``children``: of each node the nodes below its median and above, or -1; node 0 is the root.

    ``pos``: of each node its place in the data set, which decides ties.  Files
    don't hold it: in a tree read from one nodes count in their own order until
    :meth:`placed` gives it back.
    """

    ids: list[str] = field(default_factory=list)
    points: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    pos: np.ndarray | None = None

    def __post_init__(self):
        self.pos = np.arange(len(self.ids)) if self.pos is None else np.asarray(self.pos, np.int64)

    @staticmethod
    def fit(ds: DataFrame) -> KDTree:
        """Median splits, by turns along every dimension."""
        values = ds.agg(F.sum(F.size("point").cast("long"))).first()[0]
        if values is None:
            raise DataError("the data set is empty")
        if 8 * values > MOST_BYTES:
            raise DataError("the data set is too large for a tree; search it with nearest()")
        # As arrays, and ordered here: rows of boxed numbers, or a sort by one task, would take many times the bytes.
        rows = ds.select("id", "pos", "point").toArrow()
        order = np.argsort(rows.column("pos").to_numpy(), kind="stable")
        ids = rows.column("id").to_pylist()
        return KDTree.build([ids[i] for i in order.tolist()], _points(rows.column("point").combine_chunks())[order])

    @staticmethod
    def build(ids: list[str], points: np.ndarray) -> KDTree:
        order: list[int] = []
        children = np.full((len(ids), 2), -1, np.int64)
        # (rows, depth, node above, side): nodes are numbered as they are taken.
        todo = [(np.arange(len(ids)), 0, -1, 0)]
        while todo:
            rows, depth, above, side = todo.pop()
            if not len(rows):
                continue
            rows = rows[np.argsort(points[rows, depth % points.shape[1]], kind="stable")]
            middle, node = len(rows) // 2, len(order)
            order.append(int(rows[middle]))
            if above >= 0:
                children[above, side] = node
            todo += [(rows[middle + 1 :], depth + 1, node, 1), (rows[:middle], depth + 1, node, 0)]
        return KDTree([ids[i] for i in order], points[order], children, np.array(order, np.int64))

    def add(self, name: str, point: list[float]) -> KDTree:
        """A tree with one more node, where a descent by turns ends."""
        point = np.asarray(point, float)
        if len(self.ids) and len(point) != self.points.shape[1]:
            raise DataError("wrong point size")
        new = KDTree([*self.ids, name], np.concatenate([self.points.reshape(len(self.ids), len(point)), point[None]]), np.concatenate([self.children, [[-1, -1]]]), np.r_[self.pos, self.pos.max(initial=-1) + 1])
        node, depth = 0, 0
        while len(self.ids):
            dim = depth % len(point)
            side = int(point[dim] >= self.points[node, dim])
            if new.children[node, side] < 0:
                new.children[node, side] = len(self.ids)
                break
            node, depth = int(new.children[node, side]), depth + 1
        return new

    def placed(self, ds: DataFrame) -> KDTree:
        """The same tree, with ties by the places of its ids in ``ds``."""
        rows = ds.select("id", "pos").toArrow()
        at = dict(zip(rows.column("id").to_pylist(), rows.column("pos").to_pylist(), strict=True))
        if missing := set(self.ids) - set(at):
            raise DataError(f"{len(missing)} ids have no place")
        return KDTree(self.ids, self.points, self.children, np.array([at[n] for n in self.ids], np.int64))

    def by_id(self) -> KDTree:
        """The same tree, with ties to the smaller id."""
        return KDTree(self.ids, self.points, self.children, np.argsort(np.argsort(np.array(self.ids, object), kind="stable")))

    def near(self, point: list[float], k: int = 1, radius: float = 0.0) -> list[tuple[str, float]]:
        """(id, distance) of the ``k`` nearest (0: all) to one point, by descent; a radius keeps what is strictly nearer."""
        if k < 0 or len(point) != self.points.shape[1]:
            raise DataError("k is negative" if k < 0 else "wrong point size")
        x, found = np.asarray(point, float), []  # a heap of (-distance, -place, node)
        todo = [(0, 0, 0.0)] if self.ids else []
        while todo:
            node, depth, gap = todo.pop()
            limit = -found[0][0] if k and len(found) == k else np.inf
            if gap > limit or 0 < radius <= gap:
                continue
            far = float(np.sqrt(((self.points[node] - x) ** 2).sum()))
            if not 0 < radius <= far:
                heapq.heappush(found, (-far, -int(self.pos[node]), node))
                if k and len(found) > k:
                    heapq.heappop(found)
            dim = depth % len(x)
            step = x[dim] - self.points[node, dim]
            side = int(step >= 0)
            for child, least in ((self.children[node, 1 - side], max(gap, abs(step))), (self.children[node, side], gap)):
                if child >= 0:
                    todo.append((int(child), depth + 1, least))
        return [(self.ids[n], -d) for d, _, n in sorted(found, key=lambda f: (-f[0], -f[1]))]

    def _found(self, batch: pa.RecordBatch, k: int, radius: float) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
        """Blocks of ``batch``, each with (node, distance) of the nearest to each of its points."""
        n = len(self.ids)
        block = BLOCK if k else max(1, BLOCK * TILE // max(1, n))
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            x = _points(part.column("point"))
            parts = [_best(list(range(len(x))), x, np.arange(a, min(n, a + TILE)), self.pos[a : a + TILE], self.points[a : a + TILE], k, radius) for a in range(0, n, TILE)]
            rows, nodes, pos, distance = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            order = np.lexsort((pos, distance, rows))
            rows, nodes, distance = rows[order].astype(np.int64), nodes[order], distance[order]
            edges = np.searchsorted(rows, np.arange(len(x) + 1)).tolist()
            ends = [min(b, a + k) if k else b for a, b in zip(edges, edges[1:], strict=False)]
            yield part, [(nodes[a:b], distance[a:b]) for a, b in zip(edges, ends, strict=False)]

    def query(self, table: DataFrame, k: int = 1, radius: float = 0.0) -> DataFrame:
        """``table`` with ``ids`` and ``distances`` of the neighbours of ``point``; works on streams."""
        if k < 0:
            raise DataError("k is negative")
        schema = StructType([*table.schema.fields, StructField("ids", ArrayType(StringType())), StructField("distances", ArrayType(DoubleType()))])
        tree = table.sparkSession.sparkContext.broadcast(self)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, found in tree.value._found(batch, k, radius):
                    ids = pa.array([[tree.value.ids[i] for i in n.tolist()] for n, _ in found], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([d.tolist() for _, d in found], pa.list_(pa.float64()))], schema.names)

        return table.mapInArrow(kernel, schema)


def _shares(distance: np.ndarray, weighted: bool) -> np.ndarray:
    exact = distance < EPSILON
    if not weighted:
        return np.ones(len(distance))
    return exact.astype(float) if exact.any() else 1 / np.maximum(distance, EPSILON)


@dataclass
class KNNClassifier:
    """Votes of the nearest points of a tree; for rows of a static or streaming DataFrame."""

    tree: KDTree
    labels: dict[str, str]
    k: int = 3
    weighted: bool = True

    @staticmethod
    def fit(ds: DataFrame, labels: DataFrame, k: int = 3, weighted: bool = True) -> KNNClassifier:
        tree = KDTree.fit(ds)
        rows = labels.join(ds.select("id"), "id", "left_semi").select("id", "label").toArrow()
        held = dict(zip(rows.column("id").to_pylist(), rows.column("label").to_pylist(), strict=True))
        if set(tree.ids) - set(held):
            raise DataError("some ids have no label")
        return KNNClassifier(tree, held, k, weighted)

    def predict(self, table: DataFrame) -> DataFrame:
        """``table`` with ``label``: the largest vote, ties to the nearest."""
        schema = StructType([*table.schema.fields, StructField("label", StringType())])
        model = table.sparkSession.sparkContext.broadcast(self)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for part, found in (f for batch in batches for f in own.tree._found(batch, own.k, 0.0)):
                out = []
                for nodes, distance in found:
                    votes: dict[str, float] = {}
                    for i, w in zip(nodes.tolist(), _shares(distance, own.weighted).tolist(), strict=True):
                        name = own.labels[own.tree.ids[i]]
                        votes[name] = votes.get(name, 0.0) + w
                    out.append(max(votes, key=votes.get))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], schema.names)

        return table.mapInArrow(kernel, schema)


@dataclass
class KNNRegressor:
    """Weighted means of the targets of the nearest points of a tree."""

    tree: KDTree
    target: dict[str, list[float]]
    k: int = 3
    weighted: bool = True

    @staticmethod
    def fit(ds: DataFrame, targets: DataFrame, k: int = 3, weighted: bool = True) -> KNNRegressor:
        tree = KDTree.fit(ds)
        rows = targets.join(ds.select("id"), "id", "left_semi").select("id", "point").toArrow()
        held = dict(zip(rows.column("id").to_pylist(), rows.column("point").to_pylist(), strict=True))
        if set(tree.ids) - set(held):
            raise DataError("some ids have no target")
        return KNNRegressor(tree, held, k, weighted)

    def predict(self, table: DataFrame) -> DataFrame:
        """``table`` with ``target``, an array."""
        schema = StructType([*table.schema.fields, StructField("target", ArrayType(DoubleType()))])
        model = table.sparkSession.sparkContext.broadcast(self)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for part, found in (f for batch in batches for f in own.tree._found(batch, own.k, 0.0)):
                out = []
                for nodes, distance in found:
                    w = _shares(distance, own.weighted)
                    out.append((w / w.sum()) @ np.array([own.target[own.tree.ids[i]] for i in nodes.tolist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], schema.names)

        return table.mapInArrow(kernel, schema)
