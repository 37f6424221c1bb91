"""Largest inner products by cross-polytope hashing.

Vectors are scaled into the unit ball and lifted to unit length by one more
coordinate (only if their lengths differ), which turns the inner product into
an angle.  A hash rotates them at random, by three rounds of random signs and a
fast Hadamard transform, and gives each the signed axis nearest to it.  A
table's cell is one axis from each of its hashes; there are as many hashes to a
table as it takes to bring a cell down to about ``CELL`` vectors, so cells grow
in number with the vectors.  A query looks into the cells nearest to itself, by
the sum of its coordinates along their axes, in every table, and what it finds
there is ranked by exact inner products of the original vectors.

How many cells a query looks into is measured, not guessed: the true neighbours
of ``SAMPLE`` queries among all vectors, found by one scan, tell at which probe
each would have been met, and the least number with a recall of ``RECALL`` is
taken.  Where no number up to ``MOST_PROBES`` reaches it, a hash less is used;
with one hash all cells can be looked into, so the recall is always reached.

Equal vectors are folded first: of a group of copies, however large, only its
``k + 1`` smallest ids can be among the ``k`` nearest of anything.  A crowded
cell is dealt over chunks of about ``CHUNK`` vectors, each met by the queries
that probe it in blocks, so no task holds more than a chunk.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, or whose dimension isn't the most common one, take no part, nor do
rows without an id.  Rows with equal id are one candidate each if their vectors
differ; a query never finds rows with its own id.  Among equal scores the
smaller ids are found, however many there are.  A query that finds too few
looks at all vectors.  Empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage

TABLES = 4
#: Vectors of an average cell, above which a table gets another hash.
CELL = 8192
CHUNK = 8192
BLOCK = 256
SEED = 7
#: Queries whose true neighbours set the number of probes, and the recall it must give them.
SAMPLE, RECALL = 64, 0.96
MOST_PROBES = 4096
#: Crowded cells up to which their list is broadcast.
LISTED = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x / np.sqrt(size)


class Hasher:
    """Pseudo-rotations and signed axes of every table."""

    def __init__(self, dimension: int, longest: float, lift: bool, tables: int = TABLES, hashes: int = 1, seed: int = SEED):
        self.dimension, self.longest, self.lift, self.tables, self.hashes = dimension, longest, lift, tables, hashes
        self.size = 1 << max(0, dimension + lift - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    @property
    def cells_of_table(self) -> int:
        return (2 * self.size) ** self.hashes

    def _rotated(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        for signs in self.signs[table, k]:
            x = hadamard(x * signs)
        return x

    def _placed(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.size))
        length = np.sqrt((vectors**2).sum(axis=1))
        scale = length if query else np.full(len(vectors), self.longest)
        out[:, : self.dimension] = vectors / np.maximum(scale, 1e-300)[:, None]
        if self.lift and not query:
            out[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (length / self.longest) ** 2))
        return out

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): of each hash twice the nearest axis, one more if it points away, as digits of one number."""
        x, out = self._placed(vectors, False), np.zeros((len(vectors), self.tables), np.int64)
        for t, k in product(range(self.tables), range(self.hashes)):
            y = self._rotated(x, t, k)
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * 2 * self.size + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes): the cells nearest to each query, nearest first."""
        x, probes = self._placed(vectors, True), min(probes, self.cells_of_table)
        # Of each hash so many axes that every choice of them can be weighed.
        each = min(2 * self.size, max(2, int((1 << 16) ** (1 / self.hashes))))
        probes = min(probes, each**self.hashes)
        out = np.empty((len(vectors), self.tables, probes), np.int64)
        for t in range(self.tables):
            for a in range(0, len(x), BLOCK // 8):
                part = x[a : a + BLOCK // 8]
                code, near = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1))
                for k in range(self.hashes):
                    y = self._rotated(part, t, k)
                    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                    best = np.argsort(-both, axis=1, kind="stable")[:, :each]
                    code = (code[:, :, None] * 2 * self.size + best[:, None, :]).reshape(len(part), -1)
                    near = (near[:, :, None] + np.take_along_axis(both, best, axis=1)[:, None, :]).reshape(len(part), -1)
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                out[a : a + BLOCK // 8, t] = np.take_along_axis(code, order, axis=1)
        return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vec) rows that take part, and their dimension."""
    # Single precision is kept as it is and widened where it is used.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    vec = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = common["d"] if common else 0
    return rows.where(F.size("vec") == dimension), dimension


def _search(held: DataFrame, asked: DataFrame, dimension: int, k: int) -> DataFrame:
    """(q, rep, score) of queries (table, cell, chunk, q, vec) among vectors (table, cell, chunk, rep, vec)."""
    place = ["table", "cell", "chunk"]
    held = held.select(*place, F.lit(0).alias("kind"), F.col("rep").alias("id"), "vec")
    asked = asked.select(*place, F.lit(1).alias("kind"), F.col("q").alias("id"), "vec")
    dealt = held.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind", "id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, ids, parts = None, None, [], []
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (*place, "kind")], axis=1)
            own, vec = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dimension)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = tuple(key[a, :3].tolist())
                if here != now:
                    # One table at a time: in it every vector is met once, so the best so far is a bound.
                    if here[0] != table or len(best) > 200_000:
                        table, best = here[0], {}
                    now, ids, parts = here, [], []
                if key[a, 3] == 0:
                    ids.append(own[a:b])
                    parts.append(vec[a:b])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                for at in range(a, b, BLOCK):
                    q, x = own[at : min(b, at + BLOCK)], vec[at : min(b, at + BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best_of_block(q, x, ids[0], parts[0], k, best)], ["q", "rep", "score"])

    found = dealt.mapInArrow(kernel, "q long, rep long, score double").groupBy("q", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _best_of_block(q: np.ndarray, x: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, best: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best of each query, ties to the smaller id; ``best`` keeps each query's best scores."""
    rough = x @ vectors.T
    floor = np.array([best[one][-1] if one in best and len(best[one]) == k else -np.inf for one in q.tolist()])
    if len(ids) > k:
        floor = np.maximum(floor, -np.partition(-rough, k - 1, axis=1)[:, k - 1])
    # Products by blocks differ from exact ones by rounding alone.
    slack = 1e-12 * np.sqrt((x**2).sum(axis=1) * max(1e-300, (vectors**2).sum(axis=1).max()))
    row, col = np.nonzero(rough >= (floor - slack)[:, None])
    exact = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = (x[row[part]] * vectors[col[part]]).sum(axis=1)
    order = np.lexsort((ids[col], -exact, row))
    row, exact, found = row[order], exact[order], ids[col[order]]
    start = np.searchsorted(row, np.arange(len(q)))
    # Sorted by score and id, the first k are enough: what ties with the last of them has a larger id.
    keep = np.arange(len(row)) - start[row] < k
    row, exact, found = row[keep], exact[keep], found[keep]
    edges = np.searchsorted(row, np.arange(len(q) + 1)).tolist()
    for one, a, b in zip(q.tolist(), edges, edges[1:], strict=False):
        best[one] = np.sort(np.r_[best[one], exact[a:b]])[::-1][:k] if one in best else exact[a:b]
    return q[row], found, exact


def _true_neighbours(index: DataFrame, sample: np.ndarray, k: int, dimension: int) -> list[np.ndarray]:
    """The ``k`` vectors nearest to each of a few sampled ones, but for equals of it, by one scan of all."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros((0, dimension))) for _ in sample]
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _matrix(batch.column(0), dimension)
            rough = sample @ vec.T
            for i, one in enumerate(sample):
                top = np.argpartition(-rough[i], min(k, len(vec) - 1))[: k + 1]
                top = top[(vec[top] != one).any(axis=1)]
                score, found = np.r_[held[i][0], rough[i, top]], np.r_[held[i][1], vec[top]]
                order = np.argsort(-score, kind="stable")[:k]
                held[i] = score[order], found[order]
        rows = [(i, s, v.tolist()) for i, (score, found) in enumerate(held) for s, v in zip(score.tolist(), found, strict=True)]
        i, s, v = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(s, pa.float64()), pa.array(v, pa.list_(pa.float64()))], ["i", "s", "v"])

    order = Window.partitionBy("i").orderBy(F.desc("s"))
    # SAMPLE * k rows at most.
    rows = index.select("vec").mapInArrow(kernel, "i int, s double, v array<double>").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()
    return [np.array([r["v"] for r in rows if r["i"] == i]).reshape(-1, dimension) for i in range(len(sample))]


def tuned(index: DataFrame, queries: DataFrame, dimension: int, count: int, longest: float, lift: bool, k: int, tables: int, cell: int, recall: float, seed: int) -> tuple[Hasher, int, float]:
    """Hasher, number of probes in each table, and the recall this gives the sampled queries."""
    rows = queries.orderBy(F.xxhash64("q")).limit(SAMPLE).collect()
    sample = np.array([r["vec"] for r in rows], float).reshape(-1, dimension)
    near = _true_neighbours(index, sample, k, dimension)
    hashes = 1
    while count / Hasher(dimension, longest, lift, 1, hashes).cells_of_table > cell:
        hashes += 1
    while True:
        hasher = Hasher(dimension, longest, lift, tables, hashes, seed)
        most = min(MOST_PROBES, hasher.cells_of_table) if hashes > 1 else hasher.cells_of_table
        first = []
        for one, found in zip(sample, near, strict=True):
            if len(found):
                met = hasher.probes(one[None], most)[0][None] == hasher.cells(found)[:, :, None]
                first.append(np.where(met.any(axis=2), met.argmax(axis=2), most).min(axis=1))
        met = np.sort(np.concatenate(first)) if first else np.zeros(1)
        probes = int(met[max(0, int(np.ceil(recall * len(met))) - 1)]) + 1
        if probes <= most or hashes == 1:
            return hasher, min(probes, most), float((met < probes).mean())
        hashes -= 1


def nearest(vectors: DataFrame, k: int = 20, query_step: int = 20, tables: int = TABLES, probes: int | None = None, chunk: int = CHUNK, seed: int = SEED, cell: int = CELL, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every id divisible by ``query_step``.

    ``probes`` is measured if it isn't given.
    """
    rows, dimension = usable(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    if not dimension:
        return vectors.sparkSession.createDataFrame([], empty)
    # The k + 1 smallest ids of each distinct vector; the rank limit is applied before the shuffle too.
    place = Window.partitionBy("vec").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
    folded = stage(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    # Two distinct vectors may share an id; reps have to differ, and to be in the order of the smallest ids.
    if folded.count() != folded.select("rep").distinct().count():
        folded = stage(folded.orderBy("rep", F.xxhash64("vec")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    low, high, count = folded.agg(F.min(F.sqrt(square)), F.max(F.sqrt(square)), F.count(F.lit(1))).first()
    lift = low < high * (1 - 1e-6)

    asking = rows.where(F.col("id") % query_step == 0).distinct()
    distinct = stage(asking.groupBy("vec").agg(F.min("id").alias("q")), "queries")
    if distinct.count() != distinct.select("q").distinct().count():
        distinct = stage(distinct.withColumn("q", F.monotonically_increasing_id()), "queries")
    if probes is None:
        hasher, probes, _ = tuned(folded, distinct, dimension, count, high, lift, k, tables, cell, recall, seed)
    else:
        hasher = Hasher(dimension, high, lift, tables, 1, seed)

    def place_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hasher.cells(_matrix(batch.column("vec"), dimension)) if batch.num_rows else np.zeros((0, hasher.tables), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), pa.array(list(cells), pa.list_(pa.int64()))], ["rep", "vec", "cells"])

    kind = rows.schema["vec"].dataType.simpleString()
    index = stage(folded.select("rep", "vec").mapInArrow(place_index, f"rep long, vec {kind}, cells array<bigint>"), "index")
    placed = index.select("rep", "vec", F.posexplode("cells").alias("table", "cell"))
    # Cells of more than a chunk; few, as the average cell is below one.
    crowded = placed.groupBy("table", "cell").count().where(F.col("count") > chunk)
    crowded = stage(crowded.select(F.col("table").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "crowded")
    crowded = F.broadcast(crowded) if crowded.limit(LISTED + 1).count() <= LISTED else crowded.hint("merge")

    def chunked(rows: DataFrame, chunks) -> DataFrame:
        joined = rows.join(crowded, (F.col("table") == F.col("t")) & (F.col("cell") == F.col("c")), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        return joined.withColumn("chunk", chunks).drop("t", "c", "chunks")

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = hasher.probes(_matrix(part.column("vec"), dimension), probes)
                width = found.shape[2]
                table = pa.array(list(np.tile(np.repeat(np.arange(hasher.tables, dtype=np.int32), width), (part.num_rows, 1))), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("vec"), table, pa.array(list(found.reshape(part.num_rows, -1)), pa.list_(pa.int64()))], ["q", "vec", "tables", "cells"])

    probing = distinct.select("q", "vec").mapInArrow(place_queries, f"q long, vec {kind}, tables array<int>, cells array<bigint>")
    probing = probing.select("q", "vec", F.explode(F.arrays_zip("tables", "cells")).alias("z")).select("q", "vec", F.col("z.tables").alias("table"), F.col("z.cells").alias("cell"))
    held = chunked(placed, F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    asked = chunked(probing, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = stage(_search(held, asked, dimension, k + 1), "found")
    counts = found.groupBy(F.col("q").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    short = stage(distinct.join(counts, F.col("q") == F.col("of"), "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, count)).select("q", "vec"), "short")
    if not short.isEmpty():
        chunks, zero = -(-count // chunk), (F.lit(0).alias("table"), F.lit(0).cast("long").alias("cell"))
        every = index.select("rep", "vec", *zero, F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int").alias("chunk"))
        again = _search(every, short.select("q", "vec", *zero, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")), dimension, k + 1)
        found = found.join(short.select("q"), "q", "left_anti").unionByName(again)
    ids = found.join(folded.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * k + 2).drop("n")
    per_query = asking.join(distinct.withColumnRenamed("vec", "q_vec"), F.col("vec") == F.col("q_vec")).select(F.col("id").alias("query_id"), "q")
    joined = per_query.join(top, "q").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return joined.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
