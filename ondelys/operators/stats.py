"""Descriptive statistics of long buffers, exact ranks, and running statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DataError
from ..scratch import stage

STATS = ("mean", "std", "skewness", "kurtosis", "low", "mid", "high")
KEYS = ("buffer_id", "chan")


def rank_of(p: float, n: Column) -> Column:
    """Nearest rank from 0, halves to even."""
    return F.rint(F.lit(float(p)) * (n - 1)).cast("long")


def _plain(frames: DataFrame, low: float, middle: float, high: float) -> DataFrame:
    """Moments by mergeable aggregates and percentiles by brackets: a buffer of any length is dealt over tasks."""
    keyed = frames.select(F.struct(*KEYS).alias("key"), "value")
    flat = F.stddev_pop("value") == 0
    moments = keyed.groupBy("key").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis("value") + 3).alias("kurtosis")
    )
    ranks = exact_ranks(keyed, sorted({low, middle, high})).groupBy(F.col("key").alias("of"))
    ranks = ranks.agg(*[F.max(F.when(F.col("percent") == float(p), F.col("value"))).alias(n) for n, p in (("low", low), ("mid", middle), ("high", high))])
    return moments.join(ranks, F.col("key") == F.col("of")).select("key.*", "mean", "std", "skewness", "kurtosis", "low", "mid", "high")


def _weighted(frames: DataFrame, low: float, middle: float, high: float) -> DataFrame:
    """``frames`` has ``weight``; percentiles take the nearer neighbour of the cumulative weight."""
    key = Window.partitionBy(*KEYS)
    moments = frames.withColumn("_m", F.sum(F.col("weight") * F.col("value")).over(key))
    moments = moments.withColumn("_sd", F.sqrt(F.sum(F.col("weight") * F.pow(F.col("value") - F.col("_m"), F.lit(2.0))).over(key)))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    order = key.orderBy("value", "frame")
    ranked = moments.withColumn("_z", z).withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count("value").over(key))
    ranked = ranked.withColumn("_acc", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_before", F.lag("value").over(order)).withColumn("_prev", F.coalesce(F.lag("_acc").over(order), F.lit(0.0)))
    # The running sum before the second value counts as none.
    ranked = ranked.withColumn("_prev", F.when(F.col("_r") <= 1, F.lit(0.0)).otherwise(F.col("_prev")))

    def pick(p: float, after: Column | None, nearer) -> tuple[Column, Column]:
        reach = (F.col("_r") >= 1) & (F.col("_acc") >= p / 100)
        if after is not None:
            reach = reach & (F.col("_r") >= after)
        first = F.min(F.when(reach, F.struct(F.col("_r").alias("r"), F.when(nearer(F.abs(F.col("_prev") - p / 100), F.abs(F.col("_acc") - p / 100)), F.col("_before")).otherwise(F.col("value")).alias("v")))).over(key)
        return first["v"], first["r"]

    fallback = {"low": F.lit(0), "mid": F.floor((F.col("_n") - 1) / 2), "high": F.col("_n") - 1}
    after = None
    for name, p, nearer in (("low", low, Column.__le__), ("mid", middle, Column.__lt__), ("high", high, Column.__lt__)):
        value, at = pick(p, after, nearer)
        kept = F.max(F.when(F.col("_r") == fallback[name], F.col("value"))).over(key)
        ranked = ranked.withColumn(f"_{name}_at", at).withColumn(f"_{name}", F.coalesce(value, kept))
        after = F.col(f"_{name}_at")
    w = F.col("weight")
    return ranked.groupBy(*KEYS).agg(
        F.first("_m").alias("mean"), F.first("_sd").alias("std"), F.sum(w * F.pow("_z", F.lit(3.0))).alias("skewness"), F.sum(w * F.pow("_z", F.lit(4.0))).alias("kurtosis"), F.first("_low").alias("low"), F.first("_mid").alias("mid"), F.first("_high").alias("high")
    )


def without_outliers(frames: DataFrame, cutoff: float) -> DataFrame:
    """Frames inside the quartile fences of every channel; renumbered from 0."""
    key = Window.partitionBy(*KEYS)
    ranked = frames.withColumn("_r", F.row_number().over(key.orderBy("value", "frame")) - 1).withColumn("_n", F.count("value").over(key))
    for name, p in (("_q1", 0.25), ("_q3", 0.75)):
        ranked = ranked.withColumn(name, F.max(F.when(F.col("_r") == rank_of(p, F.col("_n")), F.col("value"))).over(key))
    margin = (F.col("_q3") - F.col("_q1")) * cutoff
    ranked = ranked.withColumn("_in", (F.col("value") >= F.col("_q1") - margin) & (F.col("value") <= F.col("_q3") + margin))
    kept = ranked.withColumn("_all", F.min("_in").over(Window.partitionBy("buffer_id", "frame"))).where("_all")
    return kept.withColumn("frame", (F.row_number().over(key.orderBy("frame")) - 1).cast("long")).select(*frames.columns)


def buf_stats(frames: DataFrame, num_derivs: int = 0, low: float = 0, middle: float = 50, high: float = 100, outliers: float = -1, weights: DataFrame | None = None, chosen: tuple[str, ...] = STATS) -> DataFrame:
    """(buffer_id, chan, order, <statistics>): seven statistics of values and differences.

    ``weights``: (buffer_id, frame, weight), negative ones count as 0.  Orders
    with too few frames are zero.
    """
    if not 0 <= num_derivs <= 2:
        raise DataError("0, 1 or 2 derivatives")
    base = frames.select("buffer_id", "chan", "frame", "value")
    if weights is not None:
        base = base.join(weights.select("buffer_id", "frame", F.greatest(F.col("weight"), F.lit(0.0)).alias("weight")), ["buffer_id", "frame"]).select("buffer_id", "chan", "frame", "value", "weight")
    if outliers >= 0:
        base = without_outliers(base, outliers)
    if weights is not None:
        whole = F.sum("weight").over(Window.partitionBy(*KEYS))
        base = base.withColumn("weight", F.when(whole > 0, F.col("weight") / whole).otherwise(F.col("weight")))
    parts, now = [], base
    for order in range(num_derivs + 1):
        if order:
            at = Window.partitionBy(*KEYS).orderBy("frame")
            now = now.withColumn("_p", F.lag("value").over(at)).where("_p is not null").withColumn("value", F.col("value") - F.col("_p")).drop("_p")
            now = stage(now, "differences")
        found = (_plain if weights is None else _weighted)(now, low, middle, high)
        parts.append(found.select("buffer_id", "chan", F.lit(order).alias("order"), *STATS))
    table = reduce(DataFrame.unionByName, parts)
    if num_derivs:
        every = base.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(*map(F.lit, range(num_derivs + 1)))).alias("order"))
        table = every.join(table, [*KEYS, "order"], "left").na.fill(0.0, list(STATS))
    return table.select("buffer_id", "chan", "order", *[s for s in STATS if s in chosen])


#: Precision of the sketch that brackets a rank: a bracket holds about 6 / SKETCH of a key's values.
SKETCH = 2000
#: Keys up to which brackets are broadcast.
FEW = 50_000


def exact_ranks(values: DataFrame, percents: list[float]) -> DataFrame:
    """(key, percent, value) at nearest ranks of (key, value) rows, however many there are.

    A sketch of each key brackets the ranks; then one pass counts the values
    below each bracket and those inside it, by value and pre-aggregated, so the
    values themselves are never shuffled.  A key of few values is its own
    bracket, so ranks are exact in every case.
    """
    percents = [float(p) for p in percents]
    ends = [x for p in percents for x in (max(0.0, p / 100 - 3 / SKETCH), min(1.0, p / 100 + 3 / SKETCH))]
    found = F.percentile_approx("value", ends, SKETCH)
    sketch = values.groupBy("key").agg(F.count("value").alias("n"), found.alias("ends"), F.min("value").alias("least"), F.max("value").alias("most"))
    each = F.array(*[F.struct(F.lit(p).alias("percent"), F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high")) for i, p in enumerate(percents)])
    wanted = stage(sketch.select(F.col("key").alias("k"), "n", "least", "most", F.explode(each).alias("w")), "brackets")
    small = F.col("n") <= 4 * SKETCH
    low, high = F.when(small | (F.col("w.percent") <= 0), F.col("least")).otherwise(F.col("w.low")), F.when(small | (F.col("w.percent") >= 100), F.col("most")).otherwise(F.col("w.high"))
    rank = F.rint(F.col("w.percent") / 100 * (F.col("n") - 1)).cast("long")
    wanted = wanted.select("k", F.col("w.percent").alias("percent"), low.alias("low"), high.alias("high"), rank.alias("rank"))
    wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted
    met = values.select("key", "value").join(wanted, (F.col("key") == F.col("k")) & (F.col("value") <= F.col("high")))
    counts = met.groupBy("key", "percent", "rank", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).count()
    up_to = Window.partitionBy("key", "percent").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("end", F.sum("count").over(up_to))
    return ranked.where("value IS NOT NULL AND rank < end AND rank >= end - count").select("key", "percent", "value")


def running_stats(frames: DataFrame, history: int = 2) -> DataFrame:
    """Mean and sample deviation of the last ``history`` values; NaN counts as 0, one value has deviation 0."""
    if history < 2:
        raise DataError("the history is two values at least")
    at = Window.partitionBy(*KEYS).orderBy("frame").rowsBetween(1 - history, 0)
    value = F.nanvl("value", F.lit(0.0))
    return frames.select("buffer_id", "chan", "frame", F.avg(value).over(at).alias("mean"), F.coalesce(F.stddev_samp(value).over(at), F.lit(0.0)).alias("std"))


def column_moments(ds: DataFrame) -> DataFrame:
    """(dim, min, max, mean, std) of a data set, pre-aggregated by task."""
    return ds.select(F.posexplode("point").alias("dim", "value")).groupBy("dim").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """(dim, n, mean, var) of all rows together from the (dim, n, mean, var) of disjoint parts; population variances."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    square = F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean")))
    return parts.groupBy("dim").agg(n.alias("n"), (total / n).alias("mean"), (square / n - (total / n) * (total / n)).alias("var"))
