"""The data abstractions and how ordinary tables become them.

* data set: ``id`` string, ``pos`` long (insertion order), ``point`` array of
  double, all points of one width;
* label set: ``id``, ``pos``, ``label`` string;
* buffer: ``buffer_id``, ``chan``, ``sample_rate``, ``samples`` array of float
  (packed), or ``buffer_id``, ``chan``, ``frame``, ``value`` (long);
* features: ``buffer_id``, ``chan``, ``frame``, ``features`` array of double;
* slices: ``buffer_id``, ``slice``, ``onset`` and for gates ``offset``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

DATASET = StructType([StructField("id", StringType(), False), StructField("pos", LongType()), StructField("point", ArrayType(DoubleType()))])
LABELSET = StructType([StructField("id", StringType(), False), StructField("pos", LongType()), StructField("label", StringType())])
BUFFER = StructType([StructField("buffer_id", StringType()), StructField("chan", LongType()), StructField("sample_rate", DoubleType()), StructField("samples", ArrayType(FloatType()))])


class DataError(ValueError):
    """A data set, label set or buffer isn't what an operator needs."""


def dataset(df: DataFrame, id_col: str, pos_col: str | Column, values: str | list[str]) -> DataFrame:
    """A data set from a table: ``values`` is one array column, or the columns of the point in order."""
    point = F.col(values).cast("array<double>") if isinstance(values, str) else F.array(*[F.col(c).cast("double") for c in values])
    pos = F.col(pos_col) if isinstance(pos_col, str) else pos_col
    return df.select(F.col(id_col).cast("string").alias("id"), pos.cast("long").alias("pos"), point.alias("point"))


def labelset(df: DataFrame, id_col: str, pos_col: str | Column, label_col: str) -> DataFrame:
    pos = F.col(pos_col) if isinstance(pos_col, str) else pos_col
    return df.select(F.col(id_col).cast("string").alias("id"), pos.cast("long").alias("pos"), F.col(label_col).cast("string").alias("label"))


def with_ranks(table: DataFrame, by: str) -> DataFrame:
    """``table`` with ``pos``, the rank of ``by`` from 0: sorted by range, then counted, so no task holds more than its range."""
    from .scratch import stage

    dealt = stage(table.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    # One row to a range.
    counts = dealt.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_of", "_first", before.alias("_before"))
    joined = dealt.join(F.broadcast(counts), F.col("_part") == F.col("_of"))
    return joined.withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_of", "_first", "_before")


def to_wide(ds: DataFrame, names: list[str]) -> DataFrame:
    """One flat column per dimension, so that filters and pruning reach the files."""
    return ds.select("id", "pos", *[F.col("point")[i].alias(n) for i, n in enumerate(names)])


def width(ds: DataFrame) -> int:
    """Width of the points, 0 for an empty set; raises if they differ or one is null."""
    low, high, null = ds.agg(F.min(F.size("point")), F.max(F.size("point")), F.max(F.col("point").isNull())).first()
    if null:
        raise DataError("a point is null")
    if low != high:
        raise DataError("points differ in width")
    return low or 0


def from_rows(spark: SparkSession, rows: list[tuple[str, list[float]]]) -> DataFrame:
    """A data set from (id, point) pairs in order; the first of equal ids counts."""
    seen: dict[str, list[float]] = {}
    for name, point in rows:
        seen.setdefault(name, [float(x) for x in point])
    if len({len(p) for p in seen.values()}) > 1:
        raise DataError("points differ in width")
    return spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(seen.items())], DATASET)


def buffer(spark: SparkSession, signals: dict[str, list], sample_rate: float = 44100.0) -> DataFrame:
    """Packed buffers from name -> samples, or name -> list of channels."""
    rows = []
    for name, data in signals.items():
        channels = data if len(data) and hasattr(data[0], "__len__") else [data]
        rows += [(name, c, float(sample_rate), [float(x) for x in samples]) for c, samples in enumerate(channels)]
    return spark.createDataFrame(rows, BUFFER)


def series(df: DataFrame, key: str, order: list[str], value: str, sample_rate: float = 1.0) -> DataFrame:
    """Long buffer from a table: one mono buffer per ``key``, frames in ``order``."""
    at = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).cast("string").alias("buffer_id"), F.lit(0).cast("long").alias("chan"), (F.row_number().over(at) - 1).cast("long").alias("frame"), F.col(value).cast("double").alias("value"))


def pack(frames: DataFrame, sample_rate: float = 1.0) -> DataFrame:
    """Packed buffers from long ones: one array per buffer and channel."""
    rows = frames.groupBy("buffer_id", "chan").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("rows"))
    return rows.select("buffer_id", "chan", F.lit(float(sample_rate)).alias("sample_rate"), F.transform("rows", lambda r: r["value"].cast("float")).alias("samples"))


def unpack(buffers: DataFrame) -> DataFrame:
    """Long buffers from packed ones."""
    out = buffers.select("buffer_id", "chan", F.posexplode("samples").alias("frame", "value"))
    return out.select("buffer_id", "chan", F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
