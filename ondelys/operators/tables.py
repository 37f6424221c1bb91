"""Verbs on data sets and label sets: each gives a new table, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DataError, width


def _payload(table: DataFrame) -> str:
    return "point" if "point" in table.columns else "label"


def _value(table: DataFrame, value) -> Column:
    return F.array(*[F.lit(float(x)) for x in value]) if _payload(table) == "point" else F.lit(str(value))


def _next_pos(table: DataFrame) -> int:
    top = table.agg(F.max("pos")).first()[0]
    return 0 if top is None else top + 1


def _has(table: DataFrame, name: str) -> bool:
    return not table.where(F.col("id") == name).isEmpty()


def _check(table: DataFrame, name: str, value) -> None:
    if not name or (_payload(table) == "label" and not value):
        raise DataError("an id or label is empty")
    if _payload(table) == "point" and (w := width(table)) and w != len(value):
        raise DataError("wrong point size")


def add(table: DataFrame, name: str, value) -> DataFrame:
    """One more row; the id must be new and the width that of the others."""
    _check(table, name, value)
    if _has(table, name):
        raise DataError("the id exists already")
    row = table.sparkSession.range(1).select(F.lit(name).alias("id"), F.lit(_next_pos(table)).cast("long").alias("pos"), _value(table, value).alias(_payload(table)))
    return table.unionByName(row)


def get(table: DataFrame, name: str):
    """The point of an id; a missing label is the empty string."""
    row = table.where(F.col("id") == name).select(_payload(table)).first()
    if row is None:
        if _payload(table) == "label":
            return ""
        raise DataError("point not found")
    return row[0]


def update(table: DataFrame, name: str, value) -> DataFrame:
    """Overwrite an existing row; a longer point is cut to the width."""
    if not _has(table, name):
        raise DataError("point not found")
    if _payload(table) == "point":
        value = list(value)[: width(table)]
        _check(table, name, value)
    kind = _payload(table)
    return table.withColumn(kind, F.when(F.col("id") == name, _value(table, value)).otherwise(F.col(kind)))


def put(table: DataFrame, name: str, value) -> DataFrame:
    """Update or add."""
    return update(table, name, value) if _has(table, name) else add(table, name, value)


def delete(table: DataFrame, name: str) -> DataFrame:
    """Without a row; the positions behind it close up."""
    found = table.where(F.col("id") == name).select("pos").first()
    if found is None:
        raise DataError("point not found")
    return table.where(F.col("id") != name).withColumn("pos", F.when(F.col("pos") > found[0], F.col("pos") - 1).otherwise(F.col("pos")))


def merge(table: DataFrame, other: DataFrame, overwrite: bool = False) -> DataFrame:
    """``table`` and the new ids of ``other`` behind it; ids in both change only if ``overwrite``."""
    kind = _payload(table)
    if kind == "point" and (a := width(table)) and (b := width(other)) and a != b:
        raise DataError("points differ in width")
    start = _next_pos(table)
    fresh = other.join(table.select("id"), "id", "left_anti").select("id", (F.col("pos") + start).alias("pos"), kind)
    if overwrite:
        theirs = other.select(F.col("id"), F.col(kind).alias("_new"))
        table = table.join(theirs, "id", "left").select("id", "pos", F.coalesce("_new", kind).alias(kind))
    return table.unionByName(fresh)


def size(table: DataFrame) -> int:
    return table.count()


def clear(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))


def ids(table: DataFrame) -> DataFrame:
    """Label set from the position to the id."""
    return table.select(F.col("pos").cast("string").alias("id"), "pos", F.col("id").alias("label"))


def missing_ids(table: DataFrame, other: DataFrame) -> DataFrame:
    """Ids of ``table`` that ``other`` lacks."""
    return table.select("id").join(other.select("id"), "id", "left_anti")


def common_ids(table: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id ``other`` has too."""
    return table.join(other.select("id"), "id", "left_semi").select(*table.columns)


def positions(table: DataFrame, other: DataFrame) -> DataFrame:
    """(id, pos_a, pos_b) of the ids in both; every id of ``other`` must be in ``table``."""
    return table.select("id", F.col("pos").alias("pos_a")).join(other.select("id", F.col("pos").alias("pos_b")), "id")


def show(table: DataFrame, rows: int = 6, cols: int = 6) -> str:
    """Abbreviated text: the first and last three rows, and columns, of larger tables."""
    count = size(table)
    first = table.orderBy("pos").limit(rows if count < rows else 3).collect()
    last = [] if count < rows else table.orderBy(F.desc("pos")).limit(3).collect()[::-1]

    def line(row) -> str:
        value = row[_payload(table)]
        if isinstance(value, str):
            shown = [value]
        else:
            shown = [f"{x:.5g}" for x in value] if len(value) < cols else [*(f"{x:.5g}" for x in value[:3]), "...", *(f"{x:.5g}" for x in value[-3:])]
        return " ".join([row["id"], *shown])

    body = [line(r) for r in first] + (["..."] if last else []) + [line(r) for r in last]
    wide = width(table) if _payload(table) == "point" else 1
    return "\n".join([f"rows: {count} cols: {wide}", *body])


def id_sequence(spark: SparkSession, count: int, prefix: str = "", start: int = 0, end: int | None = None) -> DataFrame:
    """(pos, id): prefix and a number, which wraps to ``start`` after ``end``."""
    n = F.col("id") if end is None else F.col("id") % (end - start + 1)
    return spark.range(count).select(F.col("id").alias("pos"), F.concat(F.lit(prefix), (n + start).cast("string")).alias("id"))


def from_buffer(features: DataFrame, labels: DataFrame | None = None, transpose: bool = False) -> DataFrame:
    """Data set from long frames of one buffer: frames are rows, or channels if ``transpose``; ids are the labels' or 0, 1, ..."""
    row, col = ("chan", "frame") if transpose else ("frame", "chan")
    rows = features.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(col, "value"))).alias("v")).select(F.col(row).cast("long").alias("pos"), F.transform("v", lambda x: x["value"].cast("double")).alias("point"))
    if labels is None:
        return rows.select(F.col("pos").cast("string").alias("id"), "pos", "point")
    named = labels.select("pos", F.col("label").alias("id"))
    if named.count() != rows.count():
        raise DataError("the label set has another size")
    return rows.join(named, "pos").select("id", "pos", "point")


def row_labels(table: DataFrame, labelwise: bool = False) -> DataFrame:
    """Label set of the rows of a buffer: the position's id, or with ``labelwise`` the id's position."""
    pos = F.col("pos").cast("string")
    id_, label = (F.col("id"), pos) if labelwise else (pos, F.col("id"))
    return table.select(id_.alias("id"), "pos", label.alias("label"))


def to_buffer(table: DataFrame, transpose: bool = False) -> DataFrame:
    """Long frames of a data set: rows are frames, or channels if ``transpose``; :func:`row_labels` names them."""
    long = table.select("pos", F.posexplode("point").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))
    frame, chan = ("dim", "pos") if transpose else ("pos", "dim")
    return long.select(F.lit("0").alias("buffer_id"), F.col(chan).alias("chan"), F.col(frame).alias("frame"), "value")
