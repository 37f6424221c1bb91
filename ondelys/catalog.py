"""Named data sets, label sets and models of one session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import DataError


class Catalog:
    """Looks objects up by name; tables are temporary views too, so SQL reaches them."""

    def __init__(self):
        self._held: dict[str, object] = {}

    def put(self, name: str, thing) -> None:
        if isinstance(thing, DataFrame):
            thing.createOrReplaceTempView(name)
        self._held[name] = thing

    def get(self, name: str):
        if name not in self._held:
            raise DataError(f"{name} does not exist")
        return self._held[name]

    def drop(self, name: str) -> None:
        thing = self._held.pop(name, None)
        if isinstance(thing, DataFrame):
            thing.sparkSession.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self._held)

    def call(self, work, *names, **settings):
        """``work`` with what the names stand for in their place; a name that isn't held is an error, other arguments pass."""
        return work(*[self.get(n) if isinstance(n, str) else n for n in names], **settings)


CORPUS = "label string, buffer_id string, offset long, length long"


def corpus_entry(spark, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """(label, buffer_id, offset, length): regions of buffers by name."""
    return spark.createDataFrame(rows, CORPUS)


def corpus_add(corpus: DataFrame, label: str, buffer_id: str, offset: int, length: int) -> DataFrame:
    """One more region; its label must be new."""
    if not corpus.where(F.col("label") == label).isEmpty():
        raise DataError("the label exists already")
    return corpus.unionByName(corpus_entry(corpus.sparkSession, [(label, buffer_id, offset, length)]))


def corpus_get(corpus: DataFrame, label: str) -> tuple[str, int, int]:
    row = corpus.where(F.col("label") == label).first()
    if row is None:
        raise DataError("label not found")
    return row["buffer_id"], row["offset"], row["length"]


def corpus_update(corpus: DataFrame, label: str, buffer_id: str, offset: int, length: int) -> DataFrame:
    corpus_get(corpus, label)
    return corpus_delete(corpus, label).unionByName(corpus_entry(corpus.sparkSession, [(label, buffer_id, offset, length)]))


def corpus_delete(corpus: DataFrame, label: str) -> DataFrame:
    corpus_get(corpus, label)
    return corpus.where(F.col("label") != label)


def corpus_frames(corpus: DataFrame, frames: DataFrame) -> DataFrame:
    """Long frames of every region, from its offset on, with the label for buffer."""
    inside = (F.col("frame") >= F.col("offset")) & (F.col("frame") < F.col("offset") + F.col("length"))
    found = frames.join(corpus, "buffer_id").where(inside)
    return found.select(F.col("label").alias("buffer_id"), "chan", (F.col("frame") - F.col("offset")).alias("frame"), "value")
