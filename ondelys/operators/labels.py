"""Label vocabularies and their encodings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataError

#: Classes that a vocabulary may have: it is held by the driver.
MOST = 1_000_000


@dataclass
class LabelEncoder:
    """Labels in the order of their first position; as many as there are classes."""

    labels: list[str]

    @staticmethod
    def fit(table: DataFrame) -> LabelEncoder:
        rows = table.groupBy("label").agg(F.min("pos").alias("p")).orderBy("p", "label").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise DataError(f"more than {MOST} labels")
        return LabelEncoder([r["label"] for r in rows])

    def _known(self, table: DataFrame) -> DataFrame:
        return table.sparkSession.createDataFrame([(n, i) for i, n in enumerate(self.labels)], "_label string, _index int")

    def index(self, table: DataFrame) -> DataFrame:
        """(id, pos, index); an unknown label is -1."""
        found = table.join(self._known(table), F.col("label") == F.col("_label"), "left")
        return found.select("id", "pos", F.coalesce("_index", F.lit(-1)).alias("index"))

    def one_hot(self, table: DataFrame) -> DataFrame:
        """(id, pos, point); an unknown label is all zeros."""
        places = F.sequence(F.lit(0), F.lit(len(self.labels) - 1)) if self.labels else F.expr("cast(array() AS array<int>)")
        return self.index(table).select("id", "pos", F.transform(places, lambda i: (i == F.col("index")).cast("double")).alias("point"))

    def decode(self, ds: DataFrame) -> DataFrame:
        """(id, pos, label) of the first largest value above 0."""
        top = F.array_max("point")
        found = ds.select("id", "pos", F.when(top > 0, F.array_position("point", top).cast("int") - 1).alias("_at"))
        return found.join(self._known(ds), F.col("_at") == F.col("_index"), "left").select("id", "pos", F.col("_label").alias("label"))
