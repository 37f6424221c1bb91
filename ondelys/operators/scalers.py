"""Scalers: fitted ranges of columns, applied as array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..schema import DataError
from .stats import column_moments, exact_ranks


def _safe(r: float) -> float:
    return 1.0 if r < 10 * EPSILON else r


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Affine:
    """A scaler is, per column, ``x * slope + offset``."""

    def coefficients(self) -> tuple[list[float], list[float]]:
        raise NotImplementedError

    @property
    def cols(self) -> int:
        return len(self.coefficients()[0])

    def _apply(self, ds: DataFrame, inverse: bool) -> DataFrame:
        slope, offset = self.coefficients()
        line = F.arrays_zip(_array(slope).alias("a"), _array(offset).alias("b"))
        step = (lambda x, c: (x - c["b"]) / c["a"]) if inverse else (lambda x, c: x * c["a"] + c["b"])
        return ds.withColumn("point", F.zip_with("point", line, step))

    def transform(self, ds: DataFrame) -> DataFrame:
        return self._apply(ds, False)

    def inverse_transform(self, ds: DataFrame) -> DataFrame:
        return self._apply(ds, True)

    def transform_point(self, point: list[float]) -> list[float]:
        slope, offset = self.coefficients()
        if len(point) != len(slope):
            raise DataError("wrong point size")
        return [x * a + b for x, a, b in zip(point, slope, offset, strict=True)]

    def inverse_transform_point(self, point: list[float]) -> list[float]:
        slope, offset = self.coefficients()
        return [(x - b) / a for x, a, b in zip(point, slope, offset, strict=True)]


def _rows(ds: DataFrame) -> list:
    rows = column_moments(ds).orderBy("dim").collect()
    if not rows:
        raise DataError("the data set is empty")
    return rows


@dataclass
class Normalize(Affine):
    """Columns to [low, high] by their minimum and maximum."""

    low: float = 0.0
    high: float = 1.0
    data_min: list[float] | None = None
    data_max: list[float] | None = None

    def fit(self, ds: DataFrame) -> Normalize:
        rows = _rows(ds)
        return Normalize(self.low, self.high, [r["min"] for r in rows], [r["max"] for r in rows])

    def coefficients(self) -> tuple[list[float], list[float]]:
        slope = [(self.high - self.low) / _safe(b - a) for a, b in zip(self.data_min, self.data_max, strict=True)]
        return slope, [self.low - a * s for a, s in zip(self.data_min, slope, strict=True)]


@dataclass
class Standardize(Affine):
    """Columns to mean 0 and population deviation 1."""

    mean: list[float] | None = None
    std: list[float] | None = None

    def fit(self, ds: DataFrame) -> Standardize:
        rows = _rows(ds)
        return Standardize([r["mean"] for r in rows], [_safe(r["std"]) for r in rows])

    def coefficients(self) -> tuple[list[float], list[float]]:
        return [1 / s for s in self.std], [-m / s for m, s in zip(self.mean, self.std, strict=True)]


@dataclass
class RobustScale(Affine):
    """Columns to median 0 and distance 1 between two percentiles, by nearest rank."""

    low: float = 25.0
    high: float = 75.0
    data_low: list[float] | None = None
    median: list[float] | None = None
    data_high: list[float] | None = None

    def fit(self, ds: DataFrame) -> RobustScale:
        values = ds.select(F.posexplode("point").alias("key", "value"))
        found = {(r["key"], r["percent"]): r["value"] for r in exact_ranks(values, [self.low, 50.0, self.high]).collect()}
        if not found:
            raise DataError("the data set is empty")
        dims = range(1 + max(k for k, _ in found))
        return RobustScale(self.low, self.high, *[[found[d, p] for d in dims] for p in (float(self.low), 50.0, float(self.high))])

    def coefficients(self) -> tuple[list[float], list[float]]:
        slope = [1 / _safe(b - a) for a, b in zip(self.data_low, self.data_high, strict=True)]
        return slope, [-m * s for m, s in zip(self.median, slope, strict=True)]
